"""Frames that follow their source, and pods over micro-batches."""

from __future__ import annotations

from ..frame import TagFrame
from ..functions.pods import CachedPod


class LiveFrame:
    """Rebuilds its frame when a source has a new version.

    Its sources may be live frames too: a new version at the far end makes all
    that is built on it stale.
    """

    def __init__(self, build, *sources):
        self.build, self.sources = build, sources
        self._versions, self._frame = None, None

    @property
    def is_current(self) -> bool:
        return self._frame is not None and self._versions == self.version()

    def version(self) -> list:
        return [s.version() for s in self.sources]

    @property
    def modified(self) -> float | None:
        """The latest time of change of any source that knows one."""
        known = [m for s in self.sources if (m := getattr(s, "modified", None)) is not None]
        return max(known, default=None)

    def refresh(self, force: bool = False) -> TagFrame:
        if force or not self.is_current:
            self._versions = self.version()
            self._frame = self.build(*(s.refresh() if isinstance(s, LiveFrame) else s.frame() for s in self.sources))
        return self._frame

    def invalidate(self, upstream: bool = False) -> None:
        """Forget the frame, and those it is built on if asked."""
        self._frame = None
        for s in self.sources if upstream else ():
            if isinstance(s, LiveFrame):
                s.invalidate(True)

    @property
    def frame(self) -> TagFrame:
        return self.refresh()


def stream_pod(stream, tags, pod: CachedPod, checkpoint: str, trigger: dict | None = None):
    """Run a remembering pod over a streaming DataFrame: each batch computes what is new."""

    def each(df, _):
        pod(TagFrame.of(df, tags))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
