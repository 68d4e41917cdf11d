"""Recording of operator and pod calls."""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from ..errors import InputValidationError

_trackers: ContextVar[tuple] = ContextVar("trackers", default=())


@dataclass(frozen=True)
class Invocation:
    kernel: object
    inputs: tuple[str, ...]  # lineages
    output: str
    label: str


class GraphTracker:
    """Collects the invocations made while it is active; equal ones once."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.invocations: dict[str, Invocation] = {}
        self.frames: dict = {}

    def record(self, kernel, inputs, output) -> None:
        if output.lineage in self.invocations or output.lineage in {f.lineage for f in inputs}:
            return
        for f in inputs:
            known = self.frames.setdefault(f.lineage, f)
            if known is not f and f.lineage not in self.invocations and not known.df.sameSemantics(f.df):
                raise InputValidationError(f"two different inputs are called {f.lineage}")
        self.invocations[output.lineage] = Invocation(kernel, tuple(f.lineage for f in inputs), output.lineage, kernel.label)

    def __enter__(self):
        self._token = _trackers.set((*_trackers.get(), self))
        return self

    def __exit__(self, *error):
        _trackers.reset(self._token)


def record(kernel, inputs, output):
    for tracker in _trackers.get():
        tracker.record(kernel, inputs, output)
    return output


@contextmanager
def no_tracking():
    token = _trackers.set(())
    try:
        yield
    finally:
        _trackers.reset(token)
