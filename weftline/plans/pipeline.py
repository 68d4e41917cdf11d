"""A recorded graph of calls that is run with memory: only packets without a result are computed."""

from __future__ import annotations

from enum import Enum

from ..columns import META, q
from ..frame import TagFrame
from ..functions.hashing import row_hash
from ..functions.pods import PACKET, CachedPod, FunctionPod, WrappedPod
from .store import RecordStore
from .tracking import GraphTracker, no_tracking


class Mode(Enum):
    """Whether results are looked up and recorded, or everything is computed anew."""

    PRODUCTION = "production"
    DEVELOPMENT = "development"


class Node:
    def __init__(self, label, kernel, inputs, lineage):
        self.label, self.kernel, self.inputs, self.lineage = label, kernel, inputs, lineage
        self.frame: TagFrame | None = None

    @property
    def is_pod(self) -> bool:
        return isinstance(self.kernel, (FunctionPod, CachedPod, WrappedPod))

    @property
    def pod(self) -> FunctionPod:
        return self.kernel.pod if isinstance(self.kernel, (CachedPod, WrappedPod)) else self.kernel


class Pipeline(GraphTracker):
    def __init__(self, name: str, store: RecordStore, results: RecordStore | None = None, auto_compile: bool = True):
        super().__init__()
        self.name, self.store, self.results_store, self.auto_compile = name, store, results or store, auto_compile
        self.nodes: dict[str, Node] = {}
        self.mode = "production"

    def __exit__(self, *error):
        super().__exit__(*error)
        if self.auto_compile and not any(error):
            self.compile()

    def compile(self) -> None:
        """Nodes in topological order; equal labels are numbered."""
        self.nodes.clear()
        count: dict[str, int] = {}
        for call in self.invocations.values():
            count[call.label] = count.get(call.label, 0) + 1
        seen: dict[str, int] = {}
        for call in self.invocations.values():
            label = call.label
            if count[label] > 1:
                seen[label] = seen.get(label, 0) + 1
                label = f"{label}_{seen[label]}"
            self.nodes[label] = Node(label, call.kernel, call.inputs, call.output)

    def set_mode(self, mode: str) -> None:
        self.mode = Mode(mode).value

    def rename(self, old: str, new: str) -> None:
        if new in self.nodes:
            raise KeyError(f"{new} exists")
        node = self.nodes[old]
        node.label = new
        self.nodes = {new if k == old else k: n for k, n in self.nodes.items()}

    def __getattr__(self, name):
        nodes = self.__dict__.get("nodes", {})
        if name in nodes:
            return nodes[name]
        raise AttributeError(name)

    def __dir__(self):
        return [*super().__dir__(), *self.nodes]

    def path(self, node: Node) -> tuple[str, ...]:
        return (self.name, node.label, node.lineage)

    def run(self, *predicates, sources: dict[str, TagFrame] | None = None, record_kernels: bool = False, only: str | None = None, **constraints) -> None:
        """Run all nodes. ``sources`` replaces input frames by lineage (new data of
        the same source); predicates restrict the inputs of pods (of the node labelled
        ``only``, if given) before they compute."""
        frames = dict(self.frames) | (sources or {})
        with no_tracking():
            for node in self.nodes.values():
                inputs = [frames[i] for i in node.inputs]
                if node.is_pod:
                    if (predicates or constraints) and only in (None, node.label):
                        inputs = [f.filter(*predicates, **constraints) for f in inputs]
                    pod = node.pod
                    cached = CachedPod(pod, self.results_store, (self.name, "_results"), self.mode)
                    out = cached(*inputs)
                    if self.mode == "production" and pod.active:
                        self.add_tag_records(node, pod, pod.joined(inputs))
                else:
                    out = node.kernel(*inputs)
                    if record_kernels:
                        df = out.as_df(system_tags=True)
                        self.store.add_records(self.path(node), df.select(row_hash(df, df.columns, 64).alias("__row"), "*"), "__row")
                node.frame = out.derived(node.lineage)
                frames[node.lineage] = node.frame
            self.store.flush()

    def add_tag_records(self, node: Node, pod: FunctionPod, frame: TagFrame) -> None:
        """Tags of every row with the hash of its packet: rows whose packet was known too."""
        hashed = pod.hashed(frame).df
        tags = (*frame.roles.tags, *frame.roles.system_tags)
        rows = hashed.select(row_hash(hashed, (*tags, PACKET), 64).alias(META + "entry"), *map(q, tags), PACKET)
        self.store.add_records(self.path(node), rows, META + "entry")

    def records(self, label: str):
        """All recorded rows of a pod node: tag records joined with results."""
        node = self.nodes[label]
        pod = node.pod
        tags = self.store.all_records(self.path(node))
        results = CachedPod(pod, self.results_store, (self.name, "_results")).stored()
        if tags is None or results is None:
            return None
        return tags.join(results, PACKET).drop(PACKET)

    def to_dot(self) -> str:
        """The graph in Graphviz's language."""
        made = {n.lineage: n.label for n in self.nodes.values()}
        lines = [f'  "{n.label}" [shape={"box" if n.is_pod else "ellipse"}];' for n in self.nodes.values()]
        lines += [f'  "{made.get(i, "source " + i[:8])}" -> "{n.label}";' for n in self.nodes.values() for i in n.inputs]
        return "\n".join([f'digraph "{self.name}" {{', *lines, "}"])


