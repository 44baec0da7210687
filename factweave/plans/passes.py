"""Named passes over a catalog of frames: registration, order by dependences, results kept until something changes."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Pass:
    """A function from the catalog to a frame, after the passes it needs."""

    name: str
    function: Callable[[dict[str, DataFrame]], DataFrame]
    needs: tuple[str, ...] = ()
    kind: str = "analysis"


@dataclass
class Engine:
    """Runs passes lazily. Results are frames, so an unused one costs nothing."""

    catalog: dict[str, DataFrame] = field(default_factory=dict)
    passes: dict[str, Pass] = field(default_factory=dict)
    done: dict[str, DataFrame] = field(default_factory=dict)

    def register(self, name: str, function, needs: Iterable[str] = (), kind: str = "analysis") -> None:
        """Add a pass; ValueError if the name is taken."""
        if name in self.passes:
            raise ValueError(f"there is a pass named {name}")
        self.passes[name] = Pass(name, function, tuple(needs), kind)

    def order(self, names: Iterable[str] | None = None) -> list[str]:
        """The passes with all they need, each after its needs; ties by name. KeyError for unknown ones, ValueError for cycles."""
        out: list[str] = []
        state: dict[str, int] = {}

        def visit(name: str) -> None:
            if state.get(name) == 2:
                return
            if state.get(name) == 1:
                raise ValueError(f"passes need each other: {name}")
            state[name] = 1
            for n in sorted(self.passes[name].needs):
                visit(n)
            state[name] = 2
            out.append(name)

        for name in sorted(self.passes) if names is None else names:
            visit(name)
        return out

    def run(self, names: Iterable[str] | None = None) -> dict[str, DataFrame]:
        """Results of the named passes, which work on the catalog and the results before them."""
        names = list(self.passes if names is None else names)
        for name in self.order(names):
            if name not in self.done:
                self.done[name] = self.passes[name].function({**self.catalog, **self.done})
        return {n: self.done[n] for n in names}

    def changed(self, name: str) -> set[str]:
        """Forget what depends on a catalog frame or pass that is new; the names that went."""
        gone: set[str] = set()
        again = True
        while again:
            more = {p.name for p in self.passes.values() if p.name not in gone and (p.name == name or name in p.needs or gone & set(p.needs))}
            again = bool(more)
            gone |= more
        for n in gone:
            self.done.pop(n, None)
        return gone


def standard(engine: Engine) -> Engine:
    """The passes over source files (catalog ``files``). Files are parsed once for all passes that follow."""
    from ..operators import callgraph, flow, rules
    from ..shared import written
    from ..sources import python

    add = engine.register
    add("nodes", lambda c: written(python.parse(c["files"])), kind="source")
    add("suppressions", lambda c: python.suppressions(c["files"]), kind="source")
    add("issues", lambda c: rules.suppressed(rules.run_rules(c["nodes"]), c["suppressions"])[0], ["nodes", "suppressions"])
    add("metrics", lambda c: rules.metrics(c["issues"]), ["issues"])
    add("call_graph", lambda c: callgraph.call_graph(c["nodes"]), ["nodes"])
    add("control_flow", lambda c: flow.edges(c["files"]), kind="source")
    add("dominance", lambda c: flow.dominance(c["files"]), ["control_flow"])
    add("control_dependence", lambda c: flow.control(c["files"]), ["dominance"])
    add("data_dependence", lambda c: flow.data(c["files"]), ["control_flow"])
    return engine
