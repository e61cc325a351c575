"""Steps that declare what they need and make, their order, and the naming loop that repeats some of them."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Step:
    name: str
    run: Callable[[Mapping[str, DataFrame]], Mapping[str, DataFrame]]
    needs: tuple[str, ...] = ()
    makes: tuple[str, ...] = ()


class Steps:
    """A registry of steps by name."""

    def __init__(self) -> None:
        self._by_name: dict[str, Step] = {}

    def register(self, name: str, needs: Sequence[str] = (), makes: Sequence[str] = ()) -> Callable:
        """A decorator; a name is registered once."""

        def add(run: Callable) -> Callable:
            if name in self._by_name:
                raise ValueError(f"step {name} is registered twice")
            self._by_name[name] = Step(name, run, tuple(needs), tuple(makes))
            return run

        return add

    def order(self, given: Sequence[str] = ()) -> list[Step]:
        """Steps after those that make what they need, by name where that leaves a choice. An artifact has one maker; cycles and missing makers are errors."""
        maker: dict[str, str] = {}
        for s in self._by_name.values():
            for a in s.makes:
                if a in maker or a in given:
                    raise ValueError(f"{a} has two makers")
                maker[a] = s.name
        waits: dict[str, set[str]] = {}
        for s in self._by_name.values():
            for a in s.needs:
                if a not in maker and a not in given:
                    raise ValueError(f"nothing makes {a}, which {s.name} needs")
            waits[s.name] = {maker[a] for a in s.needs if a in maker}
        ready, out = [n for n, w in waits.items() if not w], []
        heapq.heapify(ready)
        while ready:
            name = heapq.heappop(ready)
            out.append(self._by_name[name])
            for other, w in waits.items():
                if name in w:
                    w.discard(name)
                    if not w:
                        heapq.heappush(ready, other)
        if len(out) < len(waits):
            raise ValueError(f"steps wait for one another: {sorted(n for n, w in waits.items() if w)}")
        return out

    def run(self, artifacts: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        """All artifacts after every step ran in order. A step has to make what it says."""
        held = dict(artifacts)
        for s in self.order(list(artifacts)):
            made = s.run({a: held[a] for a in s.needs})
            if missing := set(s.makes) - set(made):
                raise ValueError(f"{s.name} didn't make {sorted(missing)}")
            held |= {a: made[a] for a in s.makes}
        return held


def naming_loop(named: DataFrame, iterate: Callable[[DataFrame, DataFrame], DataFrame], stage: Callable[[DataFrame], DataFrame], most: int = 3, enough: float = 0.01) -> tuple[DataFrame, list[int]]:
    """Repeats iterate(all names, names new since the last time) on named(node, name) until little is new; returns all names and how many were new each time.

    What is named already keeps its name. It ends when nothing is new, when new names are less than `enough` of those before, or
    after `most` times.
    """
    known = fresh = stage(named.select("node", "name"))
    before, news = known.count(), []
    for _ in range(most):
        found = iterate(known, fresh).select("node", "name").groupBy("node").agg({"name": "min"}).toDF("node", "name")
        fresh = stage(found.join(known.select("node"), "node", "left_anti"))
        n = fresh.count()
        news.append(n)
        if n == 0:
            break
        known = stage(known.unionByName(fresh))
        if before and n / before < enough:
            break
        before += n
    return known, news
