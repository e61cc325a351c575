"""Name merging, nearest unused keys, steps and loops, against definitions."""

from __future__ import annotations

import random

import pytest

from evisim.steps import Steps, naming_loop


def test_nearest_unused_equals_the_sequential_rule(spark):
    from evisim.operators.matching import nearest_unused

    r = random.Random(3)
    ref = [(g, i, r.randrange(6000)) for g in range(3) for i in range(60)]
    tgt = [(g, 1000 + i, r.randrange(6000)) for g in range(3) for i in range(40)]
    want = set()
    for g in range(3):
        free = sorted((a, t) for h, t, a in tgt if h == g)
        for a, i in sorted((a, i) for h, i, a in ref if h == g):
            near = [(abs(a - b), n) for n, (b, _) in enumerate(free) if abs(a - b) < 256]
            if near:
                want.add((g, i, free.pop(min(near)[1])[1]))
    got = nearest_unused(spark.createDataFrame(ref, "group long, r long, at long"), spark.createDataFrame(tgt, "group long, t long, at long"))
    assert {tuple(x) for x in got.collect()} == want and len(want) > 60
    assert nearest_unused(spark.createDataFrame([], "group long, r long, at long"), spark.createDataFrame(tgt, "group long, t long, at long")).count() == 0


def test_merge_branches(spark):
    from evisim.operators.names import merge_names

    rows = [
        (1, "alpha", "a", 0.8, 1), (1, "alpha", "b", 0.7, 2), (1, "beta", "c", 0.99, 0),
        (2, "cycle_size_default", "a", 0.8, 1), (2, "cycle_size", "b", 0.6, 2), (2, "other", "c", 0.9, 3),
        (3, "send_msg", "a", 0.8, 1), (3, "transmit_packet", "b", 0.9, 2),
        (4, "one", "a", 0.6, 1), (4, "xyz", "b", 0.5, 2), (5, "low", "a", 0.2, 1),
    ]
    got = {r.symbol: (r.name, r.method) for r in merge_names(spark.createDataFrame(rows, "symbol long, name string, source string, confidence double, ord long"), {}).collect()}
    assert got == {1: ("alpha", "exact_multi"), 2: ("cycle_size", "partial"), 3: ("transmit_packet", "semantic"), 4: ("one", "single")}


def test_greedy_goes_on_to_the_end(spark):
    from evisim.operators.matching import greedy_two_sided

    n = 12  # a chain in which every round settles one pair
    pairs = [(k, k, float(2 * k)) for k in range(n)] + [(k, k + 1, float(2 * k + 1)) for k in range(n)]
    got = {(x.r, x.t) for x in greedy_two_sided(spark.createDataFrame(pairs, "r long, t long, score double")).collect()}
    used_r, used_t, want = set(), set(), set()
    for s, r, t in sorted(((-s, r, t) for r, t, s in pairs)):
        if r not in used_r and t not in used_t:
            want.add((r, t))
            used_r.add(r)
            used_t.add(t)
    assert got == want


def test_components_of_long_paths(spark):
    from evisim.operators.graph import min_label_components

    ids = list(range(2000))
    random.Random(5).shuffle(ids)
    edges = list(zip(ids, ids[1:])) + [(5000, 5000), (6001, 6000)]
    got = {x.node: x.component for x in min_label_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {k: 0 for k in range(2000)} | {5000: 5000, 6000: 6000, 6001: 6000}


def test_steps_run_in_order(spark):
    steps, ran = Steps(), []

    @steps.register("b", needs=["x"], makes=["y"])
    def b(held):
        ran.append("b")
        return {"y": held["x"].filter("id > 1")}

    @steps.register("a", needs=["raw"], makes=["x"])
    def a(held):
        ran.append("a")
        return {"x": held["raw"].filter("id > 0")}

    assert [s.name for s in steps.order(["raw"])] == ["a", "b"] and steps.run({"raw": spark.range(4)})["y"].count() == 2 and ran == ["a", "b"]
    with pytest.raises(ValueError, match="nothing makes"):
        steps.order()
    with pytest.raises(ValueError, match="twice"):
        steps.register("a")(a)
    steps.register("c", needs=["z"], makes=["w"])(a)
    steps.register("d", needs=["w"], makes=["z"])(a)
    with pytest.raises(ValueError, match="wait for one another"):
        steps.order(["raw"])


def test_naming_loop_ends_when_little_is_new(spark):
    from evisim.tables import written

    edges = spark.createDataFrame([(k, k + 1) for k in range(10)], "src long, dst long")
    seed = spark.createDataFrame([(0, "n")], "node long, name string")

    def onward(known, fresh):
        return fresh.join(edges, fresh["node"] == edges["src"]).select(edges["dst"].alias("node"), "name")

    known, news = naming_loop(seed, onward, written)
    assert news == [1, 1, 1] and known.count() == 4
    known, news = naming_loop(seed, onward, written, most=50)
    assert news == [1] * 10 + [0] and known.count() == 11
