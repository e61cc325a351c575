"""Operators whose cost grew as the square of a block: results against definitions, and plans without the step that grew."""

from __future__ import annotations

import random
import re

from evisim.operators import graph, intervals, matching


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_nearest_looks_at_no_frame_to_the_end_and_crosses_cells(spark):
    r = random.Random(5)
    keys = [(g, r.randrange(-3000, 3000)) for g in range(2) for _ in range(150)]
    points = sorted({(g, r.randrange(-3200, 3200)) for g in range(2) for _ in range(600)})
    want = set()
    for g, p in points:
        near = min((abs(p - k), k > p, k) for h, k in keys if h == g)
        if near[0] <= 10:
            want.add((g, p, near[2]))
    for cell in (1, 2, 64):
        got = intervals.nearest(spark.createDataFrame(points, "group long, p long"), spark.createDataFrame(keys, "group long, key long"), 10, cell)
        assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100
        assert "unboundedfollowing" not in _plan(got).lower()


def test_nearest_unused_deals_whole_runs_by_cells(spark):
    r = random.Random(7)
    ref = [(g, i, r.randrange(9000)) for g in range(2) for i in range(120)] + [(2, i, 100_000 * i) for i in range(300)]
    tgt = [(g, 1000 + i, r.randrange(9000)) for g in range(2) for i in range(90)] + [(2, 1000 + i, 100_000 * i + 5) for i in range(300)]
    want = set()
    for g in range(3):
        free = sorted((a, t) for h, t, a in tgt if h == g)
        for a, i in sorted((a, i) for h, i, a in ref if h == g):
            near = [(abs(a - b), n) for n, (b, _) in enumerate(free) if abs(a - b) < 40]
            if near:
                want.add((g, i, free.pop(min(near)[1])[1]))
    for cell in (1, 3, 10_000):  # runs go over many cells, over a few, and lie in one together
        got = matching.nearest_unused(spark.createDataFrame(ref, "group long, r long, at long"), spark.createDataFrame(tgt, "group long, t long, at long"), 40, cell)
        assert {tuple(x) for x in got.collect()} == want and len(want) > 350


def test_masked_patterns_meet_by_their_literal_digits(spark):
    r = random.Random(9)
    digits = lambda n: "".join(r.choice("ab1") for _ in range(n))
    functions = [(i, digits(r.randrange(3, 8))) for i in range(200)] + [(500, None), (501, "")]
    patterns = [(i, "".join(r.choice("ab1..") for _ in range(r.randrange(0, 7))), 3, r.randrange(4, 8), r.choice([0.5, 0.6, 0.7, None])) for i in range(60)]
    want = set()
    for i, h in functions:
        fit = [((c is None, -(c or 0)), s, c) for s, p, low, high, c in patterns if h is not None and low <= len(h) <= high and re.match(p, h)]
        if fit:
            want.add((i, min(fit)[1], min(fit)[2]))
    got = intervals.masked_pattern_match(spark.createDataFrame(functions, "id long, hex string"), spark.createDataFrame(patterns, "sig long, pattern string, low int, high int, confidence double"))
    assert {tuple(x) for x in got.collect()} == want and len(want) > 100
    assert "rlike" not in _plan(got).lower()


def test_vectors_meet_in_blocks(spark, monkeypatch):
    import numpy as np

    from evisim.operators import vectors

    monkeypatch.setattr(vectors, "BLOCK", 16)  # several blocks on either side
    g = np.random.default_rng(4)
    v = g.integers(-2, 3, (90, 4)).astype(float)  # with equal scores, and perhaps zero vectors
    v[7] = 0
    df = spark.createDataFrame([(i, x.tolist(), f"{i % 4}") for i, x in enumerate(v)] + [(90, None, "1"), (91, [1.0, 2.0], "1")], "id long, v array<double>, hash string")
    bank = df.filter("id % 3 <> 1")
    unit = {i: x / np.linalg.norm(x) for i, x in enumerate(v) if x.any()}
    score = {(a, b): round(float(unit[a] @ unit[b]), 6) for a in unit for b in unit if b % 3 != 1 and a != b}
    best = lambda low, k, ok=lambda a, b: True: {(a, b, score[a, b]) for a in unit for b in sorted((b for b in unit if score.get((a, b), -2) >= low and ok(a, b)), key=lambda b: (-score[a, b], b))[:k]}
    for k in (1, 3):
        assert {tuple(x) for x in vectors.cosine_pairs(df, bank, 0.5, k=k).collect()} == best(0.5, k)
    assert {tuple(x) for x in vectors.cosine_pairs(df, bank, 0.5).collect()} == best(0.5, None)
    same = best(0.3, 1, lambda a, b: a % 4 == b % 4)
    rest = {x for x in best(0.6, 1) if x[0] not in {s[0] for s in same}}
    got = vectors.prefilter_match(df, bank, 0.3, 0.6).collect()
    assert {tuple(x)[:3] for x in got if x.confidence == 0.85} == same and {tuple(x)[:3] for x in got if x.confidence == 0.70} == rest


def test_banded_minhash_compares_equal_sets_once(spark):
    from hashlib import md5

    from evisim.operators import vectors

    r = random.Random(2)
    sets = [(i, sorted(r.sample("abcdefgh", r.randrange(0, 5)))) for i in range(120)]
    sig = {i: [min((int(md5(f"{n}:{t}".encode()).hexdigest()[:7], 16) for t in ts), default=None) for n in range(16)] for i, ts in sets}
    want = set()
    for q in range(0, 120, 5):
        found = []
        for t in sig:
            bands = any(sig[q][b : b + 4] == sig[t][b : b + 4] for b in range(0, 16, 4))
            if t != q and bands:
                found.append((-sum(x is not None and x == y for x, y in zip(sig[q], sig[t], strict=True)) / 16, t))
        want |= {(q, t, -a) for a, t in sorted(found)[:5]}
    df = spark.createDataFrame(sets, "id long, tokens array<string>")
    got = {tuple(x) for x in vectors.lsh_candidates(df, df.filter("id % 5 = 0")).collect()}
    assert got == want and len(want) > 60


def test_similar_sets_meet_by_their_first_members(spark, monkeypatch):
    from evisim.operators import dispatch

    r = random.Random(6)
    sets = {}
    for i in range(260):
        old = list(sets.values())
        s = set(r.sample(range(14), r.randrange(1, 8))) if i < 60 or r.random() < 0.4 else {x for x in r.choice(old)[2] if r.random() < 0.9} | ({r.randrange(14)} if r.random() < 0.4 else set())
        sets[i] = (i % 2, r.choice([0.1, 0.5, 0.9, 0.9, None]), s or {1})
        if i % 17 == 0:
            sets[i][2].add(None)
    gone = set()
    for i, (p, c, s) in sets.items():
        for o, (q, d, t) in sets.items():
            if p == q and i != o and c is not None and d is not None and (d > c or (d == c and o < i)):
                both = len((s & t) - {None})
                if both > 0.70 * (len(s) + len(t) - both):
                    gone.add(i)
    df = spark.createDataFrame([(i, p, c, x) for i, (p, c, s) in sets.items() for x in s], "id long, pattern int, confidence double, member int")
    for few in (2, 50):  # blocks that are cut to their end, and pairs
        monkeypatch.setattr(dispatch, "FEW", few)
        assert {x.id for x in dispatch.drop_similar(df).select("id").distinct().collect()} == set(sets) - gone
    assert 40 < len(gone) < 240


def test_names_are_compared_once_for_all_their_pairs(spark, tmp_path):
    from evisim.plans import text

    parts = [(i, "ab cd" if i % 3 else None, "b", 1) for i in range(6)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = text.overlap(spark, str(tmp_path))
    assert "array_intersect" not in _plan(got)
    found = {(x.r, x.t): x.overlap for x in got.collect()}
    assert set(found) == {(a, b) for b in range(6) for a in range(b)}
    assert found[1, 2] == 1.0 and found[1, 5] == round(5 / 7, 6) and found[0, 1] is None


def test_writers_and_readers_send_no_table_of_calls(spark, tmp_path):
    r = random.Random(15)
    acc = [(r.choice([None, *range(40)]), r.choice([None, *range(30)]), r.choice(["r", "w", "x", None])) for _ in range(600)]
    acc += [(100, i, "w" if i % 2 else "r") for i in range(21)] + [(101, i, "w" if i % 2 else "r") for i in range(20)]
    calls = [(r.choice([None, *range(30)]), r.choice([None, *range(30)])) for _ in range(120)]
    e, want = set(calls), set()
    called = {b: {a for a, d in e if d == b and a is not None} for b in range(30)}
    for f in {a[0] for a in acc} - {None}:
        mine = {a for a in acc if a[0] == f}
        if len(mine) > 20:
            continue
        for w in {x for _, x, k in mine if k == "w"} - {None}:
            for q in {x for _, x, k in mine if k == "r"} - {None, w}:
                want.add((w, q, f, round(0.45 + 0.15 * bool(called[w] & called[q]) + 0.2 * ((w, q) in e) + 0.1 * ((q, w) in e), 6)))
    got = graph.writer_reader_edges(spark.createDataFrame(acc, "field long, func long, kind string"), spark.createDataFrame(calls, "src long, dst long"), 20)
    rows = [(*x[:3], round(x[3], 6)) for x in got.collect()]
    assert sorted(rows) == sorted(want) and len({x[3] for x in want}) > 4 and any(x[2] == 101 for x in want) and not any(x[2] == 100 for x in want)
    # Files of a few MB hold calls of hundreds: their planned size isn't trusted.
    spark.range(500).selectExpr("id % 50 AS field", "id AS func", "if(id % 2 = 0, 'w', 'r') AS kind").write.parquet(f"{tmp_path}/a")
    spark.range(100).selectExpr("id AS src", "id + 1 AS dst").write.parquet(f"{tmp_path}/c")
    assert "broadcasthashjoin" not in _plan(graph.writer_reader_edges(spark.read.parquet(f"{tmp_path}/a"), spark.read.parquet(f"{tmp_path}/c"))).lower()
