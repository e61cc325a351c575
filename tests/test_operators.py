"""Operators on small tables at their boundaries: thresholds, ties, empty inputs, nulls, cycles."""

from __future__ import annotations

import json
import math
import struct

import pytest
from pyspark.sql import functions as F

from evisim.functions import exprs as ex
from evisim.operators import evidence as ev, graph, intervals, ir, matching as m, metrics as mt, text as tx, vectors as vx
from evisim.sources import readers, writers
from evisim.streaming import events


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols or df.columns) for r in df.collect())


def test_noisy_or_caps(spark):
    e = spark.createDataFrame(
        [("f", "A ", "structural", 0.4), ("f", "a", "structural", 0.4), ("g", "b", "constant", 0.6), ("g", "b", "constant", 0.6), ("h", "c", "api", 0.99), ("h", "c", "api", 0.99), ("i", "d", "structural", 0.9)],
        "function string, name string, method string, confidence double",
    )
    assert {r.function: r.confidence for r in ev.noisy_or(e).collect()} == {"f": 0.5, "g": 0.69, "h": 0.98, "i": 0.9}
    assert ev.noisy_or(e.limit(0)).count() == 0


def test_dempster_shafer_is_noisy_or_with_conflict(spark):
    e = spark.createDataFrame([("s", "x", "a", 0.5), ("s", "x", "b", 0.5), ("s", "y", "a", 0.3), ("t", "z", "a", 0.999), ("t", "z", "b", 0.9)], "symbol string, hypothesis string, source string, mass double")
    got = {r.symbol: r for r in ev.dempster_shafer(e).collect()}
    assert got["s"].hypothesis == "x" and got["s"].belief == 0.75 and got["s"].agreement == 2 and math.isclose(got["s"].conflict, 0.4)
    assert got["t"].belief == 0.98 and got["t"].conflict == 0.0


def test_tier_boundaries(spark):
    df = spark.createDataFrame([(0.995, 2, 0, 0.3), (0.995, 1, 0, 0.3), (0.85, 1, 1, 0.0), (0.85, 1, 2, 0.0), (0.5, 1, 0, 0.0), (0.4999, 1, 0, 0.0)], "confidence double, n_methods int, negatives int, consistency double")
    assert [r.t for r in df.select(ev.tier().alias("t")).collect()] == ["CONFIRMED", "HIGH", "HIGH", "MEDIUM", "MEDIUM", "LOW"]


def test_unique_key_match(spark):
    ref = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "c"), (5, None)], "id long, k string")
    tgt = spark.createDataFrame([(11, "a"), (12, "b"), (13, "b"), (14, "c"), (15, None)], "id long, k string")
    assert rows(m.unique_key_match(ref, tgt, "k")) == [(1, 11, 0.95), (2, 12, 0.80)]
    assert m.unique_key_match(ref.limit(0), tgt, "k").count() == 0


def test_jaccard_at_one_half(spark):
    a = [(1, t) for t in "wxyz"] + [(2, t) for t in "pq"] + [(3, "w")]
    b = [(9, t) for t in "wxy"] + [(8, t) for t in "pqrs"]
    got = m.jaccard_match(spark.createDataFrame(a, "id long, token string"), spark.createDataFrame(b, "id long, token string"))
    assert rows(got, "r", "t", "jaccard") == [(1, 9, 0.75), (2, 8, 0.5)]


def test_size_tolerance_bounds(spark):
    f = lambda data: spark.createDataFrame(data, "id long, size int, param_count int, return_type string")
    got = rows(m.size_tolerance_match(f([(1, 100, 1, "i"), (2, 1000, 1, "i"), (3, 50, 2, "v"), (4, 50, 2, "v")]), f([(11, 90, 1, "i"), (12, 899, 1, "i"), (13, 50, 2, "v")])), "r", "t", "confidence")
    assert got == [(1, 11, 0.702)]  # 899 of 1000 is below the tolerance, 3 and 4 are ambiguous


def test_two_sided_greedy_equals_the_loop(spark):
    import random

    r = random.Random(4)
    pairs = [(a, b + 100, r.randrange(20) / 10) for a in range(12) for b in range(12) if r.random() < 0.5]
    used_r, used_t, want = set(), set(), []
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in used_r and b not in used_t:
            used_r.add(a), used_t.add(b), want.append((a, b, s))
    got = m.greedy_two_sided(spark.createDataFrame(pairs, "r long, t long, score double"), graph.checkpointed)
    assert rows(got) == sorted(want)


def test_intervals(spark):
    spans = spark.createDataFrame([(0, 1, 10, 20), (0, 2, 30, 40)], "group int, id long, start long, stop long")
    pts = spark.createDataFrame([(0, 9), (0, 10), (0, 19), (0, 20), (0, 35)], "group int, p long")
    assert rows(intervals.containment(pts, spans), "p", "id") == [(10, 1), (19, 1), (35, 2)]
    keys = spark.createDataFrame([(0, 10), (0, 20)], "group int, key long")
    near = intervals.nearest(spark.createDataFrame([(0, 15), (0, 16), (0, 5), (0, 31)], "group int, p long"), keys, 10)
    assert rows(near, "p", "key") == [(5, 10), (15, 10), (16, 20)]
    band = intervals.band_join(spark.createDataFrame([(100,)], "a long"), spark.createDataFrame([(b,) for b in (49, 50, 100, 150, 151)], "b long"), 50)
    assert rows(band, "b") == [(50,), (100,), (150,)]
    empty = intervals.prefix_lookup(spark.createDataFrame([("abc",)], "key string"), spark.createDataFrame([("",), ("ab",)], "prefix string"))
    assert rows(empty) == [("ab", "abc")]


def test_scalars(spark):
    df = spark.createDataFrame([("m_fooBar_", "FUN_0040", [1.0, 2.0], [2.0, 4.0], [0.0])], "a string, b string, v array<double>, w array<double>, z array<double>")
    r = df.select(
        ex.normalize_name(F.col("a")).alias("n"), ex.auto_name(F.col("b")).alias("auto"), ex.cosine(F.col("v"), F.col("w")).alias("c"), ex.cosine(F.col("v"), F.col("z")).alias("zero"),
        ex.partial_overlap(F.lit("read"), F.lit("read_file")).alias("p"), ex.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("j"), ex.size_ratio(F.lit(0), F.lit(0)).alias("s"),
    ).first()
    assert (r.n, r.auto, round(r.c, 9), r.zero, r.p, r.j, r.s) == ("foo_bar", True, 1.0, 0.0, 4 / 9, 0.0, 1.0)


def test_vectors(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0], "h"), (2, [0.0, 0.0], "h"), (3, [0.6, 0.8], "g")], "id long, v array<double>, hash string")
    t = spark.createDataFrame([(11, [1.0, 0.0], "h"), (12, [0.8, 0.6], "g")], "id long, v array<double>, hash string")
    assert rows(vx.cosine_best(q, t), "r", "t") == [(1, 11), (3, 12)]
    assert rows(vx.margin_topk(vx.cosine_pairs(q, t, 0.5)), "r", "t") == [(1, 11), (1, 12), (3, 11), (3, 12)]
    assert rows(vx.prefilter_match(q, t), "r", "confidence") == [(1, 0.85), (3, 0.85)]


def test_graph_shapes(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 5), (6, 7)], "src long, dst long")
    assert dict(rows(graph.strong_components(e))) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7}
    assert dict(rows(graph.min_label_components(e))) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 6}
    paths = {tuple(p) for (_, p, _) in rows(graph.trace_paths(e, spark.createDataFrame([(1,)], "node long"), 10))}
    assert paths == {(1,), (1, 2), (1, 2, 3), (1, 2, 3, 4), (1, 2, 3, 4, 5)}
    with pytest.raises(ValueError):
        graph.longest_path(spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long"), most=5)


def test_hint_propagation_has_one_hop(spark):
    e = spark.createDataFrame([("a", "b"), ("c", "a")], "src string, dst string")
    s = spark.createDataFrame([("b", 0.9), ("c", 0.2)], "node string, confidence double")
    assert {r.node: (round(r.confidence, 6), r.origin) for r in graph.hint_propagation(e, s).collect()} == {"a": (0.27, "caller"), "b": (0.9, "seed"), "c": (0.2, "seed")}


def test_entropy_and_nesting(spark):
    df = spark.createDataFrame([("",), ("aaaa",), ("ab",), ("{(a)}{",)], "t string")
    got = [(round(r.e, 9), r.n) for r in df.select(tx.entropy(F.col("t")).alias("e"), tx.nesting(F.col("t")).alias("n")).collect()]
    assert got[0] == (0.0, 0) and got[1] == (0.0, 0) and got[2] == (1.0, 0) and got[3][1] == 2


def test_metrics(spark):
    s = spark.createDataFrame([(0.9, 1), (0.3, 0), (0.31, 1), (0.95, 0)], "prob double, correct int")
    r = mt.accept_stats(s).first()
    assert (r.accepted, r.rejected, r.abstained, r.precision) == (2, 1, 1, 0.5)
    assert mt.fpr_budget(0.5, 1.0, 0.5) == 1.0
    gate = mt.regression_gate(spark.createDataFrame([("a", 0.94), ("b", 0.95), ("c", 0.9), ("d", 1.0)], "metric string, value double"), spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "metric string, value double"))
    assert dict(rows(gate, "metric", "status")) == {"a": "warn", "b": "warn", "c": "fail", "d": "new"}
    cal = spark.createDataFrame([(x / 10, int(x > 5)) for x in range(10)] * 3, "score double, label int")
    a, _ = mt.platt_fit(cal, iterations=30, rate=1.0)
    assert a > 1.0


def test_struct_aggregates(spark):
    acc = spark.createDataFrame([("v", 0, 4), ("v", 0, 8), ("v", 8, 4), ("v", 16, 4), ("w", 0, 4), ("w", 2, 4), ("w", 12, 1)], "var string, offset long, width long")
    assert {r.var: (r.layout, r.size, r.aligned) for r in ir.struct_layout(acc).collect()} == {"v": ("0:8,8:4,16:4", 20, 24), "w": ("0:4,2:4,12:1", 13, 16)}
    assert rows(ir.stride(acc)) == [("v", 8, 3)]
    assert {r.var: (r.overlaps, r.padding) for r in ir.overlap_and_padding(acc.filter("var = 'w'")).collect()} == {"w": (1, 6)}


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"functions": [{"entry_point": "0x10", "name": "f", "body_size": 7}, {"name": ""}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"address": "20", "name": "g", "size": 9, "is_thunk": True}]))
    got = rows(readers.read_functions(spark, str(tmp_path / "*.json")), "addr", "name", "size", "return_type")
    assert got == [(16, "f", 7, "?"), (32, "g", 9, "?")]
    (tmp_path / "p.jsonl").write_text('{"n":"f","a":"10","ops":[["COPY","r1","[\\"c1\\"]"],["ADD","r2","[\\"r1\\",\\"c2\\"]"]]}\nbroken\n')
    ops = readers.pcode_ops(readers.read_jsonl(spark, str(tmp_path / "p.jsonl")).filter("n IS NOT NULL")).collect()
    assert [(o.seq, o.mnemonic, o.output, o.inputs) for o in ops] == [(0, "COPY", "r1", ["c1"]), (1, "ADD", "r2", ["r1", "c2"])]
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin/x").write_bytes(b"\x7fELF\x00\x01hello\x00\xffab\x00world!")
    assert rows(readers.read_strings(spark, str(tmp_path / "bin")), "value") == [("hello",), ("world!",)]
    assert readers.read_kinds(spark, str(tmp_path / "bin")).first().kind == "elf"
    (tmp_path / "s.pat").write_text("5589E5..8B 04 ABCD 0020 :0000 _foo\n5589 00 0000 0002 :0000 _foo\n---\n")
    s = readers.read_signatures(spark, str(tmp_path / "s.pat")).first()
    assert bytes(s.pattern) == bytes.fromhex("5589E5008B") and bytes(s.mask) == bytes.fromhex("FFFFFF00FF") and s["size"] == 5
    (tmp_path / "n.db").write_bytes(b"NGDB" + struct.pack("<I", 1) + struct.pack("<12sII", b"0" * 12, 3, 4))
    assert rows(readers.read_ngram_table(spark, str(tmp_path / "n.db"))) == [("30" * 12, 3, 4)]
    dump = spark.createDataFrame([("f", 0, "head"), ("f", 1, "0x1: DW_TAG_subprogram"), ("f", 2, ' DW_AT_name ("main")'), ("f", 3, " DW_AT_low_pc (0x40)"), ("f", 4, "0x2: DW_TAG_variable"), ("f", 5, ' DW_AT_name ("x")')], "file string, line int, value string")
    assert rows(readers.debug_entries(dump), "entry", "tag", "name") == [(1, "DW_TAG_subprogram", "main"), (2, "DW_TAG_variable", "x")]


def test_writers(spark, tmp_path):
    res = spark.createDataFrame([("r1", "error", "bad", "a.c"), ("r0", "note", "meh", "b.c")], "rule string, level string, message string, uri string")
    log = json.loads(writers.sarif(res, "t").first().sarif)
    assert log["version"] == "2.1.0" and [r["id"] for r in log["runs"][0]["tool"]["driver"]["rules"]] == ["r0", "r1"] and len(log["runs"][0]["results"]) == 2
    assert "| r0 |" in writers.report({"x": res.select("rule")}) and json.loads(writers.report({"x": res}, "json"))["x"]["more"] is False
    assert "<td>r1</td>" in writers.report({"x": res.select("rule")}, "html")
    old = spark.createDataFrame([("a", 3), ("b", 9), ("c", 5)], "key string, mtime int")
    assert rows(writers.evict(old, 2), "key") == [("a",)]
    writers.write_json(res, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    data = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    out = events.run_to_table(events.tumbling(events.read_stream(spark, "/root/testdata/sf0.001", "events.parquet*")), str(tmp_path / "s"))
    assert rows(out) == rows(events.tumbling(data))
    twice = data.unionByName(data)
    assert events.first_of(twice).count() == data.count()


def test_arrow_functions(spark):
    from evisim.operators import arrow_udfs as au

    assert au.split_arguments('f(a, g(b, c), "x, )", [1, 2])') == ["a", "g(b, c)", '"x, )"', "[1, 2]"]
    assert au.split_arguments("f()") == [] == au.split_arguments("none") == au.split_arguments("f(a")
    df = spark.createDataFrame([(1, "ab abc xab"), (2, None)], "id long, t string")
    assert rows(au.replace_words(df, "t", {"ab": "abc", "abc": "z"}).filter("t IS NOT NULL")) == [(1, "abc z xab")]
    assert rows(au.find_words(df, "id", "t", ["abc", "xa"])) == [(1, "abc", 3)]
    assert au.top_level_statements("let a = {b: 1};function f(){ return ';' } g()") == ["let a = {b: 1}", ";", "function f(){ return ';' }", "g()"]
    assert au.demangle_name("_ZN3foo3barE") == "foo::bar" and au.demangle_name("_Z3addii") == "add" and au.demangle_name("main") is None
    js = spark.createDataFrame([("p", "a();b();c();")], "path string, code string")
    assert [r.code for r in au.chunked_scripts(js, 8).collect()] == ["a();\nb();", "c();"]


def test_dominators_and_loops():
    from evisim.operators.arrow_udfs import dominators_of, embeds, loops_of

    edges = [(1, 2), (2, 3), (3, 2), (2, 4), (1, 4), (4, 5), (5, 4), (9, 5)]
    assert dominators_of(edges, 1) == {1: 1, 2: 1, 3: 2, 4: 1, 5: 4}
    assert loops_of(edges, 1) == {2: {2, 3}, 4: {4, 5}}
    assert embeds([(1, 2), (2, 1)], edges) is True and embeds([(1, 2), (2, 3), (3, 1)], edges) is False
    assert embeds([(a, b) for a in range(6) for b in range(6) if a != b], [(a, b) for a in range(9) for b in range(9) if a != b and (a + b) % 7], budget=5) is None


def test_dispatch_climbs_to_the_nearest_class(spark):
    from evisim.operators import dispatch as dp

    sites = spark.createDataFrame([("s1", "C", "m"), ("s2", "C", "x"), ("s3", "A", "n")], "site string, receiver string, selector string")
    methods = spark.createDataFrame([("B", "m", "B.m"), ("A", "m", "A.m"), ("A", "x", "A.x")], "cls string, selector string, func string")
    tree = spark.createDataFrame([("C", "B"), ("B", "A"), ("A", "C")], "child string, parent string")
    assert rows(dp.resolve_dispatch(sites, methods, tree, most=5)) == [("s1", "B.m", 1), ("s2", "A.x", 2)]
    e = spark.createDataFrame([("f", "s1"), ("f", "g")], "src string, dst string")
    r = spark.createDataFrame([("f", "s1", "B.m")], "src string, site string, target string")
    assert rows(dp.dispatched_edges(e, r)) == [("f", "B.m"), ("f", "g")]
    assert dp.affected(e, spark.createDataFrame([("g",)], "node string"), 10).count() == 2
    assert dp.affected(e, spark.createDataFrame([("g",)], "node string"), 2) is None
