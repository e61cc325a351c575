"""The ten registered queries themselves, on the smallest tables: against their SQL, or their contract by brute force."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from tests.llm.test_operators import WORD, slow_components, slow_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def run(spark, name):
    return entry.queries()[name](spark, SF)


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op4_quality_rules", "op7_mixing"])
def test_query_matches_sql(spark, con, name):
    df = run(spark, name)
    cols = sorted(df.columns)
    rel = con.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in rel.description].index(c) for c in cols]
    want = sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*cols).collect()) == want


def test_op1(spark, con):
    marks = r"\### Assistant: </turn> ok"
    turns = defaultdict(list)
    for c, _, role, text in con.execute("SELECT conv_id, turn, role, text FROM conversations ORDER BY conv_id, turn").fetchall():
        turns[c].append((role or "", text or ""))
    turns[-7] = [("user", marks), ("assistant", marks)]
    got = {r.conv_id: r for r in run(spark, "op1_chat_windows").collect()}
    assert set(got) == set(turns)
    for c, t in turns.items():
        loss = "".join(x for role, x in t if role == "assistant")
        assert (got[c].n_turns, got[c].loss_chars) == (len(t), len(loss))
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest() and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_op3(spark, con):
    docs = con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    fps = [slow_fingerprint(t) for _, t in docs]
    label = slow_components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    want = {(docs[k][0], f"{fps[k]:016x}", docs[label[k]][0]) for k in range(len(docs))}
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in run(spark, "op3_simhash").collect()} == want


def test_op5_and_op6_and_op9(spark, con):
    docs = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    pii = {r.doc_id: r for r in run(spark, "op5_pii_pseudonyms").collect()}
    assert set(pii) == set(docs) and sum(r.n_pii for r in pii.values()) > 0
    assert all((r.text != docs[i]) == (r.n_pii > 0) for i, r in pii.items())
    lines = {r.doc_id: r for r in run(spark, "op6_fuzzy_lines").collect()}
    assert set(lines) == set(docs) and sum(r.n_removed for r in lines.values()) > 0
    for i, r in lines.items():
        rest = iter((docs[i] or "").split("\n"))
        assert r.n_lines - r.n_removed == (len(r.text.split("\n")) if r.n_removed < r.n_lines else 0)
        assert all(any(x == y for y in rest) for x in (r.text.split("\n") if r.n_removed < r.n_lines else ()))
    tokens = {r.doc_id: r for r in run(spark, "op9_token_counts").collect()}
    assert all(tokens[i].n_words == len(WORD.findall(t or "")) <= tokens[i].n_tokens for i, t in docs.items())


def test_op8(spark, con):
    from tokenizers import Tokenizer

    from evisim.llm.queries import tokenizer_path

    tk = Tokenizer.from_file(tokenizer_path(spark))
    want, total = {}, 0
    for i, t in con.execute("SELECT doc_id, text FROM documents").fetchall():
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        for k in range(-(-len(ids) // 4096)):
            part = np.array(ids[4096 * k : 4096 * (k + 1)], "<u4")
            want[i, k] = (4096 * k, len(part), zlib.crc32(part.tobytes()))
    rows = run(spark, "op8_packing").collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0] + [n for _, n in parts])[:-1]) and sum(n for _, n in parts) <= 4096
    assert len(seqs) <= 1.03 * -(-total // 4096)


def test_op10(spark, con):
    pages = con.execute("SELECT page_id, coalesce(html, '') FROM pages").fetchall()
    last = defaultdict(int)
    for i, h in pages:
        last[h] = max(last[h], i)
    want = {(i, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if last[h] == i else "revisit", None if last[h] == i else last[h]) for i, h in pages}
    assert {tuple(r) for r in run(spark, "op10_warc_bundles").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()} == want
