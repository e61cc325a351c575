"""The dealt operators against brute force, on small tables with nulls, empty texts, repeats, ties and clashing columns."""

from __future__ import annotations

import base64
import datetime
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs(spark, texts, sources=("b", "a", None)):
    return spark.createDataFrame([(i, t, "en", sources[i % len(sources)], len(t or "")) for i, t in enumerate(texts)], DOC)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    out = [prose(k, 20 + 17 * k % 300) for k in range(40)]
    out += [out[3], out[3], out[5] + " tail", None, "", "", "  \t\n", "Ünïcode wörds 漢字 ##", "a b c " * 400, "line one is here now\n" * 60, prose(99, 9000)]
    return out


# 1 chat


def chat_rows():
    r = random.Random(5)
    rows = [(7, 0, "system", "be <kind>"), (7, 1, "user", "### user: x</turn>"), (7, 2, "assistant", "\\</turn>\\\\"), (7, 3, "user", None), (7, 3, None, "tie"), (7, 4, "assistant", "")]
    rows += [(8, k, ("user", "assistant")[k % 2], prose(k, r.randrange(1, 120))) for k in range(60)]
    rows += [(None, 0, "user", "lost"), (9, 0, "odd: ~role</turn>", "a\nb"), (9, 0, "odd: ~role</turn>", "a\nb")]
    return rows


def test_chat_round_trip(spark):
    from evisim.llm.chat import format_chats, read_chats

    rows = chat_rows()
    r = random.Random(1)
    shuffled = r.sample(rows, len(rows))
    df = spark.createDataFrame(shuffled, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1))
    windows = format_chats(df, budget=200, history_tokens=80)
    held = windows.collect()
    got = {x.conv_id: x for x in read_chats(windows).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role, text))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort(key=lambda x: (x[0], x[1] is not None, x[1] or "", x[2] is not None, x[2] or ""))
        loss = "".join(t or "" for _, role, t in turns if role == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{ro or ''}\n{t or ''}\n" for _, ro, t in turns).encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].formatted_chars == sum(len(w.text) for w in held if w.conv_id == c)
    long = sorted((w for w in held if w.conv_id == 8), key=lambda w: w.window)
    assert len(long) > 5 and all(w.tokens <= 200 for w in long) and any(w.n_repeated for w in long)


def test_chat_keeps_system_turn_and_is_reversible(spark):
    from evisim.llm.chat import escape, format_chats, parse, unescape

    rows = [(1, 0, "system", "sys")] + [(1, k, ("user", "assistant")[k % 2], prose(k, 40)) for k in range(1, 20)]
    held = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=150).orderBy("window").collect()
    assert len(held) > 3
    for w in held[1:]:
        assert next(parse(w.text)) == (True, "system", "sys")
    for t in ["\\### Assistant: </turn> ok", "\\", "</turn", "### </turn>\n", "\\\\</turn>"]:
        assert unescape(escape(t)) == t and "</turn>" not in escape(t).replace("\\</turn>", "")
    assert format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def slow_windows(turns, budget, history_turns, history_tokens):
    """(new turns, repeated turns, tokens) by trying every end and every beginning of history."""
    out, start = [], 0
    cost = [len(t.split()) + 8 for _, t in turns]
    while start < len(turns):
        again, room = [], budget
        if start:
            if turns[0][0] == "system" and cost[0] <= 0.5 * budget and cost[0] + cost[start] <= room:
                again, room = [turns[0]], room - cost[0]
            low = max(start - history_turns, int(turns[0][0] == "system"))
            past = min((k for k in range(low, start) if sum(cost[k:start]) <= min(history_tokens, room - cost[start])), default=start)
            again, room = again + turns[past:start], room - sum(cost[past:start])
        end = max([start + 1] + [e for e in range(start + 1, len(turns) + 1) if sum(cost[start:e]) <= room])
        out.append((end - start, len(again), budget - room + sum(cost[start:end])))
        start = end
    return out


def test_chat_budget_is_hard(spark):
    from evisim.llm.chat import format_chats

    r, rows, convs = random.Random(12), [], {}
    for c in range(40):
        turns = [("system", prose(c, r.choice((3, 60, 120))))] if c % 3 else []
        turns += [(("user", "assistant")[k % 2], prose(100 * c + k, r.choice((1, 20, 60, 92, 140)))) for k in range(r.randrange(1, 25))]
        convs[c] = turns
        rows += [(c, k, role, text) for k, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # conversations go on from batch to batch
    try:
        got = format_chats(df, budget=100, history_turns=3, history_tokens=50).orderBy("conv_id", "window").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for c, turns in convs.items():
        assert [(w.n_new, w.n_repeated, w.tokens) for w in got if w.conv_id == c] == slow_windows(turns, 100, 3, 50)
    assert all(w.tokens <= 100 or (w.n_new == 1 and not w.n_repeated) for w in got) and any(w.n_repeated > 1 for w in got)


# 2 exact dedup


def test_exact_groups(spark, texts):
    from evisim.llm.exact_dedup import drop_repeats, exact_groups

    docs = make_docs(spark, texts).withColumn("digest", F.lit("clash")).withColumn("winner", F.lit(0))
    got = {r.doc_id: r for r in exact_groups(docs).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    assert len(got) == len(texts)
    for t, ids in groups.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(ids), len(ids), i == max(ids))
            assert bytes(got[i].digest).hex() == hashlib.sha256(t.encode()).hexdigest()
    assert sorted(r.doc_id for r in drop_repeats(docs).collect()) == sorted(max(x) for x in groups.values())
    twice = make_docs(spark, ["x", "y"]).unionByName(make_docs(spark, ["x", "z"]))
    assert sorted(r.text for r in drop_repeats(twice).collect()) == ["x", "y", "z"]
    assert exact_groups(make_docs(spark, ["x"]).limit(0)).count() == 0


def test_perfect_hash_is_minimal_and_checks_bytes(spark):
    from evisim.llm.exact_dedup import build_levels, slots_of

    r = np.random.default_rng(3)
    digests = r.integers(0, 256, (5000, 32), dtype=np.uint8)
    digests[1, 8:16] = digests[0, 8:16]  # no level tells these two apart
    levels, left = build_levels(digests)
    rest = [bytes(d) for d in digests[left]]
    assert sorted(slots_of(digests, levels, rest)) == list(range(5000)) and len(rest) == 2


def test_history_members_and_others(spark, texts):
    from evisim.llm.exact_dedup import assign, batches, build_index, digests_of, distinct_digests

    old, new = make_docs(spark, texts[:45]), make_docs(spark, texts[30:]).withColumn("doc_id", F.col("doc_id") + 1000)
    index, shards = build_index(distinct_digests(digests_of(old)))
    got = {bytes(r.digest): r for r in assign(digests_of(new), index, shards).collect()}
    held = defaultdict(list)
    for i, t in enumerate(texts[:45]):
        held[hashlib.sha256((t or "").encode()).digest()].append(i)
    for i, t in enumerate(texts[30:]):
        d = hashlib.sha256((t or "").encode()).digest()
        assert got[d].member == (d in held)
        assert got[d].winner == (max(held[d]) if d in held else max(1000 + k for k, u in enumerate(texts[30:]) if (u or "") == (t or "")))
    fresh = [n.count() for n, _ in batches(iter([old, new]))]
    assert sum(fresh) == len({t or "" for t in texts})


# 3 simhash


def slow_fingerprint(text, k=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(nodes, near):
    label = list(range(len(nodes)))
    changed = True
    while changed:
        changed = False
        for i in range(len(nodes)):
            for j in range(len(nodes)):
                if near(nodes[i], nodes[j]) and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_near_groups(spark, texts):
    from evisim.llm.simhash_dedup import drop_near, fingerprint_hex, near_groups

    base = prose(7, 3000).split()
    more = list(texts)
    for k in range(30):  # a chain of small edits
        base[50 * k] = f"w{k}"
        more.append(" ".join(base))
    docs = make_docs(spark, more).withColumn("fp", F.lit("clash"))
    got = {r.doc_id: (r.h, r.component_id) for r in near_groups(docs).withColumn("h", fingerprint_hex()).collect()}
    fps = [slow_fingerprint(t) for t in more]
    want = slow_components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in range(len(more))}
    assert len(set(want)) < len(more) - 20
    assert sorted(r.doc_id for r in drop_near(docs).collect()) == sorted(set(want))
    assert near_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("distance", "keys"), [(3, 64), (3, 3), (5, 50), (9, 20)])
def test_tree_links_keep_components(spark, distance, keys):
    from evisim.llm.components import components
    from evisim.llm.simhash_dedup import links
    from evisim.llm.staging import staged

    r = random.Random(distance)
    fps = {r.getrandbits(64) for _ in range(60)}
    for _ in range(160):
        f = r.choice(sorted(fps))
        for _ in range(r.randrange(1, distance + 3)):
            f ^= 1 << r.randrange(64)
        fps.add(f)
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    nodes = staged(spark.createDataFrame([(f,) for f in signed], "fp long"), "t")
    got = {x.node: x.root for x in components(links(nodes, distance, keys)).collect()}
    want = slow_components(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= distance)
    assert [got.get(f, f) for f in signed] == [signed[k] for k in want]


def test_links_with_more_blocks(spark, monkeypatch):
    from evisim.llm import blocks, simhash_dedup
    from evisim.llm.components import components
    from evisim.llm.staging import staged

    monkeypatch.setattr(simhash_dedup, "choices", lambda n, d: blocks.choices(1 << 33, d))
    assert len(blocks.choices(1 << 33, 3)) == 20
    r, fps = random.Random(2), []
    for _ in range(40):
        f = r.getrandbits(64)
        for _ in range(6):
            fps.append(f)
            for b in r.sample(range(64), r.randrange(1, 5)):
                f ^= 1 << b
    signed = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    got = {x.node: x.root for x in components(simhash_dedup.links(staged(spark.createDataFrame([(f,) for f in signed], "fp long"), "t"))).collect()}
    want = slow_components(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    assert [got.get(f, f) for f in signed] == [signed[k] for k in want] and len(set(want)) < len(signed)


def test_shard_search_prunes_without_loss():
    from evisim.llm.simhash_dedup import _links

    r = np.random.default_rng(1)
    fps = np.unique(np.concatenate([r.integers(0, 2**63, 1500).astype(np.uint64), (np.uint64(12345) ^ (np.uint64(1) << r.integers(0, 64, 900).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 900).astype(np.uint64)))]))
    label = _links(fps, np.ones(len(fps), bool), 3)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    want = np.arange(len(fps))
    while True:
        low = np.where(near, want[None, :], len(fps)).min(axis=1)
        if (low == want).all():
            break
        want = low
    assert len({*zip(label, want)}) == len(set(label)) == len(set(want))


# 4 quality


def slow_measures(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    tri = Counter(zip(w, w[1:], w[2:]))
    hit = {p for i in range(len(w) - 2) if tri[w[i], w[i + 1], w[i + 2]] > 1 for p in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_quality_ledger(spark, texts):
    from evisim.llm.quality import RULES, ablation, apply_policy, keep_good, ledger, policy_mask

    docs = make_docs(spark, texts).withColumn("kept", F.lit("clash")).withColumn("n_words", F.lit(-1))
    led = apply_policy(ledger(docs))
    got = {r.doc_id: r for r in led.collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow_measures(t)
        assert (r.bits & 1 != 0) == (r.n_words < 50) and (r.bits & 2 != 0) == (100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (r.bits & policy_mask("v2") == 0)
    rows = {r.rule: r for r in ablation(ledger(docs)).collect()}
    for rule in RULES:
        bits = [r.bits for r in got.values()]
        m = 1 << rule.bit
        assert rows[rule.name].n_fail == sum(b & m != 0 for b in bits) and rows[rule.name].n_only == sum(b == m for b in bits)
        assert rows[rule.name].n_kept_without == sum(b & ~m == 0 for b in bits)
    assert keep_good(docs).columns == docs.columns
    assert sorted(r.doc_id for r in keep_good(docs).collect()) == sorted(i for i, r in got.items() if r.kept)
    assert ledger(docs.limit(0)).count() == 0


# 5 personal data


def luhn(d):
    return sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(d[::-1])) % 10 == 0


def test_pseudonyms(spark):
    from evisim.llm.pii import pseudonymise

    rows = ["a 4111 1111 1111 1111 b", "4111111111111111.", "4111111111111112 v2.0 1.2.3", "+1 (017) 555-7713", "call +1 017 555 7713 now", "x 97.51.17.173, 300.1.1.1", "1987-02-28 2023-02-30 28.02.1987", "é.1@m.example.com", "DE89 3704 0044 0532 0130 00", "078-05-1120 000-12-3456", "t = " + "ab" * 20, None, "", "none here"]
    docs = spark.createDataFrame([(i, t, -1) for i, t in enumerate(rows)], "doc_id long, text string, n_pii int")
    out = {r.doc_id: r for r in pseudonymise(docs, "key").collect()}
    t = [out[i].text for i in range(len(rows))]
    assert [out[i].n_pii for i in range(len(rows))] == [1, 1, 0, 1, 1, 1, 2, 1, 1, 1, 1, 0, 0, 0]
    card = re.sub(r"\D", "", t[0])
    assert luhn(card) and card != "4" + "1" * 15 and t[1] == card + "." and re.fullmatch(r"a \d{4} \d{4} \d{4} \d{4} b", t[0])
    assert t[2] == rows[2] and t[11] is None and t[12:] == ["", "none here"]
    assert re.sub(r"\D", "", t[3]) == re.sub(r"\D", "", t[4]) and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", t[3]) and t[3] != rows[3]
    assert "97.51.17.173" not in t[5] and "300.1.1.1" in t[5]
    day = t[6].split()
    assert day[1] == "2023-02-30" and day[0] == "-".join(day[2].split(".")[::-1]) != "1987-02-28"
    assert "example.com" not in t[7]
    moved = t[8].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in moved[4:] + moved[:4])) % 97 == 1 and moved[:2] == "DE" and t[8] != rows[8]
    assert t[9].endswith("000-12-3456") and not t[9].startswith("078") | t[9].startswith("0785")
    assert len(t[10]) == len(rows[10]) and t[10] != rows[10]
    other = {r.doc_id: r.text for r in pseudonymise(docs, "other").collect()}
    assert other[0] != t[0]
    assert pseudonymise(docs.limit(0), "key").count() == 0


def test_values_in_their_usual_places(spark):
    from evisim.llm.pii import pseudonymise

    rows = ["on 12/25/1987 x", "25.12.1987", "03/14/1990 13/13/1990", "http://10.0.0.5/a", "10.0.0.0/8", "1987-02-28T10:00:00Z", "1987-02-28", "k " + "ab" * 150, "05/04/1990", "1990-04-05", "v1.2.3.4.5 10.0.0.256/8", "a " + "ab" * 149 + "cd"]
    out = [r.asDict() for r in pseudonymise(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), "key").orderBy("doc_id").collect()]
    t = [r["text"] for r in out]
    assert [r["n_pii"] for r in out] == [1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 1]
    m, d, y = t[0].split()[1].split("/")
    assert t[1] == f"{d}.{m}.{y}" != rows[1] and t[2].endswith(" 13/13/1990") and "03/14/1990" not in t[2]
    assert "10.0.0.5" not in t[3] and re.fullmatch(r"http://(?:\d+\.){3}\d+/a", t[3]) and re.fullmatch(r"(?:\d+\.){3}\d+/8", t[4]) and not t[4].startswith("10.0.0.0")
    assert t[5] == f"{t[6]}T10:00:00Z" and t[6] != rows[6]
    assert re.fullmatch(r"k [0-9a-f]{300}", t[7]) and "abababab" not in t[7] and len(set(re.findall(".{64}", t[7][2:]))) > 1 and t[7][2:] != t[11][2:]
    assert t[8].split("/") == t[9].split("-")[::-1] and t[10] == rows[10]


def test_feistel_is_a_permutation(spark):
    from evisim.llm.pii import permute_digits, restore_digits

    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    out = df.withColumn("p", permute_digits("d", "k", "card")).withColumn("b", restore_digits("p", "k", "card")).collect()
    assert {r.p for r in out} == {r.d for r in out} and all(r.b == r.d and len(r.p) == 3 for r in out) and sum(r.p == r.d for r in out) < 20
    wide = spark.createDataFrame([("1234567890123456789",), ("00",), ("9" * 24,)], "d string").withColumn("p", permute_digits("d", "k", "x")).withColumn("b", restore_digits("p", "k", "x")).collect()
    assert all(r.b == r.d and len(r.p) == len(r.d) for r in wide)


class SlowPii:
    """Pseudonyms one value at a time, from the definition."""

    def __init__(self, key):
        self.key = key

    def prf(self, kind, size, r, half):
        return int(hashlib.sha256(f"{self.key}|{kind}|{size}|{r}|{half}".encode()).hexdigest()[:15], 16)

    def feistel(self, kind, a, b, na, nb, size):
        for r in range(1, 9):
            n = na if r % 2 else nb
            a, b = b, (a + self.prf(kind, size, r, b) % n) % n
        return a, b

    def digits(self, kind, d):
        u = len(d) // 2
        a, b = self.feistel(kind, int(d[:u] or 0), int(d[u:]), 10**u, 10 ** (len(d) - u), len(d))
        return f"{a:0{u}d}{b:0{len(d) - u}d}"

    def card(self, d):
        p = self.digits("card", d[:-1])
        return next(p + c for c in "0123456789" if luhn(p + c))

    def ssn(self, d):
        while True:
            d = self.digits("ssn", d)
            if d[:3] not in ("000", "666") and d < "9" and d[3:5] != "00" and d[5:] != "0000":
                return d

    def ip(self, o):
        a, b = self.feistel("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "32")
        return ".".join(str(x) for x in (a // 256, a % 256, b // 256, b % 256))

    def date(self, y, m, d):
        m0, mn, d0, dn = (1, 9) + ((1, 9) if d < 10 else (10, 22)) if m < 10 else (10, 3) + ((1, 9) if d < 10 else (10, 22))
        v = ((y - 1700) * mn + m - m0) * dn + d - d0
        while True:
            a, b = self.feistel("date", v // (20 * dn), v % (20 * dn), 20 * mn, 20 * dn, f"{m0}.{d0}")
            v = a * 20 * dn + b
            try:
                return datetime.date(v // (mn * dn) + 1700, v // dn % mn + m0, v % dn + d0)
            except ValueError:
                continue


def test_pseudonyms_equal_brute_force(spark):
    from evisim.llm.pii import KEY, pseudonymise

    r, slow, rows, want = random.Random(7), SlowPii("k|1"), [], []
    for _ in range(150):
        d = "".join(r.choice("0123456789") for _ in range(15))
        d += next(c for c in "0123456789" if luhn(d + c))
        rows.append(f"c {d}")
        want.append(f"c {slow.card(d)}")
        d = f"{r.randrange(1, 666):03d}{r.randrange(1, 100):02d}{r.randrange(1, 10000):04d}"
        n = slow.ssn(d)
        rows.append(f"{d[:3]}-{d[3:5]}-{d[5:]}")
        want.append(f"{n[:3]}-{n[3:5]}-{n[5:]}")
        o = [r.randrange(256) for _ in range(4)]
        rows.append(f"ip {o[0]}.{o[1]}.{o[2]}.{o[3]} x")
        want.append(f"ip {slow.ip(o)} x")
        day = datetime.date(1700, 1, 1) + datetime.timedelta(r.randrange(146_097))
        n = slow.date(day.year, day.month, day.day)
        rows.append(f"{day} {day:%d.%m.%Y} {day.day}/{day.month}/{day.year}")
        want.append(f"{n} {n:%d.%m.%Y} {n.day}/{n.month}/{n.year}")
        d = "".join(r.choice("0123456789") for _ in range(10))
        n = slow.digits("phone", d)
        rows.append(f"+49 {d[:3]} {d[3:6]} {d[6:]}")
        want.append(f"+49 {n[:3]} {n[3:6]} {n[6:]}")
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(rows)], f"doc_id long, text string, __pii int, {KEY} int")
    out = pseudonymise(docs, "k|1")
    plan = out._jdf.queryExecution().toString()
    got = [x.text for x in out.orderBy("doc_id").collect()]
    assert got == want and all(len(a) == len(b) for a, b in zip(rows, got, strict=True) if "ip" not in a)
    assert "k|1" not in plan and out.columns == ["doc_id", "text", "__pii", KEY, "n_pii"]
    with pytest.raises(ValueError):
        pseudonymise(docs, "")


def test_dates_are_permuted_within_their_width(spark):
    from evisim.llm.pii import pseudonymise

    days = [datetime.date(1992, 1, 1) + datetime.timedelta(k) for k in range(3000)]
    got = [x.text for x in pseudonymise(spark.createDataFrame([(i, str(d)) for i, d in enumerate(days)], "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    moved = [datetime.date.fromisoformat(x) for x in got]
    assert len(set(moved)) == len(days) and all((a.month < 10, a.day < 10) == (b.month < 10, b.day < 10) for a, b in zip(days, moved, strict=True))
    assert all(1700 <= d.year < 2100 for d in moved) and sum(a == b for a, b in zip(days, moved, strict=True)) < 5
    assert {(d.month, d.day) for d in moved} > {(2, 29), (12, 31)}


# 6 lines


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_fuzzy_lines(spark):
    from evisim.llm.line_dedup import drop_lines, edits

    r = random.Random(2)
    for _ in range(200):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(20))) for _ in range(2))
        assert edits(a, b, 99) == levenshtein(a, b) and (edits(a, b, 3) > 3) == (levenshtein(a, b) > 3)
    long = prose(1, 80)
    near = [long.replace(" ", f" q{k} ", 1) if k else long for k in range(4)]
    docs_text = [f"Short head\n{near[0]}\n{prose(2, 30)}", f"{near[0].upper()}!!\nShort head", f"{near[1]}\n\n{near[2]}", None, "", f"{prose(2, 30)}\n{prose(3, 12)}", near[3]]
    docs = make_docs(spark, docs_text).withColumn("n_removed", F.lit("clash"))
    norm = lambda s: re.sub(r"[\x00-/:-@\[-`{-\x7f]+", " ", s.lower()).strip(" ")
    occ = [(i, k, norm(line)) for i, t in enumerate(docs_text) if t is not None for k, line in enumerate(t.split("\n")) if len(norm(line).split()) >= 5]

    def fp(s):
        h = [xxhash.xxh64_intdigest(w, 42) for w in s.split()]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    def linked(a, b):
        return a == b or ((fp(a) ^ fp(b)).bit_count() <= 3 and 1 - levenshtein(a, b) / max(len(a), len(b)) >= 0.8)

    label = slow_components([o[2] for o in occ], linked)
    gone = {(i, k) for n, (i, k, _) in enumerate(occ) if label[n] != n}
    assert len(gone) >= 4
    for r in drop_lines(docs).collect():
        t = docs_text[r.doc_id]
        if t is None:
            assert r.text is None and r.n_lines == 0
            continue
        lines = t.split("\n")
        assert r.text == "\n".join(x for k, x in enumerate(lines) if (r.doc_id, k) not in gone)
        assert r.n_lines == len(lines) and r.n_removed == sum(i == r.doc_id for i, _ in gone)
    assert drop_lines(docs.limit(0)).count() == 0


def test_lines_of_any_script_and_long_words_take_part(spark):
    from evisim.llm.line_dedup import drop_lines

    lines = ["本网站所有内容版权归原作者所有", "版权所有翻印必究", "สงวนลิขสิทธิ์ทั้งหมดโดยผู้จัดทำเว็บไซต์", "one\u3000two\u3000three\u3000four\u3000five", "a\xa0b\xa0c\xa0d\xa0e", "f" * 64, "All rights reserved", "Share this page"]
    docs = make_docs(spark, ["\n".join([f"{prose(k, 20)}", *lines, "Heading"]) for k in range(3)])
    for r in drop_lines(docs).collect():
        assert r.n_removed == (len(lines) if r.doc_id else 0)
        assert r.text.split("\n")[1:] == (["Heading"] if r.doc_id else [*lines, "Heading"])
    near = make_docs(spark, ["chapter 1 of 20", "chapter 2 of 20"])  # too short to be taken for one another
    assert [r.n_removed for r in drop_lines(near).collect()] == [0, 0]


def test_lines_with_a_changed_word_are_found(spark):
    from evisim.llm.line_dedup import drop_lines

    r, pairs = random.Random(8), []
    for k in range(300):
        a = prose(1000 + k, 5 + k % 46)
        words = a.split()
        words[r.randrange(len(words))] = "".join(r.choice("stuvwxyz") for _ in range(r.randrange(2, 7)))
        b = " ".join(words)
        if 1 - levenshtein(a, b) / max(len(a), len(b)) >= 0.8:
            pairs.append((a, b))
    assert len(pairs) > 250
    docs = make_docs(spark, [x for pair in pairs for x in pair])
    removed = {x.doc_id: x.n_removed for x in drop_lines(docs).collect()}
    assert sum(removed[2 * k + 1] for k in range(len(pairs))) >= 0.97 * len(pairs) and not any(removed[2 * k] for k in range(len(pairs)))


def test_lines_with_a_long_common_passage(spark):
    from evisim.llm import line_dedup

    r = random.Random(4)
    phrase = " ".join("".join(r.choice("klmnop") for _ in range(14)) for _ in range(6))
    lines = []
    for _ in range(12):
        tail = [r.choice("abcdefgh") * r.randrange(2, 5) for _ in range(r.randrange(2, 16))]
        for _ in range(5):
            t = list(tail)
            t[r.randrange(len(t))] = "".join(r.choice("stuv") for _ in range(3))
            lines.append(f"{phrase} {' '.join(t)}")
    lines = list(dict.fromkeys(lines))
    label = slow_components(lines, lambda a, b: 1 - levenshtein(a, b) / max(len(a), len(b)) >= 0.8)
    assert 3 < len(set(label)) < len(lines) - 10
    got = line_dedup.drop_lines(make_docs(spark, lines).withColumns({"g": F.lit(1), "gone": F.lit(2), "__row": F.lit(3)})).collect()
    kept = {x.doc_id for x in got if not x.n_removed}
    assert kept >= set(label) and len(lines) - len(kept) >= 0.9 * (len(lines) - len(set(label))) and got[0].gone == 2 and got[0]["__row"] == 3


def test_lines_of_a_crowded_place_meet_each_other(spark, monkeypatch):
    from evisim.llm import line_dedup
    from evisim.llm.staging import staged

    texts = []
    for k in range(30):  # pairs, each a chain of three at times, that have one anchor with all the others and no other
        words = prose(5000 + k, 12 + k % 9).split()
        texts.append(" ".join(words))
        for m in range(1 + (k % 3 == 0)):
            words[m * 5 : m * 5 + 2] = ["zz" * (m + 1), "qq"]
            texts.append(" ".join(words))
    similar = lambda a, b: 1 - levenshtein(a, b) / max(len(a), len(b)) >= 0.8
    label = slow_components(texts, similar)
    assert 25 <= len(set(label)) < len(texts) - 25
    r = random.Random(3)
    rows = [(i, i, r.getrandbits(63), [7], len(x)) for i, x in enumerate(texts)]
    lines = staged(spark.createDataFrame(rows, "id long, id2 long, fp long, anchors array<long>, length int"), "test")
    for block in (2048, 5):  # a place in one block, and over many
        monkeypatch.setattr(line_dedup, "BLOCK", block)
        found = line_dedup.linked_lines(lines, lambda nodes: staged(spark.createDataFrame(list(enumerate(texts)), "node long, text string"), "test"), len(texts))
        root = {x.node: x.root for x in found.collect()}
        assert [root.get(i, i) for i in range(len(texts))] == label


def test_lines_of_neighbouring_classes_of_length_meet(spark):
    from evisim.llm import line_dedup
    from evisim.llm.staging import staged

    r, small = random.Random(12), []
    for k in range(18, 33, 3):  # of a crowded place: two alike are in neighbouring classes of length, and each is alone in its own
        base = prose(7000 + k, 400)[: int(1.25**k) - 2].rstrip()
        small += [base, f"{base} ab c"]
    similar = lambda a, b: 1 - levenshtein(a, b) / max(len(a), len(b)) >= 0.8
    assert len(small) > line_dedup.FEW and len({math.floor(math.log(len(x), 1.25)) for x in small}) == len(small)
    rows = [(i, i, r.getrandbits(63), [7], len(x)) for i, x in enumerate(small)]
    lines = staged(spark.createDataFrame(rows, "id long, id2 long, fp long, anchors array<long>, length int"), "test")
    asked = []

    def texts_of(nodes):
        asked.extend(x.node for x in nodes.collect())
        return staged(spark.createDataFrame(list(enumerate(small)), "node long, text string").join(nodes, "node", "left_semi"), "test")

    root = {x.node: x.root for x in line_dedup.linked_lines(lines, texts_of, len(small)).collect()}
    for i in range(0, len(small) - 1, 2):
        assert similar(small[i], small[i + 1]) and root[i] == root[i + 1] == i
    assert len(asked) == len(set(asked))


def test_pair_filters_lose_no_pair_and_many_are_refused_early():
    from evisim.llm import line_dedup
    from evisim.llm.edit_distance import PAIRS, Texts, common_words, edits, promising, within

    r, x, y = random.Random(21), [], []
    for k in range(900):
        a = prose(8000 + k, 1 + k % 60).split()
        b = list(a) if k % 3 else prose(9000 + k, 1 + k % 60).split()
        for _ in range(r.randrange(1 + len(a) // 4)):
            at = r.randrange(len(b))
            b[at : at + r.randrange(3)] = [r.choice(["q", "zz" * 20, "other"])] * r.randrange(3)
            b = b or ["q"]
        x.append(" ".join(a))
        y.append(" ".join(b))
    zx, zy, rows = Texts(x), Texts(y), np.arange(len(x))
    most = line_dedup.allowed(np.maximum(zx.size, zy.size), 0.8)
    got = within(zx, zy, rows, rows, most, line_dedup.OVERLAP, 5)
    near = np.array([edits(a, b, 10_000) for a, b in zip(x, y, strict=True)]) <= most
    common = (common_words(zx, zy, rows, rows) >= line_dedup.OVERLAP) | np.array([min(len(a.split()), len(b.split())) < 5 for a, b in zip(x, y, strict=True)])
    may = promising(zx, zy, rows, rows, most, line_dedup.OVERLAP, 5)
    assert not (near & common & ~got).any() and not (got & ~near).any() and not (got & ~may).any()
    assert 250 < got.sum() and (~may).sum() > 150 and len(x) < PAIRS
    # In a crowded place the matrices leave every pair that is similar, and few of the others.
    z = Texts(x + y)
    n, all_ = len(z.size), np.ones(len(z.size), bool)
    left = {(int(i), int(j)) for i, j, _ in line_dedup.apart(z, 0, n, np.arange(n), all_, all_, all_, 0.8, line_dedup.Words(z, np.arange(n))) for i, j in zip(i, j, strict=True)}
    assert all((k, k + len(x)) in left for k in np.flatnonzero(got).tolist()) and len(left) < 0.02 * n * n


def test_fuzzy_recall_with_letters_changed_all_over(spark):
    from evisim.llm.line_dedup import drop_lines

    r, pairs = random.Random(9), []
    for k in range(400):
        a = prose(3000 + k, 10 + k % 40)
        b = "".join(r.choice("stuvwxyz") if c != " " and r.random() < 0.06 else c for c in a)
        if a != b and 1 - levenshtein(a, b) / max(len(a), len(b)) >= 0.8:
            pairs.append((a, b))
    docs = make_docs(spark, [x for pair in pairs for x in pair])
    removed = {x.doc_id: x.n_removed for x in drop_lines(docs).collect()}
    assert len(pairs) > 350 and sum(removed[2 * k + 1] for k in range(len(pairs))) >= 0.8 * len(pairs)


def test_blocks_find_every_near_fingerprint():
    from evisim.llm.blocks import choices

    r = random.Random(6)
    for n, distance in ((100, 3), (1 << 26, 3), (1 << 36, 3), (1000, 2)):
        masks = choices(n, distance)
        for _ in range(300):
            bits = sum(1 << b for b in r.sample(range(64), distance))
            assert any(bits & m == 0 for m in masks)


# 7 mixing


def slow_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > most * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mixing(spark, texts):
    from evisim.llm.mixing import mix, plan_mix

    many = [prose(k, 5 + k % 40) for k in range(900)] + texts
    docs = make_docs(spark, many, ("s1", "s2", "S", None, "é", "s1", "s2", "s1")).withColumn("size", F.lit("clash")).withColumn("copies", F.lit("clash"))
    got = plan_mix(docs).collect()
    per, taken = Counter(), Counter()
    for r in got:
        assert r.size == len(WORD.findall(many[r.doc_id] or "")) and r.copies <= 2
        per[r.source] += r.size
        taken[r.source] += r.size * r.copies
    want = slow_targets(per)
    for r in got:
        assert r.source_size == per[r.source] and abs(r.target - want[r.source]) < 1e-6
    for s in per:
        assert abs(taken[s] - want[s]) <= 0.2 * want[s] + 1
    again = Counter(r.doc_id for r in mix(docs).collect())
    assert again == Counter({r.doc_id: r.copies for r in got if r.copies})
    assert mix(docs).columns == docs.columns and mix(docs.limit(0)).count() == 0


# 8 packing


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    from evisim.llm.packing import pack_documents, sequence_ids
    from evisim.llm.queries import tokenizer_path

    path = tokenizer_path(spark)
    tk = Tokenizer.from_file(path)
    odd = [*texts, "<|endoftext|> don't 'S", "ΣΑΣ İI K x é", "x\u0301 \u0301y \x1c\x1d\x85", "a.! , . b;: c,"]
    docs = make_docs(spark, odd).withColumn("length", F.lit("clash"))
    got = pack_documents(docs, path).collect()
    ids = [[*tk.encode(t or "", add_special_tokens=False).ids, 1] for t in odd]
    want = {(i, k): (k * 4096, min(4096, len(x) - k * 4096), zlib.crc32(np.array(x[k * 4096 : (k + 1) * 4096], "<u4").tobytes())) for i, x in enumerate(ids) for k in range(-(-len(x) // 4096))}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
    total = sum(map(len, ids))
    assert len(seqs) <= -(-total // 4096) + 1
    assert sum(len(r.ids) for r in sequence_ids(docs, path).collect()) == total
    assert pack_documents(docs.limit(0), path).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_vector_best_fit_holds_every_capacity(rule):
    from evisim.llm.packing import best_fit

    r = np.random.default_rng(2)
    lengths = r.integers(1, 60, 500)
    bins, offsets = best_fit(lengths, (100, 4, 3000), (1.0, 0.5, 0.5), rule)
    for b in range(bins.max() + 1):
        own = lengths[bins == b]
        assert len(own) and own.sum() <= 100 and len(own) <= 4 and (own**2).sum() <= 3000 or len(own) == 1
        assert sorted(offsets[bins == b]) == sorted(np.cumsum(own[np.argsort(offsets[bins == b])]) - own[np.argsort(offsets[bins == b])])
    with pytest.raises(ValueError):
        best_fit(np.array([101]), (100, 4, 1e9))


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize(("caps", "weights"), [((100, 4, 3000), (1.0, 0.5, 0.5)), ((100, 9, 9000), (1.0, 0.1, 0.1)), ((4096, 64, 0.9 * 4096**2), (1.0, 0.1, 0.1))])
def test_vector_best_fit_chooses_the_best_bin(rule, caps, weights):
    from evisim.llm.packing import best_fit

    r = np.random.default_rng(5)
    lengths = r.integers(1, int(caps[0] * 0.6) + 1, 400)
    open_, want = [], {}
    for i in sorted(range(400), key=lambda k: (-lengths[k], k)):
        q = (int(lengths[i]), 1, int(lengths[i]) ** 2)
        scores = []
        for k, b in enumerate(open_):
            left = [c - u for c, u in zip(caps, b)]
            if all(x >= y for x, y in zip(left, q)):
                if rule == "norm":
                    scores.append((sum(w * ((x - y) / c) ** 2 for w, x, y, c in zip(weights, left, q, caps)), k))
                else:
                    scores.append((-sum(w * x / c * y / c for w, x, y, c in zip(weights, left, q, caps)), k))
        if q[2] > caps[2] or not scores:
            open_.append([0, 0, 0] if q[2] <= caps[2] else [caps[0], caps[1], caps[2]])
            scores = [(0, len(open_) - 1)]
        best = min(s for s, _ in scores)
        want[i] = [k for s, k in scores if s <= best + 1e-12 * max(1, abs(best))]  # ties in floating point
        k = want[i][0]
        open_[k] = [u + x for u, x in zip(open_[k], q)]
    got, _ = best_fit(lengths, caps, weights, rule)
    same = sum(int(got[i]) in want[i] for i in range(400))
    assert same == 400
    dims = np.stack([np.bincount(got, lengths), np.bincount(got), np.bincount(got, lengths.astype(float) ** 2)], axis=1)
    assert (dims[dims[:, 1] > 1].max(axis=0) <= caps).all() and dims[:, 0].max() <= caps[0]


def test_packing_needs_few_sequences(spark):
    from evisim.llm.packing import best_fit, DOCUMENTS, ATTENTION, WEIGHTS

    r = np.random.default_rng(8)
    lengths = np.minimum(4096, np.exp(r.normal(5.6, 1.3, 8192)).astype(int) + 1)
    bins, _ = best_fit(lengths, (4096, DOCUMENTS, ATTENTION * 4096**2), WEIGHTS)
    assert bins.max() + 1 <= 1.01 * -(-lengths.sum() // 4096)


# 9 token counts


def slow_count(word, score, by_byte):
    best = [(0.0, 0)]
    for e in range(1, len(word) + 1):
        top = (-1e300, 0)
        for b in range(e):
            s = score.get(word[b:e])
            if s is not None and best[b][0] + s > top[0]:
                top = (best[b][0] + s, best[b][1] + 1)
        if word[e - 1] not in score:
            n = len(word[e - 1].encode())
            if best[e - 1][0] + n * by_byte > top[0]:
                top = (best[e - 1][0] + n * by_byte, best[e - 1][1] + n)
        best.append(top)
    return best[-1][1]


def test_token_counts(spark, texts):
    from evisim.llm.queries import tokenizer_path
    from evisim.llm.token_counts import MARK, Trie, ranked_pieces, token_counts

    path = tokenizer_path(spark, "piece_bpe_32k.model")
    pieces = ranked_pieces(path)
    trie, score = Trie(pieces), dict(pieces)
    got = {r.doc_id: r for r in token_counts(make_docs(spark, texts).withColumn("n_tokens", F.lit("clash")), path).collect()}
    for i, t in enumerate(texts):
        counts = [slow_count(MARK + w, score, trie.by_byte) for w in WORD.findall(t or "")]
        assert (got[i].n_words, got[i].n_tokens, got[i].max_word_tokens) == (len(counts), sum(counts), max(counts, default=0))
    for w in ("abcd", "abce", "abcdef"):
        trie.insert(w)
    assert trie.made == 7  # abcd, then e, then ef
    assert token_counts(make_docs(spark, texts).limit(0), path).count() == 0


# 10 archives


def test_archives(spark):
    from evisim.llm.warc import archive_folder, frames_of, lookup, parse_record, read_archives, records_of, write_archives

    import zstandard

    html = [prose(k, 300) for k in range(20)] + ["same", "same", "same", None, "", "é漢"]
    url = [f"http://x/{k}" if k % 3 else None for k in range(len(html))]
    url[1] = "http://x/a b\r\nWARC-Type: evil"
    pages = spark.createDataFrame([(i, u, h, "c") for i, (u, h) in enumerate(zip(url, html, strict=True))], "page_id long, url string, html string, sha1 string")
    folder = archive_folder(spark)
    index = write_archives(pages.unionByName(pages.filter("page_id = 22")), folder, frame_bytes=1000, bundle_bytes=2000)
    got = defaultdict(list)
    for r in read_archives(spark, folder, index).collect():
        got[r.page_id].append(r)
    groups = defaultdict(list)
    for i, h in enumerate(html):
        groups[h or ""].append(i)
    assert set(got) == set(range(len(html))) and len(got[22]) == 2
    for i, h in enumerate(html):
        data, win = (h or "").encode(), max(groups[h or ""])
        for r in got[i]:
            assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
            assert (r.record_type, r.refers_to) == (("response", None) if i == win else ("revisit", win))
            assert r.payload is None if i != win else bytes(r.payload) == data
    one = lookup(spark, folder, index, spark.createDataFrame([("urn:page:5",), ("urn:page:20",)], "record_id string")).collect()
    assert {x.record_id: parse_record(bytes(x.data))["WARC-Type"] for x in one} == {"urn:page:5": "response", "urn:page:20": "revisit"}
    raw = spark.read.format("binaryFile").load(folder).collect()
    assert len(raw) > 1
    for f in raw:
        data = bytes(f.content)
        plain = zstandard.ZstdDecompressor().decompressobj
        assert sum(d for _, _, d in frames_of(data)) == sum(n for *_, n in records_of(data)) and plain
    assert read_archives(spark, archive_folder(spark), write_archives(pages.limit(0), archive_folder(spark))).count() == 0


def test_equal_bundles_of_two_partitions_both_come_back(spark):
    from evisim.llm.staging import new_path
    from evisim.llm.warc import archive_folder, read_archives, write_archives

    path = new_path(spark, "pages")
    spark.range(0, 2, 1, 2).selectExpr("7L AS page_id", "'http://x/' AS url", "'page' AS html").write.parquet(path)
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")  # each file is a partition
    try:
        folder = archive_folder(spark)
        index = write_archives(spark.read.parquet(path), folder)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    rows = read_archives(spark, folder, index).collect()
    assert [(r.page_id, r.record_type, bytes(r.payload)) for r in rows] == [(7, "response", b"page")] * 2 and index.select("bundle").distinct().count() == 2


def test_damaged_payloads_are_found(spark, tmp_path):
    from evisim.llm import warc

    folder = str(tmp_path / "a")
    index = warc.write_archives(spark.createDataFrame([(1, "http://x/", "page one")], "page_id long, url string, html string"), folder)
    (path,) = (tmp_path / "a").glob("*.warc.zst")
    bundle = warc.Bundle()
    for name, *_ in warc.records_of(path.read_bytes()):
        bundle.add(name, warc.record(1, "http://x/", b"page one", None, False).replace(b"page one", b"page two"))
    path.write_bytes(bundle.close())
    with pytest.raises(Exception, match="isn't what its header says"):
        warc.read_archives(spark, folder, index).collect()


# rows of one doc_id and without doc_id


def test_rows_are_dropped_by_doc_id_and_text(spark):
    from evisim.llm.exact_dedup import drop_repeats
    from evisim.llm.simhash_dedup import drop_near

    a, b, c, d = (prose(k, 100) for k in range(4))
    rows = [(5, a), (9, a), (5, b), (None, a), (None, c), (None, c), (None, d), (5, b), (6, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(5, b), (7, ""), (9, a), (None, c), (None, d)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in drop_repeats(docs).collect()), key=key) == sorted(want, key=key)
    near = a.rsplit(" ", 1)[0] + " x"
    assert (slow_fingerprint(a) ^ slow_fingerprint(near)).bit_count() <= 3
    rows = [(5, a), (5, near), (3, near), (5, b), (None, a), (None, c), (None, c), (5, d), (5, d)]
    got = [(r.doc_id, r.text) for r in drop_near(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = [(3, near), (5, b), (5, d), (None, c)]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_lines_of_rows_with_one_doc_id_or_none(spark):
    from evisim.llm.line_dedup import drop_lines

    x, own = prose(1, 12), [prose(10 + k, 12) for k in range(4)]
    rows = [(1, f"{x}\nend"), (2, f"{x}\n{own[0]}"), (2, own[1]), (None, own[2]), (3, f"{own[2]}\n{own[2]}"), (None, f"{own[3]}\n{own[2]}")]
    got = {(r.doc_id, r.text) for r in drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, f"{x}\nend"), (2, own[0]), (2, own[1]), (None, own[2]), (3, ""), (None, own[3])}


# components


def test_components_take_few_rounds(spark, monkeypatch):
    from evisim.llm import components as c

    rounds = []
    real = c._roots
    monkeypatch.setattr(c, "_roots", lambda e, label: (rounds.append(1), real(e, label))[1])
    mixed = list(range(10_000))
    random.Random(3).shuffle(mixed)
    for path in (range(10_000), mixed):
        rounds.clear()
        got = c.components(spark.createDataFrame(list(zip(path, path[1:])), "a long, b long"))
        assert got.filter("root = 0").count() == 10_000 and len(rounds) < 14


def test_components_of_a_path_and_a_star(spark):
    from evisim.llm.components import components

    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5, 5), (7000, 6999)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(201)} | {1000 + k: 1000 for k in range(300)} | {7000: 6999, 6999: 6999}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
