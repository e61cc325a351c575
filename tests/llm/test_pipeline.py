"""The pipeline's run() against a brute-force version, and the registered queries' columns."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from tests.llm.test_operators import WORD, prose, slow_components, slow_fingerprint, slow_measures, slow_targets

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def accepted(t):
    n, chars, symbols, dup_lines, repeat = slow_measures(t)
    w = WORD.findall(t or "")
    lines = sum(bool(WORD.search(x)) for x in (t or "").split("\n"))
    caps = sum(any(c.isupper() for c in x) and not any(c.islower() for c in x) for x in w)
    return not (n < 50 or 100 * repeat > 50 * n or 100 * symbols > 10 * n or 100 * dup_lines > 50 * lines or chars < 2 * n or chars > 14 * n or 100 * caps > 40 * n)


def test_pipeline_equals_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline as cp
    from evisim.llm.queries import tokenizer_path

    texts = [prose(k, 60 + 31 * k % 500) for k in range(60)] + [None, "", "short", "X Y Z!! " * 60, "a& b* c% " * 80]
    base = prose(500, 2500).split()
    for k in range(6):
        base[100 * k] = f"n{k}"
        texts.append(" ".join(base))
    texts += [texts[3], texts[3], texts[20]]
    rows = [(i, t, "en", ("s1", "s0", None)[i % 3], len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    got = cp.run(spark, str(tmp_path)).collect()

    kept = [r for r in rows if accepted(r[1])]
    last = {r[1]: max(x[0] for x in kept if x[1] == r[1]) for r in kept}
    kept = [r for r in kept if last[r[1]] == r[0]]
    fps = [slow_fingerprint(r[1]) for r in kept]
    label = slow_components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    kept = [r for i, r in enumerate(kept) if label[i] == i]
    assert 10 < len(kept) < len(texts) - 10
    sizes: dict = defaultdict(int)
    for r in kept:
        sizes[r[3]] += len(WORD.findall(r[1]))
    target = slow_targets(sizes)
    tk = Tokenizer.from_file(tokenizer_path(spark))
    want: Counter = Counter()
    for i, t, _, s, _ in kept:
        rate = target[s] / sizes[s]
        u = int(hashlib.md5(f"mix-1:{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
        ids = [*tk.encode(t, add_special_tokens=False).ids, 1]
        for k in range(-(-len(ids) // 4096)):
            part = np.array(ids[4096 * k : 4096 * (k + 1)], "<u4")
            want[i, k, 4096 * k, len(part), zlib.crc32(part.tobytes())] += math.floor(rate) + (u < rate - math.floor(rate))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == +want


def test_stages_keep_the_columns_of_documents(spark):
    import corpus_pipeline as cp

    docs = spark.createDataFrame([(1, prose(1, 200), "en", "a", 9)], DOC)
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_catalog_has_the_ten_and_the_pipeline():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {re.match(r"op(\d+)_", n)[1] for n in names if re.match(r"op\d+_", n)} == {str(k) for k in range(1, 11)} and "pipeline" in names
