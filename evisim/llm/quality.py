"""Quality rules as a bitmask ledger, in DataFrame and SQL functions only.

`ledger` takes each text's measurements once, evaluates every rule once and stores its failure as a bit next to them,
`apply_policy` turns a versioned policy (a mask of rules) into a verdict without touching texts again, and
`ablation` gets what each rule of a policy changes from one bitwise aggregation.

Null and empty texts have no words: every measurement is 0 and the rules on word counts fail them. Repeated rows are judged
alike, each on its own. Texts of any length are measured whole; an empty table gives an empty one. Extra columns pass through; those named like a measurement, `bits` or `kept` are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from evisim.llm.words import WORD

MEASUREMENTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_caps_words")


@dataclass(frozen=True)
class Rule:
    """fails: SQL over the measurements. bit: its place in the ledger, never used again for another rule."""

    name: str
    bit: int
    fails: str


#: Thresholds are integer arithmetic, so that every engine agrees on ties (a ratio at the threshold passes).
RULES = (
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", 2, "100 * n_symbols > 10 * n_words"),
    Rule("repeated_lines", 3, "100 * n_dup_lines > 50 * n_lines"),
    Rule("short_words", 4, "word_chars < 2 * n_words"),
    Rule("long_words", 5, "word_chars > 14 * n_words"),
    Rule("capitals", 6, "100 * n_caps_words > 40 * n_words"),
)
BASE_RULES = ("few_words", "repeated_windows")
#: Versioned policies: names of the rules whose failure rejects a document.
POLICIES = {
    "v1": BASE_RULES,
    "v2": tuple(r.name for r in RULES),
}
DEFAULT_POLICY = "v2"


def policy_mask(policy: str | Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    names = set(POLICIES[policy] if isinstance(policy, str) else policy)
    if unknown := names - {r.name for r in rules}:
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    return sum(1 << r.bit for r in rules if r.name in names)


def _let(name: str, value: str, body: str) -> str:
    """SQL of body with the value bound to a name: computed once, however often body and the plan above refer to it."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _ledger_sql(text: str, rules: Sequence[Rule]) -> str:
    """SQL of a struct of all measurements and the bits.

    Bound names keep it one expression. Spread over several selects, a filter on the verdict would be pushed below them and
    split the text anew for each word.
    """
    t = f"coalesce({text}, '')"
    word = WORD.replace("\\", "\\\\")
    caps = r"(?<![^\\x20\\x09-\\x0D])[^\\x20\\x09-\\x0D\\p{Ll}]*\\p{Lu}[^\\x20\\x09-\\x0D\\p{Ll}]*(?![^\\x20\\x09-\\x0D])"
    split = rf"struct(regexp_extract_all({t}, '{word}', 0) AS w, filter(split({t}, '\n', -1), l -> l rlike '{word}') AS l, regexp_count({t}, '[#*$%&|<>]') AS s, regexp_count({t}, '{caps}') AS c)"
    hashed = "CASE WHEN size(a.w) > 2 THEN transform(slice(a.w, 1, size(a.w) - 2), (x, i) -> xxhash64(x, a.w[i + 1], a.w[i + 2])) ELSE CAST(array() AS ARRAY<BIGINT>) END"
    counted = f"struct(a.w AS w, a.s AS s, a.c AS c, size(a.l) AS nl, size(a.l) - size(array_distinct(a.l)) AS nd, {hashed} AS h)"
    # Positions whose window hash occurs again, of these the ones whose window does, and the words that those windows cover.
    twins = "filter({0}, (s, j) -> (j > 0 AND {0}[j - 1].k = s.k) OR (j < size({0}) - 1 AND {0}[j + 1].k = s.k))"
    windows = "sort_array(transform({0}, s -> struct(concat_ws(' ', b.w[s.i], b.w[s.i + 1], b.w[s.i + 2]) AS k, s.i AS i)))"
    covered = "aggregate(sort_array(transform({0}, s -> s.i)), struct(0L AS n, -3 AS last), (z, x) -> struct(z.n + least(3, x - z.last) AS n, x AS last), z -> z.n)"
    same_hash = _let("p", "sort_array(transform(b.h, (x, i) -> struct(x AS k, i AS i)))", twins.format("p"))
    same_window = _let("q", windows.format(same_hash), twins.format("q"))
    repeats = f"CASE WHEN size(array_distinct(b.h)) = size(b.h) THEN 0L ELSE {covered.format(same_window)} END"
    values = ("size(b.w)", "length(array_join(b.w, ''))", "b.s", "b.nl", "b.nd", repeats, "b.c")
    measured = "struct(" + ", ".join(f"CAST({v} AS BIGINT) AS {n}" for v, n in zip(values, MEASUREMENTS, strict=True)) + ")"
    bits = " | ".join(f"CASE WHEN {re.sub('|'.join(MEASUREMENTS), lambda m: 'm.' + m[0], r.fails)} THEN {1 << r.bit}L ELSE 0L END" for r in rules)
    judged = "struct(" + ", ".join(f"m.{n} AS {n}" for n in MEASUREMENTS) + f", {bits} AS bits)"
    return _let("m", _let("b", _let("a", split, counted), measured), judged)


def ledger(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Adds the measurements of each whole text and `bits`, in which bit b is set if the rule with that bit fails.

    Windows that occur twice are found inside the row: hashes of windows are compared first, and only where two agree are
    (hash, position) pairs sorted and the windows themselves compared, so time is n log n in the words of a text.
    """
    keep = [c for c in docs.columns if c not in (*MEASUREMENTS, "bits")]
    judged = docs.select(*keep, F.expr(_ledger_sql(f"`{text}`", rules)).alias("__ledger"))
    return judged.select(*keep, *[F.col("__ledger")[n].alias(n) for n in (*MEASUREMENTS, "bits")])


def apply_policy(led: DataFrame, policy: str | Sequence[str] = DEFAULT_POLICY, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Adds `kept`: no rule of the policy fails."""
    return led.withColumn("kept", F.col("bits").bitwiseAND(F.lit(policy_mask(policy, rules))) == 0)


def ablation(led: DataFrame, policy: str | Sequence[str] = DEFAULT_POLICY, rules: Sequence[Rule] = RULES) -> DataFrame:
    """A row for each rule of the policy: rows that fail it, rows that fail nothing else, rows kept with and without it.

    Rows meet as counts of distinct bit patterns, of which there are no more than 2 to the number of rules.
    """
    mask = policy_mask(policy, rules)
    seen = led.groupBy(F.col("bits").bitwiseAND(F.lit(mask)).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    used = [r for r in rules if mask >> r.bit & 1]
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("m")) for r in used]))
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    b, m = F.col("b"), F.col("r.m")
    return seen.withColumn("r", each).groupBy(F.col("r.rule").alias("rule")).agg(
        count(b.bitwiseAND(m) != 0).alias("n_fail"),
        count(b == m).alias("n_only"),
        count(b == 0).alias("n_kept"),
        count((b == 0) | (b == m)).alias("n_kept_without"),
    )


def keep_good(docs: DataFrame, text: str = "text", policy: str | Sequence[str] = DEFAULT_POLICY) -> DataFrame:
    """The documents that the policy keeps, with their own columns only."""
    names = [f"__c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    judged = apply_policy(ledger(plain, names[docs.columns.index(text)]), policy)
    return judged.filter("kept").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
