"""Sinks. Large outputs are written by tasks; only reports of bounded size are rendered from collected summaries."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_lookup(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """A bucketed, sorted table, so that later joins on the key don't shuffle it."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def merge_maps(maps: Sequence[tuple[int, DataFrame]]) -> DataFrame:
    """key, value of maps(key, value): the map of the smallest priority number wins, then the smallest value."""
    out = None
    for priority, df in maps:
        rows = df.select("key", "value", F.lit(priority).alias("p"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("key").agg(F.min(F.struct("p", "value")).alias("b")).select("key", "b.value", F.col("b.p").alias("priority"))


def fill_only(base: DataFrame, more: DataFrame, key: str = "key") -> DataFrame:
    """base, and the rows of more whose key base lacks."""
    return base.unionByName(more.join(base.select(key), key, "left_anti"))


def dot_lines(edges: DataFrame) -> DataFrame:
    """A Graphviz line per edge, in order of the edges."""
    return edges.select(F.format_string('  "%s" -> "%s";', F.col("src").cast("string"), F.col("dst").cast("string")).alias("value"))


def mermaid_lines(edges: DataFrame) -> DataFrame:
    return edges.select(F.format_string("  n%s --> n%s", F.col("src").cast("string"), F.col("dst").cast("string")).alias("value"))


def budget(matches: DataFrame, most: int) -> DataFrame:
    """The `most` matches of highest confidence; 0 is no bound."""
    return matches if most == 0 else matches.orderBy(F.desc("confidence"), *[c for c in matches.columns if c != "confidence"]).limit(most)


def evict(entries: DataFrame, most: int) -> DataFrame:
    """entries(key, mtime, ...) beyond the `most` last used ones."""
    w = Window.orderBy(F.desc("mtime"), "key")
    return entries.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") > most).drop("rn")


def sarif(results: DataFrame, tool: str) -> DataFrame:
    """One row, a SARIF 2.1.0 log of results(rule, level, message, uri): a report, meant for filtered results."""
    rows = results.select(F.struct(F.col("rule").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(F.struct(F.struct(F.struct(F.col("uri")).alias("artifactLocation")).alias("physicalLocation"))).alias("locations")).alias("r"), "rule")
    got = rows.agg(F.array_sort(F.collect_list("r")).alias("results"), F.transform(F.array_sort(F.collect_set("rule")), lambda x: F.struct(x.alias("id"))).alias("rules"))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), F.col("rules")).alias("driver")).alias("tool"), F.col("results"))
    return got.select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def report(summaries: dict[str, DataFrame], kind: str = "markdown", most: int = 1000) -> str:
    """A report of small summaries: JSON, Markdown or HTML. Each is cut at `most` rows, and says so."""
    tables = {}
    for name, df in summaries.items():
        rows = df.limit(most + 1).collect()
        tables[name] = {"columns": df.columns, "rows": [[str(v) for v in r] for r in rows[:most]], "more": len(rows) > most}
    if kind == "json":
        return json.dumps(tables, indent=1, sort_keys=True)
    if kind == "markdown":
        parts = []
        for name, t in tables.items():
            lines = [f"## {name}", "", "| " + " | ".join(t["columns"]) + " |", "|" + "-|" * len(t["columns"])] + ["| " + " | ".join(r) + " |" for r in t["rows"]] + ["", "More rows follow."] * t["more"]
            parts.append("\n".join(lines))
        return "\n\n".join(parts) + "\n"
    if kind == "html":
        import html

        cell = lambda v, t: f"<{t}>{html.escape(v)}</{t}>"
        return "".join(f"<h2>{html.escape(n)}</h2><table><tr>{''.join(cell(c, 'th') for c in t['columns'])}</tr>{''.join('<tr>' + ''.join(cell(v, 'td') for v in r) + '</tr>' for r in t['rows'])}</table>" for n, t in tables.items())
    raise ValueError("kind has to be json, markdown or html")
