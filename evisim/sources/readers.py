"""Readers of analysis artifacts. Schemas are given, not inferred; aliases of fields are settled in one projection."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

FUNCTION = "address STRING, entry_point STRING, name STRING, size INT, body_size INT, param_count INT, return_type STRING, calling_convention STRING, is_thunk BOOLEAN, is_external BOOLEAN, instruction_count INT, instr_count INT, source STRING"
PCODE = "n STRING, a STRING, ops STRING, vars ARRAY<STRING>"


def address(c: Column) -> Column:
    """A hexadecimal address, with or without 0x, as a long."""
    return F.conv(F.regexp_replace(c, "^0[xX]", ""), 16, 10).cast("long")


def normalize_functions(rows: DataFrame) -> DataFrame:
    """One shape for all function lists: aliases and defaults settled, nameless rows gone."""
    out = rows.select(
        F.coalesce("entry_point", "address", F.lit("")).alias("address"),
        "name",
        F.coalesce("size", "body_size", F.lit(0)).alias("size"),
        F.coalesce("param_count", F.lit(0)).alias("param_count"),
        F.coalesce("return_type", F.lit("?")).alias("return_type"),
        F.coalesce("calling_convention", F.lit("?")).alias("calling_convention"),
        F.coalesce("is_thunk", F.lit(False)).alias("is_thunk"),
        F.coalesce("instruction_count", "instr_count", F.lit(0)).alias("instr_count"),
    )
    return out.filter("name IS NOT NULL AND name <> ''").withColumn("addr", address(F.col("address")))


def read_functions(spark: SparkSession, path: str) -> DataFrame:
    """Whole-file JSON, either a list or {"functions": [...]}."""
    raw = spark.read.text(path, wholetext=True)
    item = f"ARRAY<STRUCT<{FUNCTION.replace(' STRING', ': STRING').replace(' INT', ': INT').replace(' BOOLEAN', ': BOOLEAN')}>>"
    boxed = F.from_json("value", f"STRUCT<functions: {item}>")["functions"]
    listed = F.from_json("value", item)
    rows = raw.select(F.explode(F.when(F.ltrim("value").startswith("["), listed).otherwise(boxed)).alias("f")).select("f.*")
    return normalize_functions(rows)


def read_jsonl(spark: SparkSession, path: str, schema: str = PCODE) -> DataFrame:
    """JSON lines; malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def pcode_ops(rows: DataFrame) -> DataFrame:
    """func, seq, mnemonic, output, inputs of compact rows whose ops are [mnemonic, output, inputs] arrays."""
    ops = F.from_json("ops", "ARRAY<ARRAY<STRING>>")
    return rows.select(F.col("n").alias("func"), F.posexplode(ops).alias("seq", "op")).select("func", "seq", F.col("op")[0].alias("mnemonic"), F.col("op")[1].alias("output"), F.from_json(F.col("op")[2], "ARRAY<STRING>").alias("inputs"))


def read_sources(spark: SparkSession, path: str, glob: str = "*.c") -> DataFrame:
    """path, name, code of every source file below a folder."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("code"))


def printable_runs(content: Column, least: int = 4) -> Column:
    """Runs of printable ASCII in a text or in bytes read as Latin-1."""
    return F.regexp_extract_all(content, F.lit(f"[\\x20-\\x7e]{{{least},}}"), F.lit(0))


def read_strings(spark: SparkSession, path: str, least: int = 4) -> DataFrame:
    """path, value of the printable runs of binary files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.explode(printable_runs(F.decode("content", "ISO-8859-1"), least)).alias("value"))


def signature_lines(lines: DataFrame) -> DataFrame:
    """pattern, mask, name of `.pat` lines(value): leading hex pairs with `..` as wildcard, `:0000 name` for the public name; the end mark and comments go."""
    hexes = F.regexp_extract("value", r"^((?:[0-9A-Fa-f]{2}|\.\.)+) ", 1)
    name = F.regexp_extract("value", r":[0-9A-Fa-f]{4,8} (\S+)", 1)
    rows = lines.select(hexes.alias("h"), name.alias("name")).filter("h <> '' AND name <> ''")
    mask = F.regexp_replace(F.regexp_replace("h", r"[0-9A-Fa-f]", "F"), r"\.", "0")
    return rows.select(F.unhex(F.regexp_replace("h", r"\.", "0")).alias("pattern"), F.unhex(mask).alias("mask"), "name", (F.length("h") / 2).cast("int").alias("size"))


def read_signatures(spark: SparkSession, *paths: str) -> DataFrame:
    """Signatures of several `.pat` files, by name the longest pattern."""
    rows = signature_lines(spark.read.text(list(paths)))
    w = Window.partitionBy("name").orderBy(F.desc("size"), F.hex("pattern"))
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def debug_entries(lines: DataFrame) -> DataFrame:
    """file, entry, tag, name, low, type of dump lines(file, line, value): a marker line starts an entry, the lines after it are its attributes.

    The running count of markers within a file numbers the entries.
    """
    start = F.regexp_extract("value", r"(DW_TAG_\w+)", 1)
    rows = lines.withColumn("tag", F.when(start != "", start)).withColumn("entry", F.sum(F.when(F.col("tag").isNotNull(), 1).otherwise(0)).over(Window.partitionBy("file").orderBy("line"))).filter("entry > 0")
    attr = lambda name, p: F.max(F.when(F.regexp_extract("value", p, 1) != "", F.regexp_extract("value", p, 1))).alias(name)
    return rows.groupBy("file", "entry").agg(F.max("tag").alias("tag"), attr("name", r'DW_AT_name\s+\("([^"]*)"\)'), attr("low", r"DW_AT_low_pc\s+\((0x[0-9a-fA-F]+)\)"), attr("type", r'DW_AT_type\s+\(.*"([^"]*)"\)'))


def read_ngram_table(spark: SparkSession, path: str) -> DataFrame:
    """digest, name_id, count of binary n-gram files: magic NGDB, a count, then entries of 12 digest bytes and two numbers."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for content in batch.column(0):
                data = content.as_py()
                magic, n = struct.unpack_from("<4sI", data)
                if magic != b"NGDB":
                    raise ValueError("no n-gram table")
                rows = [struct.unpack_from("<12sII", data, 8 + 20 * i) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0].hex() for r in rows]), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["digest", "name_id", "count"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "digest string, name_id long, count long")


def read_cache(spark: SparkSession, path: str, schema: str, own: str, key: str = "binary_hash") -> DataFrame:
    """One JSON per binary; the own one and unreadable ones are left out."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", "true").option("ignoreCorruptFiles", "true").json(path)
    return rows.filter(F.col(key).isNotNull() & (F.col(key) != own))


def file_kind(head: Column) -> Column:
    """The format that a file's first bytes tell."""
    h = F.upper(F.hex(head))
    return (
        F.when(h.startswith("7F454C46"), "elf")
        .when(h.rlike("^(CFFAEDFE|CEFAEDFE|FEEDFACF|FEEDFACE)"), "macho")
        .when(h.startswith("CAFEBABE"), "fat_or_class")
        .when(h.startswith("4D5A"), "pe")
        .when(h.startswith("504B0304"), "zip")
        .when(h.startswith("0061736D"), "wasm")
        .otherwise("unknown")
    )


def read_kinds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", file_kind(F.substring("content", 1, 8)).alias("kind"))


def reference_entries(spark: SparkSession, path: str) -> DataFrame:
    """A tree of lib=/version= folders; both become columns."""
    return spark.read.option("basePath", path).parquet(path)
