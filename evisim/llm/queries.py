"""The registered queries: each applies an operator to its whole table."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(spark: SparkSession, name: str = "word_bpe_49k.json") -> str:
    """spark.evisim.tokenizers names a folder of vocabulary files on every node; else the installed package does."""
    folder = spark.conf.get("spark.evisim.tokenizers", None)
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evisim.llm.exact_dedup import exact_groups

    out = exact_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evisim.llm.simhash_dedup import fingerprint_hex, near_groups

    out = near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", fingerprint_hex().alias("fingerprint"), "component_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evisim.llm.quality import BASE_RULES, apply_policy, ledger, policy_mask

    led = apply_policy(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    failed = F.col("bits").bitwiseAND(F.lit(policy_mask(BASE_RULES))) != 0
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evisim.llm.mixing import plan_mix

    plan = plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evisim.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(spark))


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evisim.llm.chat import format_chats, read_chats
    from evisim.llm.staging import staged

    marks = r"\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", marks), (-7, 1, "assistant", marks)], "conv_id long, turn long, role string, text string")
    return read_chats(staged(format_chats(turns.unionByName(extra), tokenizer_path(spark)), "chat-windows"))


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evisim.llm.pii import pseudonymise

    key = spark.conf.get("spark.evisim.pii.secret", None)  # a name that Spark redacts
    if not key:
        warnings.warn("spark.evisim.pii.secret isn't set: pseudonyms are made with a public key", stacklevel=2)
        key = "demonstration key, not a secret"
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evisim.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path(spark, "piece_bpe_32k.model"))


def op10_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evisim.llm.warc import archive_folder, read_archives, write_archives

    folder = archive_folder(spark)
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evisim.llm.line_dedup import drop_lines

    out = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "text")
