"""The queries of this subpackage: one per operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import bpe, decontaminate, line_dedup, minhash, phrases, quality_model, quality_rules, secrets, spelling, substrings, token_counts, token_files, url_filter
from sluice.llm.common import table
from sluice.sources.store import shared_dir


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.bpe_codec(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] != "model")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edits mask long numbers and hexadecimal keys."""
    return token_counts.token_counts(token_counts.mask_edits(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact phrases decide; proximity matches follow as n_near (windows), near_items and near (places, start:size), joined by commas."""
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=decontaminate.SLOP)
    ids = lambda c: F.array_join(F.array_sort(F.transform(c, lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids("items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "n_near", ids("near_items").alias("near_items"), F.array_join(F.transform("near", lambda x: F.concat_ws(":", x["at"], x["size"])), ",").alias("near"),
    )


def proximity_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proximity matches of op10_decontamination (which has a SQL twin) as lists."""
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=decontaminate.SLOP)
    return found.select("doc_id", "n_words", "n_hit", (F.col("n_hit") > 0).alias("contaminated"), "n_near", "near_items", "near")


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words are those of documents, with slips put in by hash."""
    counts = spelling.word_counts(table(spark, sf_dir, "documents"))
    return spelling.spelling_variants(counts).select("word", "form", "root", "n", "n_near", "form_n")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids are written to files of a new folder and read from there."""
    path = f"{shared_dir(spark)}/token-files-{uuid4().hex}"
    token_files.write_token_files(table(spark, sf_dir, "documents"), path)
    return token_files.token_documents(token_files.read_token_files(spark, path))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_quality_rules, op3_bpe_codec, op4_minhash_dedup, op5_quality_classifier, op6_line_dedup, op7_secret_scan, op8_token_counts, op9_url_filter, op10_decontamination, proximity_matches, op11_phrase_mining, op12_spelling_variants, op13_token_files)}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": substrings.ORACLE, "op6_line_dedup": line_dedup.ORACLE, "op10_decontamination": decontaminate.ORACLE, "op11_phrase_mining": phrases.ORACLE, "op12_spelling_variants": spelling.ORACLE}
