"""What every operator and pipeline stage does with odd tables: nulls everywhere, one very long text, one id for several texts, copies, clashing columns."""

from __future__ import annotations

import collections

import pytest
from pyspark.sql import functions as F

from sluice.llm import bpe, decontaminate, line_dedup, minhash, quality_model, quality_rules, secrets, substrings, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: A column of each name that some operator returns or uses within.
CLASHES = ("row", "w", "left", "key", "kept", "spans", "gone", "at", "ids", "decoded", "items", "hits", "near", "class_id", "n_words", "n_removed", "n_lines", "lines", "pattern", "score", "bands", "start", "pos", "term", "bag", "doc", "tokens", "chars")


def frame(spark, rows):
    df = spark.createDataFrame([(i, t, None, None if i is None else f"s{i % 3}", None) for i, t in rows], SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


def others(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(4)] + [(None, None)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, "a passage of more than ten words that is in the benchmark table"), (2, None), (None, "x"), (3, "")], "item_id long, text string")
    return labels, items


def operators(spark):
    labels, items = others(spark)
    return {
        "substring_dedup": substrings.substring_dedup, "quality_rules": quality_rules.quality_rules, "bpe_codec": bpe.bpe_codec, "near_duplicates": minhash.near_duplicates,
        "quality_model": lambda d: quality_model.quality_model(d, labels), "line_dedup": line_dedup.line_dedup, "secret_scan": secrets.secret_scan,
        "token_counts": lambda d: token_counts.token_counts(token_counts.mask_edits(d)), "decontaminate": lambda d: decontaminate.decontaminate(d, items, slop=2),
    }


NAMES = ("substring_dedup", "quality_rules", "bpe_codec", "near_duplicates", "quality_model", "line_dedup", "secret_scan", "token_counts", "decontaminate")
LONG = "one two three four five six seven eight nine ten eleven\n" * 20_000
ROWS = [(None, None), (None, None), (None, ""), (1, "same id"), (1, "other text"), (1, "same id"), (2, LONG), (3, "é" * 3000), (4, "\n\n \t"), (5, "token = abcdefgh12345678")]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, name):
    """One row for each row, copies alike, whatever other columns there are."""
    out = [r.asDict(recursive=True) for r in operators(spark)[name](frame(spark, ROWS)).collect()]
    assert collections.Counter(r["doc_id"] for r in out) == collections.Counter(i for i, _ in ROWS)
    told = collections.Counter(str(sorted(r.items())) for r in out if r["doc_id"] == 1)
    assert max(told.values()) >= 2


@pytest.mark.parametrize("name", NAMES)
def test_only_nulls(spark, name):
    assert operators(spark)[name](frame(spark, [(None, None)] * 3)).count() == 3


def test_long_text_results(spark):
    n = 11 * 20_000
    by = operators(spark)
    rows = [(2, LONG), (3, "short one")]
    ((_, removed),) = by["substring_dedup"](frame(spark, rows)).where("doc_id = 2").select("n_words", "n_removed").collect()
    assert removed == n
    row = by["quality_rules"](frame(spark, rows)).where("doc_id = 2").first()
    assert (row.n_words, row.n_repeat_words, row.n_dup_lines, row.base_failed) == (n, n, 19_999, True)
    row = by["bpe_codec"](frame(spark, rows)).where("doc_id = 2").first()
    assert row.decoded == LONG
    assert by["token_counts"](frame(spark, rows)).where("doc_id = 2").first().n_tokens == len(row.ids)
    assert by["decontaminate"](frame(spark, rows)).where("doc_id = 2").first().n_words == n


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    labels, items = others(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, None, "s", None) for i, t in [(9, "a passage of more than ten words that is in the benchmark table"), *ROWS]], SCHEMA)
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        found[name] = sorted((r.doc_id is not None, r.doc_id or 0) for r in out.select("doc_id").collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    every = sorted((i is not None, i or 0) for i, _ in [(9, ""), *ROWS])
    assert found["line dedup"] == every == found["BPE encoding and decoding"]
    assert found["benchmark decontamination"] == [x for x in every if x != (True, 9)]
    # null, empty and blank texts are copies of each other, equal rows too
    assert found["MinHash near-dedup"] == sorted([(True, 4), (True, 1), (True, 1), (True, 2), (True, 3), (True, 5), (True, 9)])
