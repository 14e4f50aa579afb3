"""Substring dedup: repeated windows of many words, counted exactly by super-k-mers.

Consecutive windows whose smallest m-word hash (the minimiser) is at the same
place form a run. Equal windows have equal minimisers, so a run whose minimiser
no other run has holds no repeated window and is left out. Of the others equal runs
(by minimiser and a hash of their words) are counted first; then one of each
travels as a packed string to its minimiser's bucket, where the windows are
sorted and counted by their words. A minimiser with very many different strings (the edge of a
passage that is everywhere) has its windows counted one by one instead, which
deals them out evenly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import cut, join_by, row_key, small_side, words
from sluice.llm.hashing import Words, blocks, mix

WINDOW = 35
MINIMISER = 8
#: Strings in a bucket on average, and strings of one minimiser above which its windows are dealt out one by one.
BUCKET_ROWS = 4000
MANY = 4000
#: Tables of up to this many keys are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 2_000_000


def runs(texts: list[str | None], window: int = WINDOW, m: int = MINIMISER) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of runs: number of the text, first word, number of windows, minimiser, hash of the words."""
    span = window - m + 1
    for at, block in blocks(texts):
        w = Words(block)
        hashes = w.hashes()
        gram, _ = w.sequences(m, hashes)
        n = len(gram) - window + 1
        if n <= 0:
            continue
        # sliding minimum by doubling; of equal values the leftmost counts
        value, place, width = mix(gram), np.arange(len(gram)), 1
        while width < span:
            step = min(width, span - width)
            right = value[step:] < value[: len(value) - step]
            place = np.where(right, place[step:], place[: len(place) - step])
            value = np.where(right, value[step:], value[: len(value) - step])
            width += step
        place, value = place[:n], value[:n]
        whole = w.doc[:n] == w.doc[window - 1 :]
        new = whole & np.append(True, (place[1:] != place[:-1]) | ~whole[:-1])
        first = np.flatnonzero(new)
        if not len(first):
            continue
        count = np.add.reduceat(whole.astype(np.int64), first)
        doc = w.doc[first]
        yield at + doc, (first - w.first[doc]).astype(np.int32), count.astype(np.int32), value[first].view(np.int64), w.ranges(hashes, first, first + count + window - 1).view(np.int64)


def run_table(docs: DataFrame, window: int = WINDOW, m: int = MINIMISER) -> DataFrame:
    """Runs of all rows: row key, `start` (word, from 0), `n` windows, `minimiser`, `content` (hash of the words)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, *columns in runs(batch.column(2).to_pylist(), window, m):
                rows = pa.array(doc)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *map(pa.array, columns)], names=["key_id", "key_text", "start", "n", "minimiser", "content"])

    return docs.select(*row_key(), "text").mapInArrow(found, f"key_id {kind}, key_text long, start int, n int, minimiser long, content long")


def packed_runs(docs: DataFrame, wanted: DataFrame, window: int = WINDOW) -> DataFrame:
    """`wanted` runs (row key, start, n, minimiser, content, times) with their words, joined by spaces; more than once if rows are."""
    listed = cut(wanted.groupBy("key_id", "key_text").agg(F.collect_list(F.struct("start", "n", "minimiser", "content", "times")).alias("runs")), "substring-wanted")
    some = join_by(docs.select(*row_key(), "text"), small_side(listed.select("key_id", "key_text"), BROADCAST_ROWS), ["key_id", "key_text"], "left_semi")
    both = join_by(some, listed, ["key_id", "key_text"], "inner")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                w = Words([batch.column(0)[k].as_py() or ""])
                plain = b" ".join(w.data[a:b] for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True))
                ends = np.cumsum(w.end - w.start + 1)
                begins = np.append(0, ends)
                start, n, *others = batch.column(1)[k].values.flatten()
                at = start.to_numpy(zero_copy_only=False).astype(np.int64)
                to = at + n.to_numpy(zero_copy_only=False) + window - 2
                text = pa.array([plain[a:b] for a, b in zip(begins[at].tolist(), (ends[to] - 1).tolist(), strict=True)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*others, text], names=["minimiser", "content", "times", "packed"])

    return both.select("text", "runs").mapInArrow(packed, "minimiser long, content long, times long, packed string")


def _merged(at: list[int], window: int) -> list[int]:
    """Word spans (from, to, from, to, ...) that windows at the sorted places `at` cover."""
    out: list[int] = []
    for a in at:
        if out and a <= out[-1]:
            out[-1] = a + window
        else:
            out += [a, a + window]
    return out


def _bucket(window: int):
    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["minimiser", "content"]).reset_index(drop=True)
        texts, of, at = [], [], []
        for k, packed in enumerate(pdf["packed"]):
            raw = packed.encode()
            gaps = [-1, *np.flatnonzero(np.frombuffer(raw, np.uint8) == 32).tolist(), len(raw)]
            for i in range(len(gaps) - window):
                texts.append(raw[gaps[i] + 1 : gaps[i + window]])
                of.append(k)
                at.append(i)
        times = pdf["times"].tolist()
        found: list[list[int]] = [[] for _ in times]
        order = sorted(range(len(texts)), key=texts.__getitem__)
        i = 0
        while i < len(order):
            j = i + 1
            while j < len(order) and texts[order[j]] == texts[order[i]]:
                j += 1
            if sum(times[of[x]] for x in order[i:j]) > 1:
                for x in order[i:j]:
                    found[of[x]].append(at[x])
            i = j
        out = pdf[["minimiser", "content"]].assign(spans=[_merged(sorted(x), window) for x in found])
        return out[out["spans"].map(len) > 0]

    return counted


def repeated(strings: DataFrame, window: int = WINDOW) -> DataFrame:
    """`spans` (from, to, ...) of words in windows that occur twice or more, for each string (minimiser, content, packed, times) that has any."""
    per = strings.groupBy("minimiser").agg(F.count("*").alias("different"))
    crowded = cut(per.where(F.col("different") > MANY).select("minimiser"), "substring-crowded")
    usual = strings.join(crowded, "minimiser", "left_anti")
    buckets = max(1, strings.count() // BUCKET_ROWS)
    plain = usual.withColumn("bucket", F.pmod(F.xxhash64("minimiser"), F.lit(buckets))).groupBy("bucket").applyInPandas(_bucket(window), "minimiser long, content long, spans array<int>")
    if crowded.isEmpty():
        return plain
    some = strings.join(crowded, "minimiser", "left_semi").dropDuplicates(["minimiser", "content"]).withColumn("w", F.split("packed", " "))
    places = F.sequence(F.lit(0), F.size("w") - window)
    each = cut(some.select("minimiser", "content", "times", F.posexplode(F.transform(places, lambda i: F.array_join(F.slice("w", i + 1, window), " "))).alias("at", "window")), "substring-windows")
    twice = each.groupBy("window").agg(F.sum("times").alias("n")).where("n > 1").select("window")
    spans = each.join(twice, "window", "left_semi").groupBy("minimiser", "content").agg(F.flatten(F.transform(F.array_sort(F.collect_list("at")), lambda a: F.array(a, a + window))).alias("spans"))
    return plain.unionByName(spans)


def _places(spans: str) -> Column:
    """All words of the spans (from, to, from, to, ...)."""
    starts = F.filter(F.transform(spans, lambda x, i: F.when(i % 2 == 0, F.sequence(x, F.get(spans, i + 1) - 1))), lambda x: x.isNotNull())
    return F.flatten(starts)


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` with n_words, n_removed and `kept`, the words left over, joined by one space.

    A word goes if a window of `window` words that covers it has the same words
    as a window that starts anywhere else, in this document too; every
    occurrence goes. Windows are judged on the input. Texts with fewer words
    stay, null texts have no words and keep an empty text. Equal rows count as
    copies of each other. Columns of `docs` with the names of the results are
    replaced; an empty table gives an empty table.
    """
    own = docs.drop("n_words", "n_removed", "kept")
    key = ["key_id", "key_text"]
    found = cut(run_table(own, window), "substring-runs")
    shared = cut(found.groupBy("minimiser").agg(F.count("*").alias("n")).where("n > 1").select("minimiser"), "substring-shared")
    some = cut(found.join(small_side(shared, BROADCAST_ROWS), "minimiser", "left_semi"), "substring-some")
    first = some.groupBy("minimiser", "content").agg(F.count("*").alias("times"), F.min(F.struct(*key, "start", "n")).alias("first"))
    strings = cut(packed_runs(own, first.select("first.*", "minimiser", "content", "times"), window), "substring-strings")
    spans = cut(repeated(strings, window), "substring-spans")
    places = some.join(spans, ["minimiser", "content"]).select(*key, F.transform("spans", lambda x: x + F.col("start")).alias("spans"))
    gone = places.groupBy(*key).agg(F.flatten(F.collect_set("spans")).alias("spans"))
    both = join_by(own.select(F.struct("*").alias("row"), "text", *row_key()), gone, key).withColumn("w", words(F.col("text")))
    both = both.withColumn("left", F.when(F.col("spans").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("w") - 1), _places("spans"))))
    kept = F.when(F.col("left").isNull(), F.array_join("w", " ")).otherwise(F.array_join(F.transform("left", lambda i: F.get("w", i)), " "))
    n = F.size("w").cast("long")
    # in two steps, so that no column of the row is taken for one of ours
    done = both.select("row", n.alias("n_words"), F.coalesce(n - F.size("left"), F.lit(0)).cast("long").alias("n_removed"), kept.alias("kept"))
    return done.select("row.*", "n_words", "n_removed", "kept")


ORACLE = f"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM doc WHERE len(w) >= {WINDOW})
), hit AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY md5_number(t)) AS n FROM win) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS k FROM hit
), word AS (
  SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM doc
), kept AS (
  SELECT w.doc_id, count(*) AS n, string_agg(w.x, ' ' ORDER BY w.k) AS t FROM word w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.k = w.k WHERE g.k IS NULL GROUP BY w.doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM doc d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
