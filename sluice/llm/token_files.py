"""Token ids in files: documents in order of id, each block of ids as a Re-Pair grammar that any stretch can be read from.

A block holds the ids of some documents one after the other. Re-Pair replaces
frequent neighbouring pairs by new symbols, round by round, and keeps the rules
with the length that each expands to; symbols never reach over the end of a
document, so a stretch of one is read by adding up lengths and expanding only the
symbols that it meets. A document longer than a block goes on in the next.

Files are Parquet tables of one row for each block (`FILES`), so that any store
that Spark reads and writes will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructType
from pyspark.sql.window import Window

from sluice.llm import bpe
from sluice.llm.common import cut, small_side

#: Ids of a block; a pair that occurs so often becomes a rule; a round that shortens the block by less than this share is the last.
BLOCK_IDS, MIN_PAIRS, LEAST_GAIN = 2_000_000, 6, 0.03
#: Slots that pairs are counted in.
SLOTS = 1 << 19
#: The id behind each document.
END = 0
#: Characters of a text that are encoded at once.
SEGMENT_CHARS = 1_000_000
#: Blocks that may be broadcast by number and start.
SMALL_BLOCKS = 200_000


def segments(text: str) -> Iterator[str]:
    """A text in segments of SEGMENT_CHARS at most, cut before a blank between two characters that are none, where no token can lie; the rest of a text without such blanks stays whole."""
    at = 0
    while len(text) - at > SEGMENT_CHARS:
        end = text.rfind(" ", at + 1, at + SEGMENT_CHARS)
        while end > at and (text[end - 1].isspace() or text[end + 1].isspace()):
            end = text.rfind(" ", at + 1, end)
        if end <= at:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def encoded(documents: Iterator[tuple[object, str]], codec: bpe.Codec) -> Iterator[tuple[object, np.ndarray, bool]]:
    """doc_id and ids of documents, segment by segment, and whether the document ends; texts are encoded in groups of about SEGMENT_CHARS characters."""
    apart = not any(" " in s for s in codec.v["special"])
    group: list[tuple[object, str, bool]] = []
    chars = 0
    for doc_id, text in documents:
        of = segments(text) if apart else iter([text])
        here = next(of)
        while here is not None:
            after = next(of, None)
            group.append((doc_id, here, after is None))
            chars += len(here)
            if chars >= SEGMENT_CHARS:
                yield from ((i, ids, end) for (i, _, end), ids in zip(group, codec.encode([x[1] for x in group]), strict=True))
                group, chars = [], 0
            here = after
    yield from ((i, ids, end) for (i, _, end), ids in zip(group, codec.encode([x[1] for x in group]), strict=True))


def pairs_replaced(symbols: np.ndarray, inner: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """One round of Re-Pair: the shortened symbols, which of them have a neighbour in their document, and the new rules (left and right of symbols from `first` on); none if no pair is frequent.

    Pairs are counted in slots by hash; of those in one slot one is counted, and
    the others wait for a later round. Of overlapping pairs the more frequent is
    replaced; of a run of equal pairs every second.
    """
    key = symbols[:-1] << 32 | symbols[1:]
    slot = ((key * np.int64(0x9E3779B97F4A7C1)) >> np.int64(24) & np.int64(SLOTS - 1)).astype(np.int32)
    of = np.full(SLOTS, -1, np.int64)
    of[slot[inner[:-1]]] = key[inner[:-1]]
    counted = (of[slot] == key) & inner[:-1]
    counts = np.bincount(slot[counted], minlength=SLOTS)
    # how much a pair comes first: by count, then by slot
    rank = np.where(counts >= MIN_PAIRS, counts * SLOTS + np.arange(SLOTS), 0)
    here = np.zeros(len(symbols) + 1, np.int64)
    here[1:-1] = np.where(counted, rank[slot], 0)
    before, here, after = here[:-2], here[1:-1], np.append(here[2:-1], 0)
    at = np.flatnonzero((here > 0) & (here >= before) & (here >= after))
    if not len(at):
        return None
    # neighbouring places are of one run of equal pairs
    opens = np.diff(at, prepend=-2) != 1
    start = np.maximum.accumulate(np.where(opens, at, 0))
    at = at[(at - start) % 2 == 0]
    used = np.bincount(slot[at], minlength=SLOTS)
    worth = used >= MIN_PAIRS
    at = at[worth[slot[at]]]
    if not len(at):
        return None
    number = np.cumsum(worth) - 1 + first
    out, joined, keep = symbols.copy(), inner.copy(), np.ones(len(symbols), bool)
    out[at] = number[slot[at]]
    # a new symbol has a neighbour if its second half had one
    joined[at] = inner[at + 1]
    keep[at + 1] = False
    chosen = of[worth]
    return out[keep], joined[keep], np.stack([chosen >> 32, chosen & 0xFFFFFFFF])


def compress(ids: np.ndarray, ends: np.ndarray, n_ids: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair of `ids`, where no symbol reaches over an entry of `ends`: symbols, rules (two rows, from symbol `n_ids` on) and the number of symbols up to each end."""
    symbols, inner = ids.astype(np.int64), np.ones(len(ids), bool)
    inner[ends - 1] = False
    rules = [np.zeros((2, 0), np.int64)]
    first = n_ids
    while len(symbols) > MIN_PAIRS:
        step = pairs_replaced(symbols, inner, first)
        if step is None:
            break
        gain = 1 - len(step[0]) / len(symbols)
        symbols, inner = step[0], step[1]
        rules.append(step[2])
        first += step[2].shape[1]
        if gain < LEAST_GAIN:
            break
    return symbols, np.concatenate(rules, 1), np.flatnonzero(~inner) + 1


def expansion_lengths(rules: np.ndarray, n_ids: int) -> np.ndarray:
    """How many ids each rule stands for; rules refer to earlier ones, so a pass settles those whose parts are settled."""
    out = np.zeros(rules.shape[1], np.int64)
    open_ = np.arange(rules.shape[1])
    while len(open_):
        part = [np.where(r[open_] < n_ids, 1, out[np.maximum(r[open_] - n_ids, 0)]) for r in rules]
        done = (part[0] > 0) & (part[1] > 0)
        out[open_[done]] = (part[0] + part[1])[done]
        open_ = open_[~done]
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids that symbols stand for."""
    while True:
        made = symbols >= n_ids
        if not made.any():
            return symbols
        at = np.cumsum(made) - made + np.arange(len(symbols))
        out = np.empty(len(symbols) + int(made.sum()), symbols.dtype)
        out[at] = np.where(made, rules[0][np.maximum(symbols - n_ids, 0)] if rules.shape[1] else 0, symbols)
        out[at[made] + 1] = rules[1][symbols[made] - n_ids]
        symbols = out


def packed(numbers: np.ndarray) -> bytes:
    """Numbers in 2, 3 or 4 bytes each, the least that holds all of them; the first byte says which."""
    width = 2 if not len(numbers) or numbers.max() < 1 << 16 else 3 if numbers.max() < 1 << 24 else 4
    return bytes([width]) + numbers.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    width, cells = raw[0], np.frombuffer(raw, np.uint8, offset=1)
    out = np.zeros((len(cells) // width, 4), np.uint8)
    out[:, :width] = cells.reshape(-1, width)
    return out.reshape(-1).view("<u4").astype(np.int64)


class Block:
    """A block read back: `symbols`, `rules`, their lengths, and the symbols before each document's piece (with the end)."""

    def __init__(self, n_ids: int, symbols: bytes, rules: bytes, lengths: bytes, at: list[int]) -> None:
        self.n_ids, self.symbols, self.lengths = n_ids, unpacked(symbols), unpacked(lengths)
        self.rules = unpacked(rules).reshape(2, -1)
        self.at = np.append(0, at)

    def ids(self) -> np.ndarray:
        return expand(self.symbols, self.rules, self.n_ids)

    def stretch(self, piece: int, start: int, size: int) -> np.ndarray:
        """`size` ids of a document's piece from `start` on; only symbols that the stretch meets are expanded."""
        own = self.symbols[self.at[piece] : self.at[piece + 1]]
        length = np.ones(len(own), np.int64)
        made = own >= self.n_ids
        length[made] = self.lengths[own[made] - self.n_ids]
        end = np.cumsum(length)
        a = int(np.searchsorted(end, start, "right"))
        b = int(np.searchsorted(end, start + size, "left")) + 1
        skip = start - (int(end[a - 1]) if a else 0)
        return expand(own[a:b], self.rules, self.n_ids)[skip : skip + size]


def files_schema(id_type) -> StructType:
    """A row is a block: its task and place in it, its ids and the documents that end in it, number of plain ids, symbols, rules and lengths; of each piece of a document its doc_id, its ids, the symbols up to its end, which piece of the document it is, from 0, and whether it is the last."""
    out = StructType().add("part", IntegerType()).add("place", IntegerType()).add("n_ids", LongType()).add("n_docs", LongType()).add("plain", IntegerType())
    for name in ("symbols", "rules", "lengths"):
        out = out.add(name, BinaryType())
    return out.add("doc_ids", ArrayType(id_type)).add("sizes", ArrayType(LongType())).add("ends", ArrayType(LongType())).add("pieces", ArrayType(LongType())).add("last", ArrayType(IntegerType()))


def blocks(documents: Iterator[tuple[object, str]], codec: bpe.Codec, plain: int, most: int) -> Iterator[dict]:
    """Blocks of at most `most` ids from documents (id, text) in order."""
    held, size, place = [], 0, 0  # doc_id, number of the piece, ids, whether the document ends

    def block() -> dict:
        ids = np.concatenate([x[2] for x in held])
        sizes = np.array([len(x[2]) for x in held], np.int64)
        symbols, rules, ends = compress(ids, np.cumsum(sizes), plain)
        lengths = expansion_lengths(rules, plain)
        return {
            "place": place, "n_ids": len(ids), "n_docs": sum(x[3] for x in held), "plain": plain, "symbols": packed(symbols), "rules": packed(rules.reshape(-1)), "lengths": packed(lengths),
            "doc_ids": [x[0] for x in held], "sizes": sizes.tolist(), "ends": ends.tolist(), "pieces": [x[1] for x in held], "last": [int(x[3]) for x in held],
        }

    piece, kept, n_kept = 0, [], 0  # of the document under way
    for doc_id, ids, end in encoded(documents, codec):
        if end:
            ids = np.append(ids, np.int32(END))
        while n_kept + len(ids) + size > most:
            room = most - size - n_kept
            if n_kept + room:
                held.append((doc_id, piece, np.concatenate([*kept, ids[:room]]), False))
                piece += 1
            yield block()
            held, size, place, kept, n_kept, ids = [], 0, place + 1, [], 0, ids[room:]
        kept.append(ids)
        n_kept += len(ids)
        if end:
            held.append((doc_id, piece, np.concatenate(kept), True))
            size += n_kept
            piece, kept, n_kept = 0, [], 0
    if held:
        yield block()


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Writes the ids of every whole text of `docs` (doc_id, text), with END behind each, in ascending order of doc_id, to files at `path`, in blocks of `block_ids` at most.

    Null texts count as empty and have END alone; null ids come first; rows with
    one id are ordered by a hash of their text, equal rows each have a place.
    Other columns play no part. An empty table gives no blocks.
    """
    shared = bpe.share(docs.sparkSession, tokenizer)
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    schema = files_schema(docs.schema["doc_id"].dataType)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part = bpe.codec(shared), TaskContext.get().partitionId()
        documents = ((i.as_py(), t.as_py()) for batch in batches for i, t in zip(batch.column(0), batch.column(1), strict=True))
        for row in blocks(documents, codec, len(codec.v["bytes"]), block_ids):
            yield pa.RecordBatch.from_pylist([row | {"part": part}], schema=arrow)

    # parts follow each other in the order of ids
    ordered = own.repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    ordered.mapInArrow(run, schema).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The blocks at `path` with `base` and `base_docs`, the ids and document ends of all blocks before: sums of parts, then of the blocks within a part."""
    files = spark.read.parquet(path)
    sizes = files.select("part", "place", "n_ids", "n_docs")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    # one row for each task that wrote
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("ids"), F.sum("n_docs").alias("docs")).select("part", upto("ids", before).alias("part_ids"), upto("docs", before).alias("part_docs"))
    based = sizes.join(parts, "part").select("part", "place", (F.col("part_ids") + upto("n_ids", within)).alias("base"), (F.col("part_docs") + upto("n_docs", within)).alias("base_docs"))
    return files.join(small_side(based, SMALL_BLOCKS), ["part", "place"])


def crc_joined(first: int, second: int, size: int) -> int:
    """CRC-32 of two byte strings put together from theirs, and the size of the second."""
    moved, zero = first, 0
    for at in range(0, size, len(ZEROS)):
        some = ZEROS[: size - at]
        moved, zero = zlib.crc32(some, moved), zlib.crc32(some, zero)
    return moved ^ zero ^ second


ZEROS = bytes(1 << 20)


def token_documents(files: DataFrame) -> DataFrame:
    """What the blocks of `read_token_files` hold, by document: doc_id, start (ids before it), n_tokens (END included) and ids_crc32 of the ids as little-endian 32-bit numbers. Every block is expanded."""
    id_type = files.schema["doc_ids"].dataType.elementType
    schema = StructType().add("ordinal", LongType()).add("piece", LongType()).add("whole", IntegerType()).add("doc_id", id_type).add("start", LongType()).add("n_tokens", LongType()).add("ids_crc32", LongType())
    arrow = to_arrow_schema(schema)
    names = ["base", "base_docs", "plain", "symbols", "rules", "lengths", "doc_ids", "sizes", "ends", "pieces", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(c)[k].as_py() for c, n in enumerate(names)}
                raw = Block(row["plain"], row["symbols"], row["rules"], row["lengths"], row["ends"]).ids().astype("<u4").tobytes()
                at = np.append(0, np.cumsum(row["sizes"]))
                ended = np.append(0, np.cumsum(row["last"])[:-1]) + row["base_docs"]
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
                whole = [int(p == 0 and e) for p, e in zip(row["pieces"], row["last"], strict=True)]
                columns = [ended, row["pieces"], whole, row["doc_ids"], at[:-1] + row["base"], row["sizes"], crc]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)

    pieces = cut(files.select(*names).mapInArrow(run, schema), "token-pieces")
    result = ("doc_id", "start", "n_tokens", "ids_crc32")

    def together(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("piece")
        crc, size = int(rows["ids_crc32"].iloc[0]), rows["n_tokens"].tolist()
        for n, c in zip(size[1:], rows["ids_crc32"].iloc[1:].tolist(), strict=True):
            crc = crc_joined(crc, c, 4 * n)
        return rows.head(1).assign(n_tokens=sum(size), ids_crc32=crc)[list(result)]

    # a document in several blocks has a row for each
    long = pieces.where("whole = 0").groupBy("ordinal").applyInPandas(together, StructType([schema[c] for c in result]))
    return pieces.where("whole = 1").select(*result).unionByName(long)


def token_stretches(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """`ids` of each stretch of `wanted` (start, size; numbers of ids of the whole): start, size, ids. Blocks that no stretch meets aren't read, and of the others only the symbols met are expanded.

    A stretch may go over documents and blocks; what lies behind the last id is
    left out, and a stretch with nothing in it has no row. Equal stretches have one row.
    """
    last = lambda a, n: F.floor((a + n - 1) / BLOCK_IDS).cast("long")
    bins = lambda a, n: F.explode(F.sequence(F.floor(a / BLOCK_IDS).cast("long"), last(a, n)))
    spans = files.select("part", "place", "base", "n_ids", bins(F.col("base"), F.col("n_ids")).alias("bin"))
    asked = wanted.where("size > 0").select("start", "size").distinct().withColumn("bin", bins(F.col("start"), F.col("size")))
    met = asked.join(spans, "bin").where("start < base + n_ids and base < start + size").select("part", "place", "base", "start", "size").distinct()
    schema = "start long, size long, base long, ids array<int>"

    def read(stretches: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(stretches):
            b = block.iloc[0]
            held, at = Block(b["plain"], b["symbols"], b["rules"], b["lengths"], list(b["ends"])), np.append(0, np.cumsum(b["sizes"]))
            for start, size, base in stretches[["start", "size", "base"]].itertuples(index=False):
                a, z = max(start - base, 0), min(start + size - base, int(at[-1]))
                of = range(int(np.searchsorted(at, a, "right")) - 1, int(np.searchsorted(at, z, "left")))
                ids = [held.stretch(p, max(a - int(at[p]), 0), min(z, int(at[p + 1])) - max(a, int(at[p]))) for p in of]
                out.append((start, size, base, np.concatenate(ids).tolist()))
        return pd.DataFrame(out, columns=["start", "size", "base", "ids"])

    needed = files.join(met.select("part", "place").distinct(), ["part", "place"], "left_semi").select(F.col("part").alias("of_part"), F.col("place").alias("of_place"), "plain", "symbols", "rules", "lengths", "sizes", "ends")
    found = met.groupBy("part", "place").cogroup(needed.groupBy("of_part", "of_place")).applyInPandas(read, schema)
    parts = F.sort_array(F.collect_list(F.struct("base", "ids")))
    return found.groupBy("start", "size").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
