"""Edit-aware token counts: a tree of counts per document, of which an edit renews only what it touches.

A document's tree has blocks of consecutive pre-tokens as leaves, with their
characters and tokens. Groups of FAN leaves and the nodes above them, of FAN
children each, hold the sums; the table of trees has them all. Cutting into
pre-tokens looks only ahead, so from any block boundary it goes on alike
whatever stands before. An edit finds its block by going down the sums,
re-encodes from a boundary a few characters before it to the first boundary
behind it that the new text meets as well, and puts the new blocks in the groups
of the old ones. Groups have slack, so no other leaf moves, and only the sums on
the way from the touched groups to the root are renewed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from sluice.llm import bpe
from sluice.llm.common import cut, join_by, row_key

BLOCK, FAN = 32, 16
#: Characters before an edit that may be cut differently because of it: the pattern looks at most two characters ahead, and special tokens at most their length.
CONTEXT = 4
_NEXT = regex.compile(bpe.PATTERN)


def leaves(codec: bpe.Codec, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Characters and tokens of each block, text by text; the new words of all texts are encoded together."""
    cut_ = [codec.pieces(t) for t in texts]
    special = {i: len(t) for t, i in codec.v["special"].items()}
    codec.learn(set().union(*cut_) - special.keys())
    out = []
    for pieces in cut_:
        try:
            size = np.fromiter(map(len, pieces), np.int64, len(pieces))
            count = np.fromiter(map(len, map(codec.known.__getitem__, pieces)), np.int64, len(pieces)) // 4
        except (TypeError, KeyError):  # special tokens are numbers
            size = np.array([special[p] if p in special else len(p) for p in pieces], np.int64)
            count = np.array([1 if p in special else len(codec.known[p]) // 4 for p in pieces], np.int64)
        at = np.arange(0, len(pieces), BLOCK)
        out.append((np.add.reduceat(size, at), np.add.reduceat(count, at)) if len(pieces) else (size, count))
    return out


def sums(leaf: np.ndarray) -> list[np.ndarray]:
    """Sums of each FAN leaves, then of each FAN of those, up to one number; an empty tree is one group of none."""
    levels = [np.add.reduceat(leaf, np.arange(0, len(leaf), FAN)) if len(leaf) else np.zeros(1, np.int64)]
    while len(levels[-1]) > 1:
        levels.append(np.add.reduceat(levels[-1], np.arange(0, len(levels[-1]), FAN)))
    return levels


class Tree:
    """Characters and tokens of a document's blocks, in groups of FAN as they were when it was built, with the sums above.

    `find` and `put` take numbers of blocks and characters as they were then;
    changes are put in from the last to the first.
    """

    def __init__(self, chars: np.ndarray, tokens: np.ndarray, char_sums: list[np.ndarray] | None = None, token_sums: list[np.ndarray] | None = None) -> None:
        self.chars, self.tokens = (np.asarray(x, np.int64) for x in (chars, tokens))
        self.char_sums, self.token_sums = char_sums or sums(self.chars), token_sums or sums(self.tokens)
        self.own: dict[int, tuple[list[int], list[int]]] = {}
        self.renewed = 0

    @property
    def total(self) -> int:
        return int(self.token_sums[-1][0])

    def group(self, g: int) -> tuple[list[int], list[int]]:
        """Characters and tokens of a group's blocks."""
        return self.own.get(g) or (self.chars[g * FAN : g * FAN + FAN].tolist(), self.tokens[g * FAN : g * FAN + FAN].tolist())

    def find(self, at: int) -> tuple[int, int]:
        """Number and first character of the block that the character `at` is in (of the last, beyond the end)."""
        node, start = 0, 0
        for level in [*reversed(self.char_sums[:-1]), self.chars]:
            first = node * FAN
            node, last = first, min(first + FAN, len(level)) - 1
            while node < last and start + level[node] <= at:
                start += int(level[node])
                node += 1
        return max(node, 0), start

    def put(self, a: int, b: int, chars: list[int], tokens: list[int]) -> None:
        """Put blocks in the place of blocks a to b: in the group of a, and out of those of the others."""
        at = min(a // FAN, len(self.char_sums[0]) - 1)
        for g in range(at, max((b - 1) // FAN, at) + 1):
            old = self.group(g)
            low, high = max(a - g * FAN, 0), max(min(b - g * FAN, FAN), 0)
            new = tuple(x[:low] + (y if g == at else []) + x[high:] for x, y in zip(old, (chars, tokens), strict=True))
            self.own[g] = new
            for levels, x, y in ((self.char_sums, old[0], new[0]), (self.token_sums, old[1], new[1])):
                change, node = sum(y) - sum(x), g
                for level in levels:
                    level[node] += change
                    node //= FAN
                    self.renewed += 1

    def blocks(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of all blocks, one after the other."""
        groups = [self.group(g) for g in range(len(self.char_sums[0]))]
        return [c for x, _ in groups for c in x], [t for _, x in groups for t in x]


def recount(codec: bpe.Codec, text: str, tree: Tree, edits: list[tuple[int, int, str]]) -> tuple[str, int]:
    """The edited text, and how many pre-tokens were encoded anew; `tree` becomes that of the edited text. Edits are (start, end, new text) in order, apart from each other."""
    parts, last = [], 0
    for a, b, new in edits:
        parts += [text[last:a], new]
        last = b
    now = "".join([*parts, text[last:]])
    special = codec.v["special"] if codec.special and (codec.special.search(text) or codec.special.search(now)) else {}
    context = CONTEXT + max(map(len, special), default=0)
    n_blocks, changed, next_special = len(tree.chars), [], None
    k, n, delta, anew = 0, len(edits), 0, 0
    while k < n:
        first, start = tree.find(max(edits[k][0] - context, 0))
        at = start + delta
        pieces, to, block = [], n_blocks, None
        delta += len(edits[k][2]) - (edits[k][1] - edits[k][0])
        end = edits[k][1]
        k += 1
        while at < len(now):
            old = at - delta
            while k < n and edits[k][0] - context <= old:
                delta += len(edits[k][2]) - (edits[k][1] - edits[k][0])
                end = edits[k][1]
                k += 1
                old = at - delta
            if old >= end:
                if block is None or block[1] > old:
                    block = tree.find(old)
                while block[0] < n_blocks - 1 and block[1] + int(tree.chars[block[0]]) <= old:
                    block = block[0] + 1, block[1] + int(tree.chars[block[0]])
                if block[1] == old and first < block[0] < n_blocks:
                    to = block[0]
                    break
            if special and (next_special is None or next_special[0] < at):
                m = codec.special.search(now, at)
                next_special = m.span() if m else (len(now) + 1, 0)
            if special and next_special[0] == at:  # special tokens cut the text before the pattern does
                pieces.append(now[at : next_special[1]])
            else:
                pieces.append(_NEXT.match(now, at, min(next_special[0], len(now)) if special else len(now))[0])
            at += len(pieces[-1])
        else:
            while k < n:
                delta += len(edits[k][2]) - (edits[k][1] - edits[k][0])
                k += 1
        codec.learn(set(pieces) - special.keys())
        anew += len(pieces)
        count = [1 if p in special else len(codec.known[p]) // 4 for p in pieces]
        starts = range(0, len(pieces), BLOCK)
        changed.append((first, to, [sum(map(len, pieces[i : i + BLOCK])) for i in starts], [sum(count[i : i + BLOCK]) for i in starts]))
    for first, to, chars, tokens in reversed(changed):
        tree.put(first, to, chars, tokens)
    return now, anew


#: Columns of a table of trees, besides the row key: blocks, and the levels above, the groups' first.
LEVELS = "array<array<int>>"
TREE = ("chars", "tokens", "char_sums", "token_sums")


def trees(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The tree of each row of `docs` (doc_id, text, others): row key, the other columns, `chars` and `tokens` by block, `char_sums` and `token_sums` by level."""
    shared = bpe.share(docs.sparkSession, path)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.codec(shared)
        for batch in batches:
            at = 0
            for block in bpe.text_blocks([t or "" for t in batch.column(0).to_pylist()]):
                codec.trim()
                found = leaves(codec, block)
                flat = [pa.array([x[k].astype(np.int32) for x in found], pa.list_(pa.int32())) for k in (0, 1)]
                levels = [pa.array([[s.astype(np.int32) for s in sums(x[k])] for x in found], pa.list_(pa.list_(pa.int32()))) for k in (0, 1)]
                part = batch.slice(at, len(block))
                at += len(block)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *flat, *levels], names=[*part.schema.names[1:], *TREE])

    keyed = docs.select("text", *row_key(), *others)
    ints = ArrayType(IntegerType())
    schema = StructType(keyed.schema.fields[1:]).add("chars", ints).add("tokens", ints).add("char_sums", ArrayType(ints)).add("token_sums", ArrayType(ints))
    return keyed.mapInArrow(run, schema)


@F.pandas_udf(ArrayType(IntegerType()))
def running(widths: pd.Series) -> pd.Series:
    """Running sums of each list."""
    return widths.map(np.cumsum)


def mask_edits(docs: DataFrame, pattern: str = r"\d{7,}|[0-9a-f]{32,}", mask: str = "[masked]") -> DataFrame:
    """`docs` (doc_id, text) with `edits`: what masking every match of `pattern` changes."""
    text = F.coalesce("text", F.lit(""))
    found = docs.withColumns({"hits": F.regexp_extract_all(text, F.lit(pattern), 0), "gaps": F.split(text, pattern)})
    # each match ends where the gaps and matches up to it do
    widths = F.zip_with("gaps", "hits", lambda g, h: F.length(g) + F.coalesce(F.length(h), F.lit(0)))
    ends = F.slice(running(widths), F.lit(1), F.size("hits"))
    edit = F.zip_with(ends, "hits", lambda e, h: F.struct((e - F.length(h)).alias("start"), e.alias("end"), F.lit(mask).alias("new")))
    return found.withColumn("edits", F.when(F.size("hits") > 0, edit)).select(*docs.columns, "edits")


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_edited and n_encoded for each row of `docs` (doc_id, text, edits).

    `edits` holds start, end (code points) and new text, in order and apart
    from each other; null or empty changes nothing. n_encoded is the number of
    pre-tokens that the edits made it encode anew. Null and empty texts have no
    tokens; rows with equal id, text and edits count alike. Other columns are
    ignored.
    """
    edited = F.size("edits") > 0
    told = docs.select("doc_id", "text", F.xxhash64(F.col("edits")).alias("key_edits"), F.when(edited, F.col("edits")).alias("edits"), F.when(edited, F.coalesce("text", F.lit(""))).alias("old"))
    built = cut(trees(told, path), "token-trees")
    shared = bpe.share(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.codec(shared)
        array = lambda x: x.values.to_numpy(zero_copy_only=False)
        for batch in batches:
            total, encoded = [], []
            for k in range(batch.num_rows):
                codec.trim()
                chars, tokens = (array(batch.column(n)[k]) for n in TREE[:2])
                above = [[array(level).astype(np.int64) for level in batch.column(n)[k]] for n in TREE[2:]]
                tree = Tree(chars, tokens, *above)
                _, anew = recount(codec, batch.column("old")[k].as_py(), tree, [(e["start"], e["end"], e["new"]) for e in batch.column("edits")[k].as_py()])
                total.append(tree.total)
                encoded.append(anew)
            keys = ("key_id", "key_text", "key_edits")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(total, pa.int64()), pa.array(encoded, pa.int64())], names=[*keys, "after", "encoded"])

    key = ["key_id", "key_text", "key_edits"]
    schema = StructType([built.schema[c] for c in key]).add("after", LongType()).add("encoded", LongType())
    touched = built.where("edits is not null").dropDuplicates(key).select(*key, "old", "edits", *TREE)
    changed = cut(touched.mapInArrow(run, schema), "token-edits")
    n_tokens = F.get(F.element_at("token_sums", -1), 0).cast("long").alias("n_tokens")
    counted = join_by(built.select(*key, n_tokens, F.coalesce(F.size("edits"), F.lit(0)).alias("n_edits"), F.col("edits").isNotNull().alias("edited")), changed, key)
    return counted.select(
        F.col("key_id").alias("doc_id"), "n_tokens", F.when(F.col("edited"), F.col("n_edits")).otherwise(0).cast("long").alias("n_edits"),
        F.coalesce("after", "n_tokens").alias("n_tokens_edited"), F.coalesce("encoded", F.lit(0)).cast("long").alias("n_encoded"),
    )
