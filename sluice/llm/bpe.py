"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

Texts are cut into pre-tokens; the distinct ones of a batch lie in one flat
array of symbols. A round looks up all neighbouring pairs in a hash table of the
pair keys, finds the lowest rank of each word, and merges it
everywhere in the word; words without a known pair are finished.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

#: The pre-token pattern of this kind of vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Vocabularies are sent to every executor, so they may have at most this many tokens.
MAX_TOKENS = 2_000_000
#: Words a worker remembers, with so many characters in all, and characters it cuts up at once.
CACHE_WORDS, CACHE_CHARS = 400_000, 8_000_000
BLOCK_CHARS = 1_000_000
NO_RANK = np.iinfo(np.int64).max


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in such files: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def load(path: str) -> dict:
    """What the codec needs of a tokenizer file: bytes of each id, sorted pair keys with rank and result, special tokens."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    letters, vocab = byte_letters(), data["model"]["vocab"]
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    if len(vocab) + len(special) > MAX_TOKENS:
        raise ValueError(f"more than {MAX_TOKENS} tokens")
    of = [b""] * (max([*vocab.values(), *special.values()]) + 1)
    for token, i in vocab.items():
        of[i] = bytes(letters[c] for c in token)
    for token, i in special.items():
        of[i] = token.encode()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
    keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
    made = np.array([vocab[a + b] for a, b in pairs], np.int64)
    order = np.argsort(keys, kind="stable")
    single = np.zeros(256, np.int64)
    for letter, b in letters.items():
        single[b] = vocab.get(letter, 0)
    return {"bytes": of, "keys": keys[order], "rank": order.astype(np.int64), "made": made[order], "single": single, "special": special}


class Pairs:
    """Places of pair keys in their sorted list, by hashing with open addresses: few of the looked up keys need a second probe."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 8).bit_length())
        self.keys, self.place = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        left, slot = np.arange(len(keys)), self.slot(keys)
        while len(left):
            free = np.flatnonzero(self.keys[slot] < 0)
            first = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[first]], self.place[slot[first]] = keys[left[first]], left[first]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, slot = left[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each key (any, if it isn't there), and whether it is there."""
        slot = self.slot(keys)
        held = self.keys.take(slot)
        there = held == keys
        again = np.flatnonzero(~there & (held >= 0))
        while len(again):
            slot[again] = (slot[again] + 1) & ((1 << self.bits) - 1)
            held = self.keys.take(slot[again])
            hit = held == keys[again]
            there[again[hit]] = True
            again = again[~hit & (held >= 0)]
        return self.place.take(slot), there


class Codec:
    """Encodes and decodes texts; remembers words it has seen."""

    def __init__(self, vocabulary: dict) -> None:
        self.v = vocabulary
        self.cut = regex.compile(PATTERN).findall
        self.pairs = Pairs(vocabulary["keys"])
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary["special"], key=len, reverse=True))) + ")") if vocabulary["special"] else None
        self.known: dict[str, bytes] = {}
        self.chars = 0

    def trim(self) -> None:
        """Forget all words if they have become many; before a block of texts, never within one."""
        if len(self.known) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.known.clear()
            self.chars = 0

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and where each word starts in it (with the end)."""
        rank, made = self.v["rank"], self.v["made"]
        size = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.v["single"][np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            at, there = self.pairs.find(sym[:-1] << 32 | sym[1:])
            r = np.full(len(sym), NO_RANK)
            r[:-1] = np.where(there & (word[:-1] == word[1:]), rank[at], NO_RANK)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            low = np.repeat(np.minimum.reduceat(r, first), np.diff(first, append=len(sym)))
            over = low == NO_RANK
            if over.any():
                done.append((word[over], sym[over]))
                live = ~over
                sym, word, r, low, at = sym[live], word[live], r[live], low[live], np.append(at, 0)[live]
                if not len(sym):
                    break
            else:
                at = np.append(at, 0)
            merge = r == low
            # of overlapping pairs (a run of one symbol) every second one from the left is merged
            start = np.flatnonzero(merge & ~np.append(False, merge[:-1]))
            run = np.zeros(len(sym), np.int64)
            run[start] = start
            merge &= (np.arange(len(sym)) - np.maximum.accumulate(run)) % 2 == 0
            sym = np.where(merge, made[at], sym)
            keep = ~np.append(False, merge[:-1])
            sym, word = sym[keep], word[keep]
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        word, sym = np.concatenate([w for w, _ in done]), np.concatenate([s for _, s in done])
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.int32), np.append(0, np.cumsum(np.bincount(word, minlength=len(words))))

    def learn(self, words: Iterable[str]) -> None:
        """Encode the words that aren't known yet."""
        new = [w for w in words if w not in self.known]
        if not new:
            return
        ids, at = self.encode_words([w.encode("utf-8", "replace") for w in new])
        raw, at = ids.tobytes(), (at * 4).tolist()
        self.chars += sum(map(len, new))
        self.known.update((w, raw[a:b]) for w, a, b in zip(new, at, at[1:], strict=False))

    def pieces(self, text: str) -> list[str | int]:
        """Pre-tokens of a text in order; special tokens as their ids."""
        if self.special is None or not self.special.search(text):
            return self.cut(text)
        out: list[str | int] = []
        for part in self.special.split(text):
            out += [self.v["special"][part]] if part in self.v["special"] else self.cut(part)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for block in text_blocks(texts):
            cut = [self.pieces(t) for t in block]
            self.trim()
            special = {i: np.int32(i).tobytes() for i in self.v["special"].values()}
            self.learn(set().union(*cut) - special.keys())
            get = self.known.__getitem__
            for pieces in cut:
                try:
                    raw = b"".join(map(get, pieces))
                except KeyError:
                    raw = b"".join(special[p] if p in special else get(p) for p in pieces)
                out.append(np.frombuffer(raw, np.int32))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.v["bytes"].__getitem__, ids)).decode("utf-8", "replace")


def text_blocks(texts: list[str]) -> Iterator[list[str]]:
    block, chars = [], 0
    for t in texts:
        block.append(t)
        chars += len(t)
        if chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


#: The codec that a worker process used last, by the name of its vocabulary.
_codecs: dict[str, Codec] = {}


def share(spark: SparkSession, path: str | None = None) -> tuple[str, Broadcast]:
    """A tokenizer file's vocabulary for all executors, named by what is in it; only the driver reads the file."""
    vocabulary = load(path or default_path())
    parts = (b"\0".join(vocabulary["bytes"]), *(vocabulary[k].tobytes() for k in ("keys", "rank", "made", "single")), repr(sorted(vocabulary["special"].items())).encode())
    return hashlib.sha256(b"\1".join(parts)).hexdigest(), spark.sparkContext.broadcast(vocabulary)


def codec(shared: tuple[str, Broadcast]) -> Codec:
    """The worker's codec for a shared vocabulary."""
    name, value = shared
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(value.value)
    return _codecs[name]


def bpe_codec(docs: DataFrame, path: str | None = None) -> DataFrame:
    """`docs` with `ids` (array of int) of each whole `text` and `decoded`, the text those ids stand for.

    Null texts count as empty: no ids, empty decoded text. Equal texts have
    equal ids; an empty table gives an empty table. Other columns are kept, but
    for columns of the input named ids or decoded, which are replaced.
    """
    own = docs.drop("ids", "decoded")
    shared = share(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared)
        for batch in batches:
            ids = c.encode([t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()])
            at = np.append(0, np.cumsum([len(x) for x in ids], dtype=np.int64)).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(flat, pa.int32()))
            decoded = pa.array([c.decode(x.tolist()) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, decoded], names=[*batch.schema.names, "ids", "decoded"])

    schema = StructType([*own.schema.fields]).add("ids", ArrayType(IntegerType())).add("decoded", StringType())
    return own.mapInArrow(run, schema)
