"""Near-duplicate documents: BagMinHash signatures, bands, verified multiset overlap.

A document is the multiset of its five-word shingles. Each shingle runs Poisson
processes over its weight range: block 0 covers weights up to 1, block b those
from 2^(b-1) to 2^b, at a rate equal to the block's length. A point has a time,
a signature slot and a weight level, and counts if the level is within the
shingle's weight; a slot keeps its earliest point. Two documents share a slot's
point with a probability equal to their weighted Jaccard similarity. Points come
in order of time, so a process stops once it is later than every slot.

Signatures are banded. In each bucket everyone is compared with one pivot, never
all with all: members of the pivot's class need no more comparing. The pivot is
the member that meets most others, so the centre of a group of edited copies.
Rounds with other pivots follow where a bucket still holds several classes. What
is left is pruned exactly: shingles that no candidate of another class has bound the
similarity that a document can reach. Only pairs of different classes that pass
the bounds are compared in the last round, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType

from sluice.llm.common import cut, join_by, row_key, small_side, words
from sluice.llm.hashing import Words, blocks, mix

SHINGLE = 5
THRESHOLD = 0.8
#: A pair at the threshold shares no band with a probability of (1 - 0.8^5)^25, 5 in 100,000.
BANDS, ROWS = 25, 5
#: Rounds with one pivot a bucket before the pairs that are left.
PIVOT_ROUNDS = 2
#: A pivot's shingles are sent along with at most about this many partners.
PARTNERS = 256
#: Members and queries in a block of the last round.
MEMBERS, QUERIES = 1024, 64
#: Tokens whose counts are in memory at once there.
TOKENS = 200_000
#: Tables of up to this many rows of numbers are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000
_LEVELS = 31


def bags(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hash and text number of every shingle of `n` texts; a text with fewer words than a shingle has one of them all."""
    h = w.hashes()
    seq, whole = w.sequences(SHINGLE, h)
    doc, shingle = w.doc[whole], seq[whole]
    size = np.diff(w.first)
    few = np.flatnonzero((size > 0) & (size < SHINGLE))
    short = np.array([np.bitwise_xor.reduce(mix(h[w.first[d] : w.first[d + 1]] + np.arange(size[d], dtype=np.uint64) * np.uint64(7919))) for d in few], np.uint64)
    return np.concatenate([shingle, short]), np.concatenate([doc, few])


def signatures(shingle: np.ndarray, doc: np.ndarray, n: int, slots: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash signatures (n x slots) of the multisets `doc` -> `shingle`; rows without shingles are infinite."""
    order = np.lexsort((shingle, doc))
    shingle, doc = shingle[order], doc[order]
    first = np.flatnonzero(np.append(True, (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
    weight = np.diff(np.append(first, len(doc)))
    shingle, doc = shingle[first], doc[first]
    best = np.full(n * slots, np.inf)
    state, owner, most, low, size = [], [], [], [], []
    for b in range(_LEVELS):
        start = 0 if b == 0 else 1 << (b - 1)
        on = weight > start
        if not on.any():
            break
        state.append(mix(shingle[on] + np.uint64(b * 0x9E3779B97F4A7C15 % 2**64)))
        owner.append(doc[on])
        most.append(weight[on])
        low.append(np.full(on.sum(), start))
        size.append(np.full(on.sum(), max(start, 1)))
    if not state:
        return best.reshape(n, slots)
    s, d, most, low, size = map(np.concatenate, (state, owner, most, low, size))
    time, scale = np.zeros(len(s)), 2.0**-32
    latest = np.full(n, np.inf)
    while len(s):
        s = mix(s + np.uint64(0x632BE59BD9B4E019))
        time = time - np.log(((s >> np.uint64(32)).astype(float) + 0.5) * scale) / size
        rest = mix(s ^ np.uint64(0x5851F42D4C957F2D))
        slot = ((rest >> np.uint64(32)).astype(np.int64) * slots) >> 32
        level = low + 1 + (((rest & np.uint64(0xFFFFFFFF)).astype(np.int64) * size) >> 32)
        ok = level <= most
        np.minimum.at(best, d[ok] * slots + slot[ok], time[ok])
        alive = np.unique(d)
        latest[alive] = best.reshape(n, slots)[alive].max(1)
        go = time < latest[d]
        s, d, most, low, size, time = s[go], d[go], most[go], low[go], size[go], time[go]
    return best.reshape(n, slots)


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each row and band."""
    bits = signature.view(np.uint64).reshape(len(signature), BANDS, ROWS)
    out = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64)), bits.shape[:2]).copy()
    for k in range(ROWS):
        out = mix(out + bits[:, :, k])
    return out.view(np.int64)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, block in blocks(batch.column("text").to_pylist()):
            w = Words(block)
            some = np.diff(w.first) > 0
            bands = band_hashes(signatures(*bags(w, len(block)), len(block)))[some]
            cuts = pa.array(np.append(0, np.cumsum(some * BANDS)).astype(np.int32))
            part = batch.slice(at, len(block))
            lists = pa.ListArray.from_arrays(cuts, pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("key_id", "key_text", "fp")), lists], names=["key_id", "key_text", "fp", "bands"])


@F.pandas_udf(BinaryType())
def bag(text: pd.Series) -> pd.Series:
    """The sorted shingle hashes of each text as bytes; repeats are told apart by their number, so multisets compare as sets."""
    out: list[bytes] = []
    for _, block in blocks(text.tolist()):
        shingle, doc = bags(Words(block), len(block))
        order = np.lexsort((shingle, doc))
        shingle, doc = shingle[order], doc[order]
        new = np.append(True, (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1]))[: len(doc)]
        at = np.arange(len(doc))
        nth = at - np.maximum.accumulate(np.where(new, at, 0)) if len(doc) else at
        told = np.where(nth == 0, shingle, mix(shingle + mix(nth.astype(np.uint64))))
        cuts = np.searchsorted(doc, np.arange(len(block) + 1))
        out += [np.sort(told[a:b]).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
    return pd.Series(out)


@F.pandas_udf(DoubleType())
def overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    """Weighted Jaccard similarity of pairs of bags."""
    out = []
    for x, y in zip(a, b, strict=True):
        p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        if min(len(p), len(q)) < THRESHOLD * max(len(p), len(q)):
            out.append(0.0)
            continue
        both = np.sort(np.concatenate([p, q]), kind="stable")
        same = int((both[1:] == both[:-1]).sum())
        out.append(same / max(len(p) + len(q) - same, 1))
    return pd.Series(out)


def verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The `pairs` (a, b; a table) of documents whose bags overlap enough; a's bag is dealt to groups of its partners."""
    split = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("n"))
    dealt = pairs.join(split, "a").select("a", "b", F.pmod(F.hash("b"), F.col("n")).alias("part"))
    parts = split.select("a", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"))
    if pairs.count() <= BROADCAST_ROWS:
        dealt, parts = F.broadcast(dealt), F.broadcast(parts)
    left = held.select(F.col("doc").alias("a"), F.col("bag").alias("bag_a")).join(parts, "a")
    right = held.select(F.col("doc").alias("b"), F.col("bag").alias("bag_b")).join(dealt, "b")
    return right.join(left, ["a", "part"]).where(overlap("bag_a", "bag_b") >= THRESHOLD).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """Lowest member `low` of the connected component of each node of `edges` (a, b)."""
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "near-edges")
    label = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "near-labels")
    while True:
        # the lowest label next door, then the label of that label: paths halve
        seen = both.join(label.select(F.col("a").alias("b"), "low"), "b").groupBy("a").agg(F.min("low").alias("near"))
        step = label.join(seen, "a").select("a", F.least("low", "near").alias("new"), "low")
        jump = label.select(F.col("a").alias("new"), F.col("low").alias("far"))
        new = cut(step.join(jump, "new", "left").select("a", F.least("new", F.coalesce("far", "new")).alias("low"), F.col("low").alias("was")), "near-labels")
        label = new.select("a", "low")
        if new.where(F.col("low") != F.col("was")).isEmpty():
            return label


@F.pandas_udf(ArrayType(LongType()))
def tokens(bag: pd.Series) -> pd.Series:
    """A bag as a list of numbers."""
    return pd.Series([np.frombuffer(x, np.int64) for x in bag])


def bounded(entries: DataFrame, held: DataFrame) -> DataFrame:
    """Of the open `entries` (bucket, doc, low) those that may still be linked across classes, with `size` and `most`.

    If no document of another class holds u of its n shingles, it overlaps those
    by n - u at most. A similarity of t takes an overlap of t / (1 + t) times both
    sizes, so the other's size is at most `most`, (n - (1 + t) u) / t.
    """
    own = cut(entries.select("doc", "low").distinct().join(held, "doc").select("doc", "low", F.expr("octet_length(bag) div 8").alias("size"), tokens("bag").alias("token")), "near-tokens")
    each = cut(own.select("doc", "low", F.explode("token").alias("token")), "near-token")
    mixed = each.groupBy("token").agg(F.min("low").alias("a"), F.max("low").alias("z")).where("a <> z").select("token")
    shared = each.join(mixed, "token").groupBy("doc").agg(F.count("*").alias("shared"))
    lonely = F.col("size") - F.coalesce("shared", F.lit(0))
    cap = F.floor((F.col("size") - (1 + THRESHOLD) * lonely) / THRESHOLD + 1e-6)
    known = entries.join(own.join(shared, "doc", "left").select("doc", "size", cap.alias("most")), "doc")
    least = known.groupBy("bucket").agg(F.min("size").alias("least"))
    return known.join(least, "bucket").where("most >= least").drop("least")


def _links(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Pairs (a, b) of different classes, a of `left` and b of `right`, whose bags overlap enough: counts of common tokens by matrix products."""
    ys = [np.frombuffer(x, np.uint64) for x in right["bag"]]
    xs = [np.frombuffer(x, np.uint64) for x in left["bag"]]
    known = np.unique(np.concatenate(ys)) if ys else np.zeros(0, np.uint64)
    if not len(known) or not xs:
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    n_y, low_y, doc_y = np.array([len(y) for y in ys]), right["low"].to_numpy(), right["doc"].to_numpy()
    common = np.zeros((len(xs), len(ys)), np.float32)
    for lo in range(0, len(known), TOKENS):  # so that very long texts make no larger matrices
        part = known[lo : lo + TOKENS]
        within = lambda x: x[np.searchsorted(x, part[0]) : np.searchsorted(x, part[-1], "right")]  # noqa: E731, B023
        have = np.zeros((len(part), len(ys)), np.float32)
        for k, y in enumerate(ys):
            have[np.searchsorted(part, within(y)), k] = 1
        step = max(1, 4_000_000 // len(part))
        for i in range(0, len(xs), step):
            mine = np.zeros((min(step, len(xs) - i), len(part)), np.float32)
            for k, x in enumerate(xs[i : i + step]):
                x = within(x)
                at = np.minimum(np.searchsorted(part, x), len(part) - 1)
                mine[k, at[part[at] == x]] = 1
            common[i : i + step] += mine @ have
    n_x = np.array([len(x) for x in xs])[:, None]
    near = (common >= THRESHOLD * (n_x + n_y[None, :] - common) - 1e-4) & (left["low"].to_numpy()[:, None] != low_y[None, :])
    found = [(int(left["doc"].iloc[r]), int(doc_y[c])) for r, c in zip(*np.nonzero(near), strict=True)]
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def block_links(rest: DataFrame, held: DataFrame) -> DataFrame:
    """Links (a, b) between documents of different classes within the buckets of `rest` (bucket, doc, low).

    The members outside a bucket's largest class are its queries: in blocks they
    meet all members, in blocks too, so no pairs are listed but those linked.
    """
    sizes = rest.groupBy("bucket", "low").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"), F.max_by("low", F.struct("n", "low")).alias("major"), F.max("n").alias("of_major"))
    blocks_of = sizes.select("bucket", "major", F.ceil(F.col("n") / MEMBERS).cast("int").alias("xs"), F.ceil((F.col("n") - F.col("of_major")) / QUERIES).cast("int").alias("ys"))
    every = cut(rest.select("bucket", "doc", "low").join(blocks_of, "bucket"), "near-blocks")
    place = lambda n: F.pmod(F.hash("doc"), F.col(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    bags_ = held.select("doc", "bag")
    left = every.select("bucket", "doc", "low", place("xs").alias("x"), all_of("ys").alias("y")).join(bags_, "doc")
    right = every.where("low <> major").select("bucket", "doc", "low", place("ys").alias("y"), all_of("xs").alias("x")).join(bags_, "doc")
    key = ["bucket", "x", "y"]
    left, right = (d.select(*(F.col(c).alias(f"{side}{c}") for c in (*key, "doc", "low", "bag"))).toDF(*key, "doc", "low", "bag") for side, d in (("l", left), ("r", right)))
    pairs = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_links, "a long, b long")
    return pairs.distinct()


def near_classes(docs: DataFrame) -> DataFrame:
    """Class of each row: row key, `doc`, a number for each distinct word sequence, and `class`, the lowest number of its class."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select(*row_key(), F.unhex(F.md5(F.array_join(words(F.col("text")), " "))).alias("fp"), F.coalesce("text", F.lit("")).alias("text"))
    banded = cut(keyed.mapInArrow(_banded, f"key_id {kind}, key_text long, fp binary, bands array<long>"), "near-bands")
    # the lowest row key of equal texts lends its text
    first = F.struct(F.col("key_id").isNull().alias("none"), "key_id", "key_text")
    distinct = banded.groupBy("fp").agg(F.min(first).alias("lead"))
    number = cut(distinct.select("fp", "lead.key_id", "lead.key_text", F.monotonically_increasing_id().alias("doc")), "near-numbers")
    prints = cut(banded.select("key_id", "key_text", "fp").join(number.select("fp", "doc"), "fp").select("key_id", "key_text", "doc"), "near-prints")
    entries = join_by(banded.select("key_id", "key_text", "bands"), number.select("key_id", "key_text", "doc"), ["key_id", "key_text"], "inner")
    entries = cut(entries.select("doc", F.explode("bands").alias("bucket")), "near-entries")
    shared = cut(entries.groupBy("bucket").agg(F.min("doc").alias("a"), F.max("doc").alias("z")).where("a <> z").select("bucket"), "near-shared")
    live = cut(entries.join(small_side(shared, BROADCAST_ROWS), "bucket", "left_semi").distinct(), "near-buckets")
    size = live.groupBy("bucket").agg(F.count("*").alias("met"))
    central = cut(live.join(size, "bucket").groupBy("doc").agg(F.sum("met").alias("met")), "near-central")
    lead = cut(number.join(central.select("doc"), "doc").select("doc", "key_id", "key_text"), "near-leads")
    held = join_by(docs.select(*row_key(), "text"), small_side(lead, BROADCAST_ROWS), ["key_id", "key_text"], "inner").select("doc", "text")
    held = cut(held.dropDuplicates(["doc"]).select("doc", bag("text").alias("bag")), "near-bags")
    label = central.select("doc", "met", F.col("doc").alias("low"))
    for k in range(PIVOT_ROUNDS + 1):
        known = live.join(label, "doc")
        order = F.struct(-F.col("met"), F.col("doc"))
        open_ = known.groupBy("bucket").agg(F.min("low").alias("a"), F.max("low").alias("z"), F.min(F.struct(order.alias("o"), "low")).alias("p")).where("a <> z")
        met = cut(known.join(open_.select("bucket", F.col("p.o.doc").alias("pivot"), F.col("p.low").alias("pivot_low")), "bucket"), "near-open")
        if met.isEmpty():
            break
        if k < PIVOT_ROUNDS:
            pairs = cut(met.where("low <> pivot_low").select(F.col("pivot").alias("a"), F.col("doc").alias("b")).distinct(), "near-pairs")
            links = cut(verified(pairs, held), "near-links")
        else:
            rest = bounded(met.select("bucket", "doc", "low"), held)
            mixed = rest.groupBy("bucket").agg(F.min("low").alias("a"), F.max("low").alias("z")).where("a <> z").select("bucket")
            links = cut(block_links(cut(rest.join(mixed, "bucket"), "near-rest"), held), "near-links")
        live = met.where("doc <> pivot").select("bucket", "doc")
        if links.isEmpty():
            continue
        # classes linked by a pair become one
        of = lambda c: label.select(F.col("doc").alias(c), F.col("low").alias(f"low_{c}"))
        merged = components(links.join(of("a"), "a").join(of("b"), "b").select(F.col("low_a").alias("a"), F.col("low_b").alias("b")))
        merged = merged.select(F.col("a").alias("low"), F.col("low").alias("into"))
        label = cut(label.join(merged, "low", "left").select("doc", "met", F.coalesce("into", "low").alias("low")), "near-classes")
    return prints.join(label, "doc", "left").select("key_id", "key_text", "doc", F.coalesce("low", "doc").alias("class"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and class_size for each row of `docs` (doc_id, text; other columns are ignored).

    Documents are of one class if they have the same words in order, or are
    linked, also by way of others, by shingle multisets with a weighted Jaccard
    similarity of at least 0.8. class_id is the lowest doc_id of the class (null
    if no member has an id); class_size counts rows. Null and empty texts have no
    words, so they are copies of each other. An empty table gives an empty table.
    """
    rows = cut(near_classes(docs), "near-rows")
    named = rows.groupBy("class").agg(F.min("key_id").alias("class_id"), F.count("*").alias("class_size"))
    return rows.join(named, "class").select(F.col("key_id").alias("doc_id"), "class_id", "class_size")


def one_of_each(docs: DataFrame) -> DataFrame:
    """`docs` without near-duplicates: of each class the row with the lowest doc_id stays (nulls last), of equal rows one."""
    rows = cut(near_classes(docs), "near-rows")
    keeper = rows.groupBy("class").agg(F.min(F.struct(F.col("key_id").isNull().alias("none"), "key_id", "key_text")).alias("k")).select("k.key_id", "k.key_text")
    packed = docs.select(F.struct("*").alias("row"), *row_key())
    return join_by(packed, keeper.distinct(), ["key_id", "key_text"], "inner").dropDuplicates(["key_id", "key_text"]).select("row.*")
