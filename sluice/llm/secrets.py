"""Secret scan: fixed patterns, and a small character network for what they miss.

Candidates are tokens of 8 or more characters, each with the characters around
it. A convolutional network tells secrets from others: candidates that hold the
value of a pattern's span are the labelled secrets, the others are not, and prose,
prose in capitals and tokens with digits weigh alike where there are many of each. Beside the characters the network
is told how unusual the pairs of neighbouring letters are.

All windows take part. A first pass counts the pairs of all texts and lays out all
secrets; a bounded sample of it gives the network's starting point only. A second
pass takes all texts in STEPS parts, each a step of Adam on the squared hinge loss
of all its windows, so that those told with a margin have no slope and the backward
pass is over the rest. A third scores every candidate, and its calibration and
threshold are those of all windows kept back, a fifth by hash; the threshold keeps
the wanted recall there, and is lower where no others of that part come near.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructType

from sluice.llm.common import cut
from sluice.llm.hashing import blocks, mix

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_.=-]{8,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEFT, VALUE, RIGHT = 16, 40, 8
WIDTH = LEFT + VALUE + RIGHT
#: Windows of a candidate longer than VALUE start so many characters apart.
STEP = VALUE // 2
SECRET, DIGITS, PLAIN, UNSURE, CAPITALS = range(5)
LABELS = (SECRET, DIGITS, PLAIN, CAPITALS)
#: The network starts from a fit on at most this many windows of each label: those with the lowest hash.
MAX_FINDINGS = 3000
RECALL = 0.95
#: Steps that the pass over all texts takes, how far each goes, and the margin (in logits) beyond which a window has no slope.
STEPS, STEP_SIZE, MARGIN = 8, 0.004, 3.0
#: Scores are compared in steps of one part in so many of a logit, up to MAX_LOGIT.
BINS, MAX_LOGIT = 64, 60
#: Altered copies of each secret kept back.
BACK_COPIES = 4
#: Windows that are cut out or scored at once.
CHUNK = 65_536
_CODE = np.zeros(128, np.int64)
_CODE[32:127] = np.arange(1, 96)
#: Codes with capitals as small letters.
_FOLD = np.arange(96)
_FOLD[_CODE[65:91]] = _CODE[97:123]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' spans in order, leftmost and not overlapping within a kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def codes(windows: list[bytes]) -> np.ndarray:
    return _CODE[np.frombuffer(b"".join(windows), np.uint8)].reshape(len(windows), WIDTH)


@dataclass
class Scan:
    """Patterns' spans of some texts, and their candidates: number of the text, start, end, and whether a span touches it.

    Each candidate has windows (`token`, its number, and `raw`, 64 bytes): the
    characters before, VALUE characters of it, and those behind, at fixed
    places, NUL where there are none. A longer candidate has several, which
    overlap by half. `label` of a window is SECRET where it holds part of a
    span's value, UNSURE in other windows of touched candidates, and for the rest
    DIGITS, CAPITALS (without digits, a capital behind the first place) or PLAIN.
    """

    spans: list[list[tuple[int, int, int]]]
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    known: np.ndarray
    token: np.ndarray
    raw: np.ndarray
    label: np.ndarray


def scan(texts: list[str]) -> Scan:
    spans = [base_spans(t) for t in texts]
    raw = [t.encode("ascii", "replace") for t in texts]
    gap = b"\0" * LEFT
    data = gap + gap.join([*raw, b""])
    first = LEFT + np.append(0, np.cumsum([len(r) + LEFT for r in raw]))
    at = np.array([m.span() for m in CANDIDATE.finditer(data)], np.int64).reshape(-1, 2)
    start, end = at[:, 0], at[:, 1]
    many = 1 + -(-np.maximum(end - start - VALUE, 0) // STEP)
    token = np.repeat(np.arange(len(at)), many)
    lead = np.append(0, np.cumsum(many))
    nth = np.arange(len(token)) - lead[token]
    w_start = np.minimum(start[token] + STEP * nth, np.maximum(end - VALUE, start)[token])
    w_end = np.minimum(w_start + VALUE, end[token])
    buf = np.frombuffer(data + bytes(WIDTH), np.uint8)
    window, label = np.empty((len(token), WIDTH), np.uint8), np.empty(len(token), np.int64)
    for i in range(0, len(token), CHUNK):  # so that a very long text needs few more bytes than its windows have
        some, a, b = window[i : i + CHUNK], w_start[i : i + CHUNK, None], w_end[i : i + CHUNK, None]
        some[:, :LEFT] = buf[a + np.arange(-LEFT, 0)]
        place = a + np.arange(VALUE)
        some[:, LEFT : LEFT + VALUE] = np.where(place < b, buf[place], 0)
        some[:, LEFT + VALUE :] = buf[b + np.arange(RIGHT)]
        value = some[:, LEFT : LEFT + VALUE]
        capital = ((value[:, 1:] >= 65) & (value[:, 1:] <= 90)).any(1)
        label[i : i + CHUNK] = np.where(((value >= 48) & (value <= 57)).any(1), DIGITS, np.where(capital, CAPITALS, PLAIN))
    known, secret = np.zeros(len(at), bool), np.zeros(len(token), bool)
    for k, found in enumerate(spans):
        for a, kind, b in found:
            low, high = np.searchsorted(end, first[k] + a, "right"), np.searchsorted(start, first[k] + b, "left")
            known[low:high] = True
            some = slice(lead[low], lead[max(high, low)])
            told = ASSIGN.match(texts[k], a).start(2) if kind == 0 else a
            secret[some] |= (w_start[some] < first[k] + b) & (first[k] + told < w_end[some])
    label = np.where(secret, SECRET, np.where(known[token], UNSURE, label))
    doc = np.searchsorted(first, start, "right") - 1
    return Scan(spans, doc, start - first[doc], end - first[doc], known, token, window, label)


def ranks(raw: np.ndarray) -> np.ndarray:
    """A hash of each window, from 0 on."""
    rank = np.zeros(len(raw), np.uint64)
    for part in raw.view(np.uint64).T:
        rank = mix(rank * np.uint64(3) + part)
    return (rank >> np.uint64(1)).astype(np.int64)


def kept_back(rank: np.ndarray) -> np.ndarray:
    """Windows that no weight is fitted on: a fifth, whatever label they have."""
    return mix(rank.view(np.uint64)) % np.uint64(5) == 0


def pair_counts(x: np.ndarray) -> np.ndarray:
    """How often each pair of codes, without regard to capitals, stands in the values of rows `x` (96 x 96, flat)."""
    value = _FOLD[x[:, LEFT : LEFT + VALUE]]
    a, b = value[:, :-1].ravel(), value[:, 1:].ravel()
    return np.bincount((a * 96 + b)[b > 0], minlength=96 * 96)


def pair_table(counts: np.ndarray) -> np.ndarray:
    """By pair of codes (96 x 96, flat) minus the logarithm of the second's share after the first, less its mean; 0 at the end of a value."""
    n = counts.reshape(96, 96).astype(float)
    share = (n + 0.5) / (n.sum(1, keepdims=True) + 0.5 * 40)
    out = -np.log(share)
    out -= (n * out).sum() / max(n.sum(), 1)
    out = out[_FOLD][:, _FOLD]
    out[0], out[:, 0] = 0, 0
    return out.ravel().astype(np.float32)


def unusual_pairs(x: np.ndarray) -> np.ndarray:
    """The `pair_table` of the values of rows `x`."""
    return pair_table(pair_counts(x))


def unusual(pairs: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each row the mean of `pairs` over its value, and their sum over the root of their number."""
    v = x[:, LEFT : LEFT + VALUE]
    n = np.maximum((v[:, 1:] > 0).sum(1), 1)
    total = pairs.take(v[:, :-1] * 96 + v[:, 1:]).sum(1)
    return np.stack([total / n, total / np.sqrt(n) / 4], axis=1)


@dataclass
class Net:
    """Characters -> embedding -> convolution -> maximum and mean over places -> logistic unit, which also takes how unusual pairs are; `scale`, `shift` calibrate it."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    pairs: np.ndarray
    by_pairs: np.ndarray
    out_bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 2.0
    #: Unlabelled windows as unusual as this are taken for neither.
    doubt: float = np.inf

    def columns(self, x: np.ndarray) -> np.ndarray:
        e = self.embed[x]
        width = self.kernel.shape[0] // e.shape[2]
        return np.concatenate([e[:, k : x.shape[1] - width + 1 + k] for k in range(width)], axis=2)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        cols = self.columns(x)
        act = np.maximum(cols @ self.kernel + self.bias, 0)
        return np.concatenate([act.max(1), act.mean(1)], axis=1), act, cols

    def logit(self, x: np.ndarray) -> np.ndarray:
        """As by `pooled`, from tables of what each pair of neighbouring characters adds to the convolution (of width 5)."""
        one = [(self.embed @ k).astype(np.float32) for k in np.split(self.kernel, 5)]
        pair = lambda a, b: (a[:, None] + b[None]).reshape(-1, a.shape[1])
        ab, cd, e = pair(one[0], one[1]), pair(one[2], one[3]), one[4] + self.bias.astype(np.float32)
        out = self.out.astype(np.float32)
        parts = []
        for i in range(0, len(x), 128):
            c = x[i : i + 128]
            two = c[:, :-1] * len(self.embed) + c[:, 1:]
            act = ab.take(two[:, :-3], 0)
            act += cd.take(two[:, 2:-1], 0)
            act += e.take(c[:, 4:], 0)
            np.maximum(act, 0, out=act)
            parts.append(act.max(1) @ out[: act.shape[2]] + act.mean(1) @ out[act.shape[2] :] + unusual(self.pairs, c) @ self.by_pairs + self.out_bias)
        return np.concatenate(parts) if parts else np.zeros(0)

    def gradients(self, x: np.ndarray, slope: Callable[[np.ndarray], np.ndarray]) -> dict[str, np.ndarray]:
        """Of each of WEIGHTS, summed over rows of codes whose loss has the slopes `slope(logits)`."""
        pooled, act, cols = self.pooled(x)
        told = unusual(self.pairs, x)
        slopes = slope(pooled @ self.out + told @ self.by_pairs + self.out_bias)
        filters, size = act.shape[2], self.embed.shape[1]
        back = np.outer(slopes, self.out)
        grad_act = np.broadcast_to(back[:, None, filters:] / act.shape[1], act.shape).copy()
        top = act.argmax(1)
        np.add.at(grad_act, (np.arange(len(x))[:, None], top, np.arange(filters)), back[:, :filters])
        grad_act *= act > 0
        grad_cols = grad_act @ self.kernel.T
        grad_embed = np.zeros_like(self.embed)
        for k in range(self.kernel.shape[0] // size):
            np.add.at(grad_embed, x[:, k : k + act.shape[1]], grad_cols[:, :, k * size : (k + 1) * size])
        return {"embed": grad_embed, "kernel": np.tensordot(cols, grad_act, ((0, 1), (0, 1))), "bias": grad_act.sum((0, 1)), "out": pooled.T @ slopes, "by_pairs": told.T @ slopes, "out_bias": slopes.sum()}

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability of being a secret, by rows of codes."""
        z = self.scale * self.logit(x) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


WEIGHTS = ("embed", "kernel", "bias", "out", "by_pairs")


class Adam:
    """Steps of Adam on the weights of a network; the bias of its output goes down its slope."""

    def __init__(self, net: Net) -> None:
        self.slots = {k: [np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))] for k in WEIGHTS}
        self.t = 0

    def step(self, net: Net, grads: dict[str, np.ndarray], size: float) -> None:
        self.t += 1
        for k, (m, v) in self.slots.items():
            g = grads[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            setattr(net, k, getattr(net, k) - size * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8))
        net.out_bias -= 5 * size * float(grads["out_bias"])


#: Letters of keys: those of hexadecimal keys are what the patterns find, others are not.
ALPHABETS = [_CODE[np.frombuffer(x, np.uint8)] for x in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", b"abcdefghijklmnopqrstuvwxyz0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")]


def altered(secrets: np.ndarray, others: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The windows `secrets` cut to 8 or more characters and spelt in other letters, every second one in the surroundings of one of `others`."""
    out = secrets.copy()
    value = out[:, LEFT : LEFT + VALUE]
    for k, row in enumerate(value):
        n = int((row > 0).sum())
        row[:n] = rng.choice(ALPHABETS[rng.integers(len(ALPHABETS))], n)
        row[rng.integers(min(8, n), n + 1) :] = 0
    moved = np.arange(len(out)) % 2 == 0
    return surrounded(out, others, moved, rng)


def surrounded(secrets: np.ndarray, others: np.ndarray, moved: np.ndarray, rng: np.random.Generator, which: np.ndarray | None = None) -> np.ndarray:
    """`secrets`, the `moved` ones of them in the surroundings of some of `others`, those numbered `which` if given."""
    out, by = secrets.copy(), others[rng.choice(len(others), len(secrets)) if which is None else which]
    out[moved, :LEFT], out[moved, LEFT + VALUE :] = by[moved, :LEFT], by[moved, LEFT + VALUE :]
    return out


def fit(windows: list[bytes], labels: np.ndarray, rounds: int = 12, size: int = 8, filters: int = 24, seed: int = 11, counts: np.ndarray | None = None) -> Net | None:
    """A network fitted by Adam on four fifths of the findings, calibrated on the rest; none unless either label has 10. `counts` of pairs are those of the findings unless given."""
    if min(labels.sum(), (1 - labels).sum()) < 10:
        return None
    width, rng = 5, np.random.default_rng(seed)
    x, y = codes(windows), labels.astype(float)
    order = rng.permutation(len(y))
    x, y = x[order], y[order]
    kept = np.arange(len(y)) % 5 == 0
    tx, ty, vx, vy = x[~kept], y[~kept], x[kept], y[kept]
    # a secret is one also without its telling context, when short and in other letters than the patterns': secrets are repeated so
    secret, other = np.flatnonzero(ty == 1), np.flatnonzero(ty == 0)
    moved = surrounded(tx[secret], tx[other], np.ones(len(secret), bool), rng)
    more = altered(np.repeat(tx[secret], max(2, MAX_FINDINGS // len(secret)), 0), tx[other], rng)
    n_altered = len(more)
    tx, ty = np.concatenate([tx, moved, more]), np.append(ty, np.ones(len(moved) + len(more)))
    # so are those kept back: the recall is to hold for secrets that no pattern finds
    both = min(vy.sum(), (1 - vy).sum()) > 0
    more = altered(np.repeat(vx[vy == 1], 4, 0), vx[vy == 0], rng) if both else vx[:0]
    vx, vy, own = np.concatenate([vx, more]), np.append(vy, np.ones(len(more))), np.append(vy == 1, np.zeros(len(more), bool))
    # unlabelled tokens as unusual as keys are may be keys: they are taken for neither
    pairs = unusual_pairs(tx[ty == 0]) if counts is None else pair_table(counts)
    doubt = np.quantile(unusual(pairs, tx[ty == 1])[-n_altered:, 1], 1 - RECALL)
    tx, ty = (v[(ty == 1) | (unusual(pairs, tx)[:, 1] < doubt)] for v in (tx, ty))
    weight = np.where(ty == 1, len(ty) / (2 * ty.sum()), len(ty) / (2 * (len(ty) - ty.sum())))
    net = Net(rng.normal(0, 0.3, (96, size)), rng.normal(0, 0.2, (width * size, filters)), np.zeros(filters), rng.normal(0, 0.2, 2 * filters), pairs, np.zeros(2), doubt=float(doubt))
    adam = Adam(net)
    for _ in range(rounds):
        for rows in np.array_split(rng.permutation(len(ty)), max(1, len(ty) // 64)):
            slope = lambda z, rows=rows: (1 / (1 + np.exp(-np.clip(z, -30, 30))) - ty[rows]) * weight[rows] / len(rows)
            adam.step(net, net.gradients(tx[rows], slope), 0.004)
    z = net.logit(vx)
    for _ in range(300):  # calibration of the logits by logistic regression
        p = 1 / (1 + np.exp(-np.clip(net.scale * z + net.shift, -30, 30)))
        net.scale -= 0.05 * float(np.mean((p - vy) * z) / max(np.mean(z * z), 1e-9))
        net.shift -= 0.5 * float(np.mean(p - vy))
    p = 1 / (1 + np.exp(-np.clip(net.scale * z + net.shift, -30, 30)))
    kept_back = [np.sort(x) for x in (p[own], p[(vy == 1) & ~own]) if len(x)]
    wanted = min((float(x[int(np.floor((1 - RECALL) * len(x)))]) for x in kept_back), default=2.0)
    # below what the recall needs where the kept-back others leave room: half way, by odds, to the highest of them or to even odds
    odds = lambda q: q / max(1 - q, 1e-13)
    other = max([0.5, *p[(vy == 0) & (unusual(pairs, vx)[:, 1] < doubt)].tolist()])
    middle = np.sqrt(odds(wanted) * odds(other)) if other < wanted <= 1 else None
    net.threshold = wanted if middle is None else float(middle / (1 + middle))
    return net


_SPANS = ArrayType(StructType().add("kind", StringType()).add("start", IntegerType()).add("end", IntegerType()))


def batches_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
    for batch in batches:
        for _, block in blocks(batch.column(batch.schema.get_field_index("text")).to_pylist()):
            yield block


@dataclass
class Sums:
    """What a pass over all texts counts: `pairs`, by label of others the pairs of codes in windows to fit on, `windows`, their number by label, and `secrets`, a table of all distinct windows of secrets: rank, around, and other, a window of its text that is none."""

    pairs: np.ndarray
    windows: dict[int, int]
    secrets: DataFrame


def sample(docs: DataFrame, max_findings: int = MAX_FINDINGS) -> tuple[list[bytes], np.ndarray, Sums]:
    """For each label the distinct windows to fit on with the lowest hashes, at most `max_findings`, and whether they are secrets; and the sums of all windows.

    Each task keeps the lowest of its own. What of them is above the cut is told
    from counts by rank, so that few more than wanted reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda label, rank, around, other, n: pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(rank, pa.int64()), pa.array(around, pa.binary()), pa.array(other, pa.binary()), pa.array(n, pa.int64())], names=["label", "rank", "around", "other", "n"])
        held = {label: (np.zeros(0, np.int64), np.zeros((0, WIDTH), np.uint8)) for label in LABELS[1:]}
        pairs, windows = {label: np.zeros(96 * 96, np.int64) for label in held}, dict.fromkeys(held, 0)
        for block in batches_of_texts(batches):
            s = scan(block)
            rank = ranks(s.raw)
            free = ~kept_back(rank)
            for label, (low, raw) in held.items():
                own = free & (s.label == label)
                windows[label] += int(own.sum())
                for some in np.split(np.flatnonzero(own), range(CHUNK, len(rank), CHUNK)):
                    pairs[label] += pair_counts(_CODE[s.raw[some]])
                new = own & (rank < (low[-1] if len(low) == max_findings else np.iinfo(np.int64).max))
                low, at = np.unique(np.append(low, rank[new]), return_index=True)
                held[label] = low[:max_findings], np.concatenate([raw, s.raw[new]])[at[:max_findings]]
            secret = np.flatnonzero(s.label == SECRET)
            if len(secret):
                # another window of the same text, which depends on that text alone
                doc, none = s.doc[s.token], np.flatnonzero((s.label != SECRET) & (s.label != UNSURE))
                low, high = (np.searchsorted(doc[none], doc[secret], side) for side in ("left", "right"))
                by = np.where(high > low, np.append(none, 0)[low + rank[secret] % np.maximum(high - low, 1)], secret)
                yield row([SECRET] * len(secret), rank[secret], [r.tobytes() for r in s.raw[secret]], [r.tobytes() for r in s.raw[by]], [0] * len(secret))
        for label, (low, raw) in held.items():
            yield row([label] * len(low), low, [r.tobytes() for r in raw], [None] * len(low), [0] * len(low))
            some = np.flatnonzero(pairs[label])
            yield row([-1 - label] * (len(some) + 1), [*some.tolist(), -1], [None] * (len(some) + 1), [None] * (len(some) + 1), [*pairs[label][some].tolist(), windows[label]])

    each = cut(docs.select("text").mapInArrow(run, "label int, rank long, around binary, other binary, n long"), "secret-findings")
    pairs, windows = np.zeros((len(LABELS) + 1, 96 * 96)), dict.fromkeys(LABELS[1:], 0)
    for r in each.where("label < 0").groupBy("label", "rank").agg(F.sum("n").alias("n")).collect():
        if r["rank"] < 0:
            windows[-1 - r["label"]] = r["n"]
        else:
            pairs[-1 - r["label"], r["rank"]] = r["n"]
    # of equal windows in several texts the least other one
    distinct = cut(each.where("label >= 0").groupBy("label", "rank", "around").agg(F.min("other").alias("other")), "secret-sample")
    secrets = distinct.where(F.col("label") == SECRET).select("rank", "around", "other")
    # secrets kept back are left out: the share to take of them is told by counts alone
    bucket = F.floor(16 * F.log2(F.col("rank") + 1.0)).cast("int")
    top: dict[int, int] = {}
    total = dict.fromkeys(LABELS, 0)
    for r in sorted(distinct.groupBy("label", bucket.alias("bucket")).count().collect()):
        if total[r["label"]] < 1.5 * max_findings + 100:
            top[r["label"]] = r["bucket"]
        total[r["label"]] += r["count"]
    wanted = F.lit(False)
    for label, b in top.items():
        wanted = wanted | ((F.col("label") == label) & (bucket <= b))
    rows = sorted((r["label"], r["rank"], bytes(r["around"])) for r in distinct.where(wanted).select("label", "rank", "around").collect())
    free = ~kept_back(np.array([r[1] for r in rows], np.int64))
    rows = [r for r, f in zip(rows, free.tolist(), strict=True) if f]
    rows = [r for label in total for r in [r for r in rows if r[0] == label][:max_findings]]
    return [r[2] for r in rows], np.array([r[0] == SECRET for r in rows], bool), Sums(pairs, windows, secrets)


def copies(raw: np.ndarray, other: np.ndarray, rank: np.ndarray, many: int) -> np.ndarray:
    """`many` altered copies of each window, in turn in its own surroundings and in those of its other; they depend on the window alone."""
    out = [altered(np.repeat(raw[k : k + 1], many, 0), other[k : k + 1], np.random.default_rng(int(rank[k]))) for k in range(len(raw))]
    return np.concatenate(out) if out else raw[:0]


def secret_parts(batches: Iterator[pa.RecordBatch], back: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Codes, codes of the others, and ranks of the secrets that are, or are not, kept back."""
    for batch in batches:
        rank = np.array(batch.column(0).to_pylist(), np.int64)
        some = np.flatnonzero(kept_back(rank) == back)
        if len(some):
            yield *(codes(batch.column(c).take(pa.array(some)).to_pylist()) for c in (1, 2)), rank[some]


def binned(z: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(z, -MAX_LOGIT, MAX_LOGIT) * BINS).astype(np.int32)


def counted(rows: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """By kind the bins in order, and how many rows (kind, bin) have each."""
    out: dict[str, list[tuple[int, int]]] = {}
    for r in rows.groupBy("kind", "bin").count().collect():
        out.setdefault(r["kind"], []).append((r["bin"], r["count"]))
    return {k: tuple(np.array(c) for c in zip(*sorted(v), strict=True)) for k, v in out.items()}


def quantile(bins: np.ndarray, n: np.ndarray, share: float) -> int:
    """The bin of the row before which `share` of all lie."""
    return int(bins[np.searchsorted(np.cumsum(n), int(np.floor(share * n.sum())), "right")])


def learn(docs: DataFrame, max_findings: int = MAX_FINDINGS) -> tuple[Net, Sums] | None:
    """The network fitted to all windows of `docs` that aren't kept back, not yet calibrated; none if either label has too few."""
    windows, labels, sums = sample(docs, max_findings)
    # shapes of others weigh alike, but for those with few windows, in the table of pairs as in the fit
    most = {label: min(n, max_findings) for label, n in sums.windows.items()}
    shares = {label: n / max(sum(most.values()), 1) for label, n in most.items()}
    counts = sum(shares[k] * sums.pairs[k] / max(sums.pairs[k].sum(), 1) for k in shares) * sums.pairs.sum()
    net = fit(windows, labels, counts=counts)
    if net is None:
        return None
    n_secrets = sums.secrets.count()
    many = max(2, MAX_FINDINGS // max(n_secrets, 1))
    pairs = net.pairs

    def doubts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for raw, other, rank in secret_parts(batches, False):
            bins = binned(unusual(pairs, copies(raw, other, rank, many))[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(["doubt"] * len(bins)), pa.array(bins)], names=["kind", "bin"])

    net.doubt = quantile(*counted(sums.secrets.mapInArrow(doubts, "kind string, bin int"))["doubt"], 1 - RECALL) / BINS
    adam = Adam(net)
    for step in range(STEPS):
        grads, _ = step_gradients(docs.where(F.pmod(F.xxhash64("text"), F.lit(STEPS)) == step), sums, net, many, n_secrets * (2 + many), shares)
        adam.step(net, grads, STEP_SIZE)
    return net, sums


def step_gradients(docs: DataFrame, sums: Sums, net: Net, many: int, n_positive: int, shares: dict[int, float]) -> tuple[dict[str, np.ndarray], float]:
    """Gradients and loss of a step: all windows of `docs` that aren't secrets, as a part of STEPS, against all secrets."""
    shapes = {k: np.shape(getattr(net, k)) for k in (*WEIGHTS, "out_bias")}
    weight = np.zeros(len(LABELS) + 1)
    for label, n in sums.windows.items():
        weight[label] = STEPS * shares[label] / (2 * max(n, 1))
    scale = float(1 << 40)

    def slopes(x: np.ndarray, y: int, w: np.ndarray, total: np.ndarray) -> None:
        short = np.flatnonzero(y * net.logit(x) < MARGIN)
        for at in np.split(short, range(256, len(short), 256)):
            if len(at):
                loss: list[float] = []

                def slope(z: np.ndarray, at=at, loss=loss) -> np.ndarray:
                    gap = np.maximum(MARGIN - y * z, 0)
                    loss.append(float((gap * gap * w[at]).sum() / 2))
                    return -y * gap * w[at]

                total += np.concatenate([np.ravel(g) for g in net.gradients(x[at], slope).values()] + [loss])

    def out(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        # whole numbers, whose sum doesn't depend on the order
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(np.rint(total * scale).astype(np.int64))], names=["i", "v"])

    size = sum(int(np.prod(x)) for x in shapes.values()) + 1

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for block in batches_of_texts(batches):
            s = scan(block)
            own = np.flatnonzero((weight[s.label] > 0) & ~kept_back(ranks(s.raw)))
            for some in np.split(own, range(CHUNK, len(own), CHUNK)):
                x = _CODE[s.raw[some]]
                told = unusual(net.pairs, x)[:, 1] < net.doubt
                slopes(x[told], -1, weight[s.label[some[told]]], total)
        return out(total)

    def secrets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for raw, other, rank in secret_parts(batches, False):
            moved = surrounded(raw, other, np.ones(len(raw), bool), np.random.default_rng(0), np.arange(len(raw)))
            x = np.concatenate([raw, moved, copies(raw, other, rank, many)])
            slopes(x, 1, np.full(len(x), 1 / (2 * max(n_positive, 1))), total)
        return out(total)

    schema = "i int, v long"
    both = docs.select("text").mapInArrow(others, schema).unionByName(sums.secrets.mapInArrow(secrets, schema))
    total = np.zeros(size)
    for r in both.groupBy("i").agg(F.sum("v").alias("v")).collect():
        total[r["i"]] = r["v"] / scale
    parts = np.split(total, np.cumsum([int(np.prod(x)) for x in shapes.values()]))
    return {k: p.reshape(shape) for (k, shape), p in zip(shapes.items(), parts, strict=False)}, float(parts[-1][0])


def calibrate(net: Net, positive: tuple[np.ndarray, np.ndarray], negative: tuple[np.ndarray, np.ndarray]) -> None:
    """Sets scale and shift by logistic regression on counted bins, by Newton's method; targets a little inside 0 and 1 keep it finite."""
    z = (np.concatenate([positive[0], negative[0]]) + 0.5) / BINS
    n = np.concatenate([positive[1], negative[1]]).astype(float)
    n1, n0 = positive[1].sum(), negative[1].sum()
    y = np.repeat([(n1 + 1) / (n1 + 2), 1 / (n0 + 2)], [len(positive[0]), len(negative[0])])
    loss = lambda w: float((n * (np.logaddexp(0, w[0] * z + w[1]) - y * (w[0] * z + w[1]))).sum())
    w = np.array([0.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(w[0] * z + w[1], -30, 30)))
        a = np.stack([z, np.ones(len(z))])
        move = np.linalg.solve((a * (n * p * (1 - p))) @ a.T + 1e-9 * np.eye(2), a @ (n * (p - y)))
        far = 1.0
        while far > 1e-6 and loss(w - far * move) > loss(w):
            far /= 2
        w = w - far * move
        if far <= 1e-6 or np.abs(far * move).max() < 1e-9:
            break
    net.scale, net.shift = float(w[0]), float(w[1])


def least_bin(net: Net, sums: Sums, others: tuple[np.ndarray, np.ndarray]) -> int:
    """Calibrates `net` by all windows kept back, of which `others` are counted by bin; the bin from which on a candidate is a secret."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for raw, other, rank in secret_parts(batches, True):
            for kind, x in (("own", raw), ("altered", copies(raw, other, rank, BACK_COPIES))):
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(x)), pa.array(binned(net.logit(x)))], names=["kind", "bin"])

    kinds = counted(sums.secrets.mapInArrow(score, "kind string, bin int"))
    if not kinds:  # no secret was kept back
        return MAX_LOGIT * BINS + 1
    wanted = min(quantile(*k, 1 - RECALL) for k in kinds.values())
    positive = tuple(np.concatenate(x) for x in zip(*kinds.values(), strict=True))
    calibrate(net, positive, others)
    # below what the recall needs where the others leave room: half way to even odds or to the highest of them below it, as single ones above may be keys
    even = int(np.ceil(-net.shift / net.scale * BINS)) if net.scale > 1e-6 else wanted
    near = max([even, *(others[0][others[0] < wanted] + 1).tolist()])
    least = wanted if near >= wanted else (wanted + near) // 2
    net.threshold = float(1 / (1 + np.exp(-np.clip(net.scale * least / BINS + net.shift, -30, 30))))
    return least


def found(texts: list[str], net: Net | None) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of the spans of each text, the network's included; the score of a candidate is the highest of its windows."""
    s = scan(texts)
    open_ = np.flatnonzero(~s.known[s.token]) if net else np.zeros(0, np.int64)
    if len(open_):
        parts = np.split(open_, range(CHUNK, len(open_), CHUNK))
        hit = [part[net.score(_CODE[s.raw[part]]) >= net.threshold] for part in parts]
        for k in np.unique(s.token[np.concatenate(hit)]):
            s.spans[s.doc[k]].append((int(s.start[k]), 3, int(s.end[k])))
    return [sorted(x) for x in s.spans]


#: Columns of the table of scores, beside those of the documents: the patterns' spans and the candidates (start, end, bin of the highest score of a window), three numbers each, and the bins of windows kept back.
_SCORED = ("secret_spans_", "secret_scores_", "secret_back_")


def scored(texts: list[str], net: Net) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What the columns _SCORED hold for each text."""
    s = scan(texts)
    open_ = np.flatnonzero(~s.known[s.token])
    bins, back = np.zeros(len(open_), np.int32), np.zeros(len(open_), bool)
    for i in range(0, len(open_), CHUNK):
        some = open_[i : i + CHUNK]
        x = _CODE[s.raw[some]]
        bins[i : i + CHUNK] = binned(net.logit(x))
        back[i : i + CHUNK] = kept_back(ranks(s.raw[some])) & (unusual(net.pairs, x)[:, 1] < net.doubt)
    token = s.token[open_]
    first = np.flatnonzero(np.diff(token, prepend=-1))
    highest = np.maximum.reduceat(bins, first) if len(first) else bins
    own = token[first]
    table = np.stack([s.start[own], s.end[own], highest], 1)
    at = np.searchsorted(s.doc[own], np.arange(len(texts) + 1))
    of, low = s.doc[token[back]], bins[back]
    at_back = np.searchsorted(of, np.arange(len(texts) + 1))
    return [(np.array(s.spans[k], np.int64).reshape(-1, 3), table[at[k] : at[k + 1]], low[at_back[k] : at_back[k + 1]]) for k in range(len(texts))]


def secret_scan(docs: DataFrame, max_findings: int = MAX_FINDINGS) -> DataFrame:
    """`docs` without text, with `spans`: kind, start and end (code points, end exclusive), by start, then kind.

    Kinds are assign, access and hex for the patterns, and model for candidates
    that the network finds and no pattern's span touches. Null and empty texts
    have no spans. With too few findings of either label, or none of the secrets
    kept back, nothing is added. Equal texts have equal spans. A column of `docs`
    named spans is replaced. `max_findings` bounds what the network starts from.
    """
    docs = docs.drop("spans")
    learnt = learn(docs, max_findings)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    listed = lambda spans: pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in x] for x in spans], kind)
    own = [f for f in docs.schema.fields if f.name != "text"]
    names = [f.name for f in own]
    result = StructType([*own]).add("spans", _SPANS)
    if learnt is None:

        def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spans = [base_spans(t or "") for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), listed(spans)], names=[*names, "spans"])

        return docs.mapInArrow(patterns, result)
    net, sums = learnt

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [x for _, block in blocks(batch.column(batch.schema.get_field_index("text")).to_pylist()) for x in scored(block, net)]
            columns = [pa.array([x[k].astype("<i4").tobytes() for x in scores], pa.binary()) for k in (0, 1)] + [pa.array([x[2].tolist() for x in scores], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), *columns], names=[*names, *_SCORED])

    scores = cut(docs.mapInArrow(score, StructType([*own]).add(_SCORED[0], BinaryType()).add(_SCORED[1], BinaryType()).add(_SCORED[2], ArrayType(IntegerType()))), "secret-scores")
    back = counted(scores.select(F.lit("other").alias("kind"), F.explode(_SCORED[2]).alias("bin")))
    least = least_bin(net, sums, back.get("other", (np.zeros(0, np.int64), np.zeros(0, np.int64))))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for base, more in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in _SCORED[:2]), strict=True):
                found_ = np.frombuffer(more, "<i4").reshape(-1, 3)
                added = [(a, 3, b) for a, b, _ in found_[found_[:, 2] >= least].tolist()]
                spans.append(sorted([*map(tuple, np.frombuffer(base, "<i4").reshape(-1, 3).tolist()), *added]))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), listed(spans)], names=[*names, "spans"])

    return scores.select(*names, *_SCORED[:2]).mapInArrow(pick, result)
