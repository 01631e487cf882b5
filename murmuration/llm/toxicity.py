"""Toxic documents, by a small convolutional network over hashed words.

Words are runs of letters in lower case. A word's embedding is the sum of rows
of one table, at the hashes of the word and of its beginnings of several
lengths, so that forms of one stem share most of it. Filters of several widths
run over the whole text, however long; each filter's largest response (max
pooling) goes to a logistic output. The network learns from every labelled document
outside the held-out fold. They are dealt by id into blocks of about ``BLOCK_ROWS``,
written once as numbers of words. In each pass every block goes on by itself from the
network that all have made together; then what the blocks have changed is averaged, a
row of the table over the blocks that hold its words. Only parameters, whose number is
fixed, reach the driver. One in ten labelled documents is set aside to find, for each
language, the threshold at which its documents are flagged; the score itself
never sees language, source, id or label.

Null and empty texts have no words and the score of a silent network. Null
labels do not count; a document labelled several times is toxic if any label
says so, and learnt from once, by the least of its texts. Without labels of both
kinds the score is constant. Rows that repeat an id, or have none, are scored one
by one; other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import copy
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from murmuration.llm.boosting import sigmoid
from murmuration.llm.common import Batches, held_out, is_held_out, map_rows, pieces, spread, stored, text_of
from murmuration.operators.attach import attach
from murmuration.plans.stage import materialize

#: Documents of a block, about, and characters after which another one is begun.
BLOCK_ROWS = 6_000
BLOCK_CHARS = 16_000_000
#: Passes over the documents: as many as show the network about ``SHOWN``, within bounds.
SHOWN = 48_000
PASSES = (4, 8)
#: Rows of the table that are averaged together.
PIECE = 512
#: Scores that thresholds tell apart.
LEVELS = 1 << 12
THRESHOLD = 0.5
BUCKETS = 1 << 15
SIZE = 8
WIDTHS = (1, 2, 3)
FILTERS = 4
HASHES = 4
CACHED_WORDS = 250_000
WORD = re.compile(r"[^\W\d_]+")


def buckets(word: str) -> tuple[int, ...]:
    """Rows of the table: of the word's beginnings by bytes, each hash going on
    from the one before, and of the word, told from a beginning by an end mark."""
    raw = word.encode()
    a = zlib.crc32(raw[:4])
    b = zlib.crc32(raw[4:5], a)
    c = zlib.crc32(raw[5:6], b)
    whole = zlib.crc32(raw[6:] + b"$", c)
    return a % BUCKETS, b % BUCKETS, c % BUCKETS, whole % BUCKETS


class _Numbers(dict):
    """Words by the order in which they are met."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.fresh.append(word)
        return at


@dataclass
class Network:
    table: np.ndarray
    filters: list[np.ndarray]  # by width: (width, SIZE, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    shift: float
    thresholds: dict[str, float] = field(default_factory=dict)
    overall: float = THRESHOLD

    def __getstate__(self):
        return {k: v for k, v in vars(self).items() if k not in ("words", "rows", "joint")}

    def word_rows(self, words: list[str]) -> np.ndarray:
        """What each word adds to each filter at each of its places. Words met
        before are remembered; the memory is emptied when it is full."""
        if not hasattr(self, "words") or len(self.words) + len(words) > CACHED_WORDS:
            self.words = _Numbers()
            self.rows = np.zeros((CACHED_WORDS, sum(WIDTHS) * FILTERS), np.float32)
            self.joint = np.concatenate([f.transpose(1, 0, 2).reshape(SIZE, -1) for f in self.filters], axis=1)
        at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        if fresh := self.words.fresh:
            n = len(self.words)
            self.rows[n - len(fresh) : n] = self._responses(fresh)
            self.words.fresh = []
        return self.rows[at]

    def _responses(self, words: list[str]) -> np.ndarray:
        at = np.array(list(map(buckets, words)), np.int64)
        return self.table[at].sum(axis=1) @ self.joint

    def pooled(self, text: str | None) -> np.ndarray:
        """The largest response of every filter, at least zero."""
        words = WORD.findall((text or "").lower())
        best = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        overlap = max(WIDTHS) - 1
        for first in range(0, len(words), 20_000):  # blocks that overlap by a filter
            rows = self.word_rows(words[first : first + 20_000 + overlap])
            at = 0
            for k, width in enumerate(WIDTHS):
                n = len(rows) - width + 1
                if n > 0:
                    own = slice(k * FILTERS, (k + 1) * FILTERS)
                    total = rows[:n, at : at + FILTERS]
                    for j in range(1, width):
                        total = total + rows[j : j + n, at + j * FILTERS : at + (j + 1) * FILTERS]
                    best[own] = np.maximum(best[own], total.max(axis=0) + self.bias[own])
                at += width * FILTERS
        return best

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return sigmoid(np.stack([self.pooled(t) for t in texts]).astype(float) @ self.out + self.shift)


def _start(share: float, seed: int) -> Network:
    rng = np.random.default_rng(seed)
    return Network(
        rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32),
        [rng.normal(0, 0.3, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(len(WIDTHS) * FILTERS, np.float32),
        rng.normal(0, 0.3, len(WIDTHS) * FILTERS),
        float(np.log(share / (1 - share))),
    )


class _Adam:
    def __init__(self, value: np.ndarray, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros_like(value), np.zeros_like(value), 0, rate

    def step(self, value: np.ndarray, gradient: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.001 * (gradient**2 - self.v)
        value -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


class _Trainer:
    """A network in training, with the moments of its parameters (Adam) and, for the
    table's rows, of which few are touched at a time, sums of squares (Adagrad)."""

    def __init__(self, net: Network, rate: float = 0.01):
        self.net, self.shift = net, np.array([net.shift])
        self.params = [*net.filters, net.bias, net.out, self.shift]
        self.adams = [_Adam(p, rate) for p in self.params]
        self.squares = np.full(BUCKETS, 1e-6, np.float32)

    def _dense(self) -> list[np.ndarray]:
        return [x for p, a in zip(self.params, self.adams, strict=True) for x in (p, a.m, a.v)]

    def vector(self) -> np.ndarray:
        """All parameters but the table, their moments and the number of steps."""
        return np.concatenate([[self.adams[0].t], *[x.ravel() for x in self._dense()]]).astype(float)

    def add(self, table: np.ndarray, squares: np.ndarray, vector: np.ndarray) -> None:
        self.net.table += table
        self.squares += squares
        at = 1
        for x in self._dense():
            x += vector[at : at + x.size].reshape(x.shape).astype(x.dtype)
            at += x.size
        for adam in self.adams:
            adam.t += float(vector[0])

    def network(self) -> Network:
        self.net.shift = float(self.shift[0])
        return self.net

    def learn(
        self,
        docs: list[np.ndarray],
        of_word: np.ndarray,
        y: np.ndarray,
        rng: np.random.Generator,
        batch: int = 32,
        positive: float = 2.0,
        drop: float = 0.1,
    ) -> None:
        """One pass over documents, given as numbers of words. Log loss, toxic examples
        weighted by ``positive``. A share of the words, drawn anew each time, is left
        out, as the loudest word would else be all that is learnt."""
        net = self.net
        order = rng.permutation(len(docs))
        for first in range(0, len(order), batch):
            gradients = [np.zeros_like(p) for p in self.params]
            *in_filters, in_bias, in_out, in_shift = gradients
            touched, pushes = [], []
            for d in order[first : first + batch]:
                doc = docs[d][rng.random(len(docs[d])) >= drop]
                pooled, where = self._pooled(doc, of_word)
                error = float(sigmoid(np.array(pooled @ net.out + self.shift[0]))) - y[d]
                error *= (positive if y[d] else 1.0) / min(batch, len(order))
                in_out += error * pooled
                in_shift += error
                back = np.where(pooled > 0, error * net.out, 0).astype(np.float32)
                in_bias += back
                for k, (width, f) in enumerate(zip(WIDTHS, net.filters, strict=True)):
                    own = slice(k * FILTERS, (k + 1) * FILTERS)
                    live = np.flatnonzero(back[own])
                    for j in range(width if len(live) else 0):
                        rows = of_word[doc[where[own][live] + j]]
                        in_filters[k][j][:, live] += net.table[rows].sum(axis=1).T * back[own][live]
                        touched.append(rows)
                        pushes.append((back[own][live][:, None] * f[j][:, live].T).repeat(HASHES, axis=0))
            for p, adam, gradient in zip(self.params, self.adams, gradients, strict=True):
                adam.step(p, gradient)
            if touched:
                rows, at = np.unique(np.concatenate([t.ravel() for t in touched]), return_inverse=True)
                total = np.zeros((len(rows), SIZE), np.float32)
                np.add.at(total, at, np.concatenate(pushes))
                self.squares[rows] += (total**2).mean(axis=1)
                net.table[rows] -= 0.05 * total / np.sqrt(self.squares[rows])[:, None]

    def _pooled(self, doc: np.ndarray, of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest response of every filter, at least zero, and its place; texts
        are gone through in blocks that overlap by a filter."""
        net, n_out = self.net, len(self.net.out)
        best, where = np.zeros(n_out), np.zeros(n_out, np.int64)
        overlap = max(WIDTHS) - 1
        for first in range(0, len(doc), 20_000):
            vectors = net.table[of_word[doc[first : first + 20_000 + overlap]]].sum(axis=1)
            for k, (width, f) in enumerate(zip(WIDTHS, net.filters, strict=True)):
                n = len(vectors) - width + 1
                if n > 0:
                    own = slice(k * FILTERS, (k + 1) * FILTERS)
                    r = sum(vectors[j : j + n] @ f[j] for j in range(width)) + net.bias[own]
                    top = r.max(axis=0)
                    where[own] = np.where(top > best[own], first + r.argmax(axis=0), where[own])
                    best[own] = np.maximum(top, best[own])
        return best, where


class _Words:
    """Texts as numbers of words, and the rows of each word in the table."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.docs: list[np.ndarray] = []

    def add(self, text: str) -> None:
        ids = self.ids
        self.docs.append(np.array([ids.setdefault(w, len(ids)) for w in WORD.findall(text.lower())], np.int32))

    def of_word(self) -> np.ndarray:
        return np.array([buckets(w) for w in self.ids] or [[0] * HASHES], np.uint16)


def train(texts: list[str], y: np.ndarray, epochs: int = 8, rate: float = 0.01, seed: int = 1, **settings) -> Network:
    """A network that has learnt from texts in memory, as one block."""
    net = _start((float(y.sum()) + 1.0) / (len(y) + 2.0), seed)
    if not len(y) or y.min() == y.max():
        net.out[:] = 0
        return net
    words = _Words()
    for text in texts:
        words.add(text)
    trainer, of_word = _Trainer(net, rate), words.of_word().astype(np.int64)
    for turn in range(epochs):
        trainer.learn(words.docs, of_word, y, np.random.default_rng((seed, turn)), **settings)
    return trainer.network()


def _thresholds(net: Network, counts: dict[str, np.ndarray]) -> None:
    """The threshold of a language separates its own documents best (F1); those with
    fewer than five toxic examples use the threshold of all. ``counts`` has, for each
    language, how many documents of either label have a score of each level."""

    def best(count: np.ndarray) -> float:
        above = count[:, ::-1].cumsum(axis=1)[:, ::-1]  # flagged at each level
        f1 = 2 * above[1] / np.maximum(1, above.sum(axis=0) + above[1, 0])
        cuts = np.flatnonzero(f1 >= f1.max() - 1e-12) / LEVELS
        return float(cuts[np.abs(cuts - THRESHOLD).argmin()])

    if counts:
        net.overall = best(sum(counts.values()))
    for lang in sorted(counts):
        if counts[lang][1].sum() >= 5:
            net.thresholds[lang] = best(counts[lang])


def _level(score: np.ndarray) -> np.ndarray:
    return np.minimum((score * LEVELS).astype(np.int64), LEVELS - 1)


def calibrate(net: Network, texts: list[str], y: np.ndarray, langs: list[str | None]) -> None:
    """Thresholds from texts in memory."""
    counts: dict[str, np.ndarray] = {}
    for lang, level, label in zip(langs, _level(net.score(texts)), y, strict=True):
        counts.setdefault(lang or "", np.zeros((2, LEVELS), np.int64))[int(label), level] += 1
    _thresholds(net, counts)


def _encoded(batches: Batches) -> Batches:
    """Blocks out of rows sorted by (block, doc_id, text, lang): words as numbers. Of
    rows that repeat an id the first counts."""
    block, seq, chars, last, y, words = None, 0, 0, None, [], _Words()

    def flush():
        made = {
            "block": block,
            "seq": seq,
            "n": len(y),
            "toxic": sum(y),
            "y": np.array(y, np.uint8).tobytes(),
            "sizes": np.array([len(d) for d in words.docs], np.int32).tobytes(),
            "words": np.concatenate(words.docs).tobytes(),
            "of_word": words.of_word().tobytes(),
        }
        return pa.RecordBatch.from_pylist([made], BLOCK_ARROW)

    for batch in pieces(batches):
        for at, doc, text, label in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if y and (at != block or chars >= BLOCK_CHARS):
                yield flush()
                seq, chars, y, words = seq + 1 if at == block else 0, 0, [], _Words()
            if (at, doc) == (block, last):
                continue
            block, last, chars = at, doc, chars + len(text)
            words.add(text)
            y.append(label)
    if y:
        yield flush()


BLOCK_SPEC = "block int, seq int, n bigint, toxic bigint, y binary, sizes binary, words binary, of_word binary"
BLOCK_ARROW = pa.schema(
    [
        *[(k, pa.int32()) for k in ("block", "seq")],
        *[(k, pa.int64()) for k in ("n", "toxic")],
        *[(k, pa.binary()) for k in ("y", "sizes", "words", "of_word")],
    ]
)
CHANGE_SPEC = "piece int, block int, seq int, n bigint, change binary"
CHANGE_ARROW = pa.schema(
    [("piece", pa.int32()), ("block", pa.int32()), ("seq", pa.int32()), ("n", pa.int64()), ("change", pa.binary())]
)


def _pass(blocks: DataFrame, trainer: _Trainer, seed: int, turn: int, **settings) -> None:
    """Every block learns by itself; what they have changed is averaged by pieces of
    the parameters, in the order of the blocks, and added."""
    sc = blocks.sparkSession.sparkContext
    shared = sc.broadcast(trainer)  # a fixed number of parameters

    def run(batches: Batches) -> Batches:
        for batch in pieces(batches, 1):
            row = batch.to_pylist()[0]
            y = np.frombuffer(row["y"], np.uint8).astype(float)
            ends = np.cumsum(np.frombuffer(row["sizes"], np.int32))
            docs = np.split(np.frombuffer(row["words"], np.int32), ends[:-1])
            of_word = np.frombuffer(row["of_word"], np.uint16).reshape(-1, HASHES).astype(np.int64)
            before, own = shared.value, copy.deepcopy(shared.value)
            own.learn(docs, of_word, y, np.random.default_rng((seed, turn, row["block"], row["seq"])), **settings)
            rows = np.concatenate([own.net.table - before.net.table, (own.squares - before.squares)[:, None]], axis=1)
            changes = [rows[k : k + PIECE].tobytes() for k in range(0, BUCKETS, PIECE)]
            changes.append((own.vector() - before.vector()).tobytes())
            at = {"block": row["block"], "seq": row["seq"], "n": len(y)}
            yield pa.RecordBatch.from_pylist([{"piece": k, "change": c, **at} for k, c in enumerate(changes)], CHANGE_ARROW)

    def averaged(batches: Batches) -> Batches:
        piece, total, weight, n = None, 0.0, 0.0, 0

        def flush():
            made = {"piece": piece, "block": 0, "seq": 0, "n": n, "change": (total / np.maximum(weight, 1)).tobytes()}
            return pa.RecordBatch.from_pylist([made], CHANGE_ARROW)

        for batch in pieces(batches, 64):
            for row in batch.to_pylist():
                if piece is not None and row["piece"] != piece:
                    yield flush()
                    total, weight, n = 0.0, 0.0, 0
                piece = row["piece"]
                if piece == BUCKETS // PIECE:
                    change, share = np.frombuffer(row["change"]), float(row["n"])
                else:
                    change = np.frombuffer(row["change"], np.float32).reshape(PIECE, SIZE + 1).astype(float)
                    share = (change != 0).any(axis=1, keepdims=True).astype(float)  # blocks that have touched the row
                total, weight, n = total + share * change, weight + share, n + row["n"]
        if piece is not None:
            yield flush()

    changed = spread(blocks.mapInArrow(run, CHANGE_SPEC), "piece").sortWithinPartitions("piece", "block", "seq")
    found = {r.piece: np.frombuffer(bytes(r.change)) for r in changed.mapInArrow(averaged, CHANGE_SPEC).collect()}
    shared.unpersist()
    vector = found.pop(BUCKETS // PIECE)
    rows = np.concatenate([found[k] for k in sorted(found)]).reshape(BUCKETS, SIZE + 1).astype(np.float32)
    trainer.add(rows[:, :SIZE], rows[:, SIZE], vector)


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    max_chars: int | None = None,
    epochs: int | None = None,
    rate: float = 0.01,
    seed: int = 1,
    **settings,
) -> Network:
    """The network that has learnt from all labelled documents outside the held-out
    fold; only a caller that gives ``max_chars`` leaves longer texts out."""
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    one = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y"))
    aside = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(10)) == F.lit(0)
    one = materialize(one.filter(F.col("y").isin(0, 1)).withColumn("aside", aside))
    n_labels = one.count()
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(), F.col("lang").cast("string").alias("lang"))
    if max_chars is not None:
        source = source.filter(F.length("text") <= max_chars)
    found = attach(source, one, ["doc_id"], n_facts=n_labels)

    n_blocks = -(-n_labels // BLOCK_ROWS) or 1
    block = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(n_blocks)).cast("int")
    rows = found.filter(~F.col("aside")).select(block.alias("block"), "doc_id", "text", "y")
    dealt = rows.repartitionById(n_blocks, "block").sortWithinPartitions("block", "doc_id", "text")
    blocks = stored(dealt.mapInArrow(_encoded, BLOCK_SPEC), "toxicity")
    n, toxic = (x or 0 for x in blocks.agg(F.sum("n"), F.sum("toxic")).first())
    net = _start((toxic + 1.0) / (n + 2.0), seed)
    if 0 < toxic < n:
        trainer, (fewest, most) = _Trainer(net, rate), PASSES
        for turn in range(epochs or max(fewest, min(most, -(-SHOWN // n)))):
            _pass(blocks, trainer, seed, turn, **settings)
        net = trainer.network()
    else:
        net.out[:] = 0

    # of the documents set aside only counts of scores by language leave the tasks
    least = found.filter("aside").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "y")).alias("one"))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def levels(batch: pa.RecordBatch) -> dict:
        score = shared.value.score(batch.column("text").to_pylist())
        return {"lang": batch.column("lang"), "y": batch.column("y"), "level": _level(score)}

    texts = least.select("one.text", F.coalesce("one.lang", F.lit("")).alias("lang"), "one.y")
    counts: dict[str, np.ndarray] = {}
    for r in map_rows(texts, "lang string,y int,level int", levels).groupBy("lang", "y", "level").count().collect():
        counts.setdefault(r.lang, np.zeros((2, LEVELS), np.int64))[r.y, r.level] = r["count"]
    _thresholds(net, counts)
    return net


def score_toxicity(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, flagged) of every row: ``predicted`` by
    one threshold for all, ``flagged`` by the threshold of the row's language."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a fixed number of parameters

    def columns(batch: pa.RecordBatch) -> dict:
        ids, langs = batch.column("doc_id"), batch.column("lang").to_pylist()
        score = shared.value.score(batch.column("text").to_pylist())
        own = np.array([shared.value.thresholds.get(x or "", shared.value.overall) for x in langs])
        return {
            "doc_id": ids,
            "held_out": [is_held_out(i) for i in ids.to_pylist()],
            "score": score,
            "predicted": (score >= threshold).astype(np.int32),
            "flagged": (score >= own).astype(np.int32),
        }

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(), F.col("lang").cast("string").alias("lang"))
    return map_rows(rows, "doc_id long,held_out boolean,score double,predicted int,flagged int", columns)
