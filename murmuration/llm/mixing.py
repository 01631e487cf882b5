"""Sampling documents so that sources, languages and topics have target shares.

Documents are summed up by cell (source, language, topic). Iterative
proportional fitting rakes the token weights of the cells to one marginal after
the other until all have their target shares. Only one row per source takes
part, which holds its cells; languages and topics, of which there are few, have
a factor each that the driver knows, sources have theirs where they lie. A document is then kept with its cell's
probability: proportional to raked weight over tokens, at most one, scaled so
that the expected number of tokens is the budget.

Topics are the clusters of hashed word counts nearest to a text. K-means starts
from a bounded sample (``FIT_ROWS`` rows, those with the smallest hash of id and
text) and goes over all texts, ``ROUNDS`` times at most. A document counts its words,
at least one; very long texts count whole. Null and empty
texts have topic -1. A null source or language counts as ''. Targets name shares
by category; categories without one share what is left in proportion to their
tempered shares (share ** temperature), and so does a marginal without targets;
named categories that do not occur are ignored. Cells that do not occur cannot be
made up for. Raking goes on until all shares are met, or until it comes no nearer;
how far the farthest share is off then is a column of the result. The draw depends
on seed, id and text alone: repeated rows share their fate, rows without an id are
drawn by their text. An empty table gives no rows. The names ``_topic``, ``_tokens``,
``_probability``, ``_deviation`` and ``_sampled`` are refused in the input.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from murmuration.llm.common import Batches, pieces, stored, text_of
from murmuration.llm.multi_index import codes_of, k_means

MARGINALS = ("source", "lang", "topic")
TOPICS = 8
BUCKETS = 64
FIT_ROWS = 4_000
TEMPERATURE = 0.7
BUDGET = 0.5
TOLERANCE = 1e-3
#: Raking ends when so many sweeps have not brought it nearer by a tenth.
STALL = 20
#: Rounds of k-means over all texts, and steps of a profile's numbers.
ROUNDS = 6
STEPS = 65535
SEED = 7
BROADCAST_CELLS = 50_000

Targets = dict[str, dict[str, float]]


def profile(text: str | None) -> tuple[int, np.ndarray]:
    """The number of words, and the log counts of hashed words as a unit vector."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0, np.zeros(BUCKETS)
    hashed = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % BUCKETS
    x = np.log1p(np.bincount(hashed, minlength=BUCKETS))
    return len(words), x / np.sqrt((x * x).sum())


def _profiles(docs: DataFrame) -> DataFrame:
    """(h, x): of every text with words a hash, and its profile in 16-bit steps."""
    rows = docs.select(F.xxhash64("doc_id", text_of()).alias("h"), text_of()).filter("text <> ''")

    def run(batches: Batches) -> Batches:
        for batch in pieces(batches):
            found = [profile(t) for t in batch.column("text").to_pylist()]
            keep = pa.array([n > 0 for n, _ in found])
            x = [np.round(v * STEPS).astype("<u2").tobytes() for _, v in found]
            columns = [batch.column("h"), pa.array(x, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["h", "x"]).filter(keep)

    return rows.mapInArrow(run, "h long, x binary")


def _unpacked(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<u2").reshape(-1, BUCKETS)


def _moved(profiles: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The mean of all profiles nearest to each centre. Sums are of integers, so
    they do not depend on partitioning; a few hundred of them reach the driver."""

    def run(batches: Batches) -> Batches:
        sums, counts = np.zeros(centres.shape, np.int64), np.zeros(len(centres), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _unpacked(batch.column("x").to_pylist())
                at = codes_of(x / STEPS, centres)
                np.add.at(sums, at, x)
                counts += np.bincount(at, minlength=len(centres))
        every = np.concatenate([sums, counts[:, None]], axis=1)
        columns = [np.repeat(np.arange(len(every)), every.shape[1]), np.tile(np.arange(every.shape[1]), len(every)), every.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["centre", "place", "n"])

    rows = profiles.mapInArrow(run, "centre long, place long, n long").groupBy("centre", "place").agg(F.sum("n"))
    total = np.zeros((len(centres), BUCKETS + 1), np.int64)
    for centre, place, n in rows.collect():
        total[centre, place] = n
    counts = total[:, -1:]
    return np.where(counts > 0, total[:, :-1] / np.maximum(counts, 1) / STEPS, centres)


def fit_topics(docs: DataFrame, topics: int = TOPICS, fit_rows: int = FIT_ROWS, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of the profiles of all texts: k-means that starts from a sample."""
    profiles = stored(_profiles(docs).select("h", "x"), "profiles")
    first = profiles.orderBy("h", "x").limit(fit_rows).select("x").distinct().collect()
    if not first:
        return np.zeros((1, BUCKETS))
    x = _unpacked(sorted(r.x for r in first)) / STEPS
    centres = k_means(x, topics)
    for _ in range(rounds):
        before, centres = centres, _moved(profiles, centres)
        if (before == centres).all():
            break
    return centres


def described(docs: DataFrame, centres: np.ndarray) -> DataFrame:
    """The rows with two more columns, ``_topic`` and ``_tokens``."""
    at = docs.columns.index("text")

    def run(batches: Batches) -> Batches:
        for batch in pieces(batches):
            n, x = zip(*[profile(t) for t in batch.column(at).to_pylist()], strict=True)
            n = np.array(n)
            topic = np.where(n > 0, codes_of(np.array(x), centres), -1)
            more = [pa.array(topic, pa.int32()), pa.array(np.maximum(n, 1), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "_topic", "_tokens"])

    more = [T.StructField("_topic", T.IntegerType()), T.StructField("_tokens", T.LongType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))


def _category(name: str) -> Column:
    if name == "topic":
        return F.col("_topic").cast("string").alias("topic")
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def cells_of(rows: DataFrame) -> DataFrame:
    """(source, lang, topic, tokens): one row per cell that occurs."""
    keyed = rows.select(*map(_category, MARGINALS), "_tokens")
    return keyed.groupBy(*MARGINALS).agg(F.sum("_tokens").cast("double").alias("tokens"))


def target_shares(cells: DataFrame, name: str, given: dict[str, float], temperature: float) -> DataFrame:
    """(name, share): shares of all categories that occur; they add up to one."""
    sums = cells.groupBy(name).agg(F.sum("tokens").alias("tokens"))
    if given:
        known = cells.sparkSession.createDataFrame([(g, float(x)) for g, x in given.items()], f"{name} string, given double")
        sums = sums.join(known, name, "left")
    else:
        sums = sums.withColumn("given", F.lit(None).cast("double"))
    free = F.when(F.col("given").isNull(), F.pow("tokens", F.lit(temperature)))
    sums = sums.withColumn("free", free)
    named, rest = sums.agg(F.sum("given"), F.sum("free")).first()
    named, rest = named or 0.0, rest or 0.0
    left = max(0.0, 1.0 - named) if rest else 0.0
    total = named + left
    share = F.coalesce(F.col("given"), F.col("free") * (left / rest if rest else 0.0)) / total
    return sums.select(name, share.alias("share"))


def _by_source(cells: DataFrame, shares: DataFrame, langs: list[str], topics: list[str]) -> DataFrame:
    """One row per source: its target share, and its cells as numbers."""
    spark = cells.sparkSession
    numbers = [spark.createDataFrame(list(enumerate(v)), f"_{n} int, {n} string") for n, v in (("lang", langs), ("topic", topics))]
    numbered = cells.join(F.broadcast(numbers[0]), "lang").join(F.broadcast(numbers[1]), "topic")  # a row per category
    lists = [F.collect_list(c).alias(c) for c in ("_lang", "_topic", "tokens")]
    return numbered.groupBy("source").agg(*lists).join(shares, "source")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """The source's number in the batch, language, topic and tokens of each cell."""
    lists = [batch.column(c) for c in ("_lang", "_topic", "tokens")]
    sizes = np.diff(lists[0].offsets.to_numpy())
    return np.repeat(np.arange(len(sizes)), sizes), *(x.flatten().to_numpy(zero_copy_only=False) for x in lists)


def _source_factors(batch: pa.RecordBatch, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """What brings each source to its share, given the factors of languages and
    topics; and the shares."""
    cells = row, lang, topic, tokens = _flat(batch)
    share = batch.column("share").to_numpy()
    now = np.bincount(row, tokens * b[lang] * c[topic], batch.num_rows)
    return np.divide(share, now, out=np.zeros(len(now)), where=now > 0), share, cells


def _sums(sources: DataFrame, old: tuple[np.ndarray, np.ndarray], new: tuple[np.ndarray, np.ndarray]):
    """Sums by language and by topic under the factors ``new``, sources raked
    under ``old``, and how far sources are off then: a row per batch, of a number
    per category, reaches the driver."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            a, share, (row, lang, topic, tokens) = _source_factors(batch, *old)
            weight = a[row] * tokens * new[0][lang] * new[1][topic]
            own = np.bincount(row, weight, batch.num_rows)
            off = (np.abs(own - share) / np.maximum(share, 1e-12)).max(initial=0.0)
            sums = [np.bincount(k, weight, len(v)) for k, v in ((lang, new[0]), (topic, new[1]))]
            kinds = pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip((*sums, off), kinds, strict=True)], ["lang", "topic", "off"]
            )

    rows = sources.mapInArrow(run, "lang array<double>, topic array<double>, off double").collect()
    return np.sum([r.lang for r in rows], axis=0), np.sum([r.topic for r in rows], axis=0), max(r.off for r in rows)


def rake(
    cells: DataFrame,
    targets: dict[str, DataFrame],
    tolerance: float = TOLERANCE,
    stall: int = STALL,
) -> tuple[DataFrame, float]:
    """(source, lang, topic, tokens, weight): weights add up to one, and their
    sums by each marginal differ from its shares by the tolerance, relatively, or
    as little as raking reaches; and by how much the farthest share is off.

    A weight is the cell's tokens times a factor for its source, its language and
    its topic. Sources are raked where they lie, one row each; the driver holds a
    number per language and topic."""
    shares = {n: {r[n]: r.share for r in targets[n].collect()} for n in ("lang", "topic")}
    langs, topics = sorted(shares["lang"]), sorted(shares["topic"])
    wanted = np.array([shares["lang"][x] for x in langs]), np.array([shares["topic"][x] for x in topics])
    sources = stored(_by_source(cells, targets["source"], langs, topics), "sources")
    b, c = np.ones(len(langs)), np.ones(len(topics))
    old = b, c

    def raked(factor: np.ndarray, want: np.ndarray, have: np.ndarray) -> np.ndarray:
        return factor * np.divide(want, have, out=np.zeros(len(have)), where=have > 0)

    nearest, waited, far = np.inf, 0, 0.0
    while waited < stall:
        old = b, c
        b = raked(b, wanted[0], _sums(sources, old, (b, c))[0])
        c = raked(c, wanted[1], _sums(sources, old, (b, c))[1])
        lang, topic, off = _sums(sources, old, (b, c))
        every = [np.abs(h - w) / np.maximum(w, 1e-12) for h, w in ((lang, wanted[0]), (topic, wanted[1]))]
        far = float(max(off, *(x.max() for x in every)))
        if far <= tolerance:
            break
        nearest, waited = (far, 0) if far < 0.9 * nearest else (nearest, waited + 1)
    new = b, c

    def run(batches: Batches) -> Batches:
        for batch in batches:
            a, _, (row, lang, topic, tokens) = _source_factors(batch, *old)
            weight = a[row] * tokens * new[0][lang] * new[1][topic]
            names = [np.array(v, object)[k].tolist() for v, k in ((langs, lang), (topics, topic))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("source").take(pa.array(row)), *map(pa.array, (*names, tokens, weight))],
                [*MARGINALS, "tokens", "weight"],
            )

    spec = "source string, lang string, topic string, tokens double, weight double"
    return stored(sources.mapInArrow(run, spec), "weights"), far


def probabilities(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """(source, lang, topic, probability): ``min(1, c * weight / tokens)``, with the
    c for which the expected tokens are ``budget`` of all. Cells reach one in turn,
    until no more do; then c is exact."""
    rate = F.col("weight") / F.col("tokens")
    c, wanted, full = 0.0, None, -1
    while True:
        capped = rate * F.lit(c) >= 1.0
        row = cells.agg(
            F.sum("tokens").alias("all"),
            F.sum(F.when(capped, F.col("tokens")).otherwise(0.0)).alias("full"),
            F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.sum(capped.cast("long")).alias("n"),
        ).first()
        wanted = min(max(budget, 0.0), 1.0) * row["all"]
        if row["n"] == full or not row["open"]:
            break
        full = row["n"]
        c = max(c, (wanted - row["full"]) / row["open"])
    p = F.round(F.least(F.lit(1.0), rate * F.lit(c)), 12)
    return cells.select(*MARGINALS, p.alias("probability"))


def mix(
    docs: DataFrame,
    targets: Targets | None = None,
    budget: float = BUDGET,
    temperature: float = TEMPERATURE,
    topics: int = TOPICS,
    seed: int = SEED,
) -> DataFrame:
    """The rows of ``docs`` with ``_topic``, ``_tokens``, ``_probability``,
    ``_deviation`` (one number for all: how far the farthest share is off) and
    ``_sampled``."""
    if taken := sorted({"_topic", "_tokens", "_probability", "_deviation", "_sampled"} & set(docs.columns)):
        raise ValueError(f"the input already has the columns {taken}")
    rows = described(docs, fit_topics(docs, topics))
    cells = stored(cells_of(rows), "cells")
    n = cells.count()
    if n == 0:
        return rows.withColumns({"_probability": F.lit(0.0), "_deviation": F.lit(0.0), "_sampled": F.lit(False)})
    given = targets or {}
    shares = {
        name: stored(target_shares(cells, name, given.get(name, {}), temperature), "shares") for name in MARGINALS
    }
    raked, far = rake(cells, shares)
    chances = stored(probabilities(raked, budget), "probabilities")
    chances = chances.select(*(F.col(m).alias(f"_{m}_cell") for m in MARGINALS), F.col("probability").alias("_probability"))
    if n <= BROADCAST_CELLS:
        chances = F.broadcast(chances)  # counted: a few short columns a cell
    on = [_category(m) == F.col(f"_{m}_cell") for m in MARGINALS]
    # the upper 53 bits of the hash as a number in [0, 1)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), text_of()), 11) / F.lit(float(1 << 53))
    return (
        rows.join(chances, on[0] & on[1] & on[2])
        .withColumn("_deviation", F.lit(far))
        .withColumn("_sampled", draw < F.col("_probability"))
        .drop(*(f"_{m}_cell" for m in MARGINALS))
    )


def sampled(docs: DataFrame, **settings) -> DataFrame:
    """The sampled rows, columns as they were."""
    return mix(docs, **settings).filter("_sampled").select(*docs.columns)
