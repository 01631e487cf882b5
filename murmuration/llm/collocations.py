"""Phrases whose words belong together, by language.

Two passes over the texts. The first hashes every n-gram of up to ``max_words``
words, language included. The leading bits of the hash name a hash partition,
the next 32 bits the n-gram there; a Misra-Gries summary of each partition, with
more counters than its mass divided by the least count, keeps every n-gram that
is frequent enough (and a few others: its counters are ``SLACK`` times as many as
needed). There are as many partitions as the bytes of the corpus ask for, so a
summary is of the same size for any corpus. The second pass counts the
surviving n-grams exactly, by their words: a bitmap of the survivors tells them
where the texts are read. It is sized by their number and has ``FILTER_BITS`` bits
at most; where that gets tight, more n-grams are counted, and the result is the
same. Counts meet by (language, phrase), combined before they are shuffled.

Letters A-Z count as a-z; ``.,;:!?`` and line breaks end a piece, blanks and tabs
a word, and no phrase goes beyond its piece. A null text is empty, a null
language ``und``. Rows that repeat an id, or have none, count like others; ids
and other columns are ignored. Texts of any length are taken whole, in parts that
end with a piece. Equal scores go by count, then by the bytes of the phrase. An
empty table, or one without frequent phrases, gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from murmuration.llm.common import Batches, pieces, stored, text_of
from murmuration.llm.misra_gries import Summary
from murmuration.operators.attach import attach

MAX_WORDS = 3
MIN_COUNT = 10
LIMIT = 2000
#: A phrase goes if a longer candidate has at least this share of its count, in percent.
SHARE = 50
#: Counters of a summary, as a multiple of mass / least count.
SLACK = 4
#: Bytes of text to a hash partition of the n-grams, about.
PART_BYTES = 4 << 20
#: Bytes of text worked on together, about.
CHUNK_BYTES = 4 << 20
FILTER_BITS = 1 << 28
#: Bits of the bitmap for each survivor, while there is room.
BITS_EACH = 64
#: Phrases of one language are first ranked in so many parts.
PARTS_RANKED = 16

BREAK = b"."  # ends a piece, so no word is like it
_PLAIN = bytes(
    10 if b in b".,;:!?" or 10 <= b <= 13 else 32 if b in b" \t" else b + 32 if 65 <= b <= 90 else b
    for b in range(256)
)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
SURVIVORS = "part int, n bigint, fingerprints binary"


def parts_of(texts: list[str], size: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """The words of the texts, ``BREAK`` between pieces, some megabytes at a time."""
    data = b"\n".join(t.encode().translate(_PLAIN) for t in texts)
    at = 0
    while at < len(data):
        end = data.find(b"\n", at + size)
        end = len(data) if end < 0 else end + 1
        yield data[at:end].replace(b"\n", b" . ").split()
        at = end


class Grams:
    """The distinct n-grams of a list of words, with counts and hashes.

    Two are the same only if their words are: an n-gram is known by the number
    of the shorter one before its last word, and that word."""

    def __init__(self, words: list[bytes], lang: str, max_words: int):
        self.words = words
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        ids = np.fromiter(map(number.__getitem__, [BREAK, *words]), np.int64, len(words) + 1)[1:]
        seed = xxhash.xxh64_intdigest(lang.encode())
        word_hash = np.array([xxhash.xxh64_intdigest(w, seed) for w in number], np.uint64)
        #: by length from 1: where each distinct n-gram first begins, its count and hash
        self.by_size: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at = np.flatnonzero(ids > 0)
        code, hashes = ids[at], None
        for size in range(1, max_words + 1):
            known = pa.array(code).dictionary_encode()
            which = known.indices.to_numpy()
            distinct = known.dictionary.to_numpy()
            first = np.empty(len(distinct), np.int64)
            first[which[::-1]] = at[::-1]
            last = word_hash[ids[first + size - 1]]
            hashes = last if size == 1 else _mixed(hashes[distinct >> 32], last)
            self.by_size.append((first, np.bincount(which, minlength=len(distinct)), hashes))
            goes_on = at + size < len(ids)
            goes_on[goes_on] = ids[at[goes_on] + size] > 0
            at = at[goes_on]
            code = which[goes_on].astype(np.int64) << 32 | ids[at + size]

    def phrase(self, at: int, size: int) -> bytes:
        return b" ".join(self.words[at : at + size])


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _MIX[0] + b
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def _all_grams(batches: Batches, max_words: int, chunk: int) -> Iterator[tuple[str, Grams]]:
    """The n-grams of every language, of a bounded amount of text at a time."""
    texts: defaultdict[str, list[str]] = defaultdict(list)

    def made():
        for lang, own in texts.items():
            for words in parts_of(own, chunk):
                yield lang, Grams(words, lang, max_words)
        texts.clear()

    size = 0
    for batch in pieces(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            texts[lang].append(text)
            size += len(text)
            if size >= chunk:
                yield from made()
                size = 0
    yield from made()


def _hashed(part_bits: int, max_words: int, chunk: int):
    """Rows (part, mass, once, more, counts): the n-grams of a chunk by partition."""

    def run(batches: Batches) -> Batches:
        for _, grams in _all_grams(batches, max_words, chunk):
            hashes = np.concatenate([h for _, _, h in grams.by_size])
            order = np.argsort(hashes)
            hashes, counts = hashes[order], np.concatenate([c for _, c, _ in grams.by_size])[order]
            part = (hashes >> np.uint64(64 - part_bits)).astype(np.int32)
            mark = (hashes >> np.uint64(32 - part_bits)).astype(np.uint32)
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else part
            rows = []
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(part)], strict=False):
                one = counts[a:b] == 1
                rows.append(
                    (
                        int(part[a]),
                        int(counts[a:b].sum()),
                        mark[a:b][one].tobytes(),
                        mark[a:b][~one].tobytes(),
                        counts[a:b][~one].astype(np.uint32).tobytes(),
                    )
                )
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 3)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                ["part", "mass", "once", "more", "counts"],
            )

    return run


def _survivors(min_count: int, slack: int):
    def run(rows: pa.Table) -> pa.Table:
        mass = sum(rows.column("mass").to_pylist())
        summary = Summary(slack * mass // min_count + 1)
        for column in zip(*(rows.column(c).to_pylist() for c in ("once", "more", "counts")), strict=True):
            once, more, counts = (np.frombuffer(x, np.uint32) for x in column)
            summary.add(once, np.ones(len(once), np.int64))
            summary.add(more, counts)
        kept = summary.at_least(min_count)
        return pa.table(
            {
                "part": pa.array([rows.column("part")[0].as_py()], pa.int32()),
                "n": pa.array([len(kept)], pa.int64()),
                "fingerprints": pa.array([kept.tobytes()], pa.binary()),
            }
        )

    return run


def survivors(docs: DataFrame, part_bits: int, max_words: int, min_count: int, chunk: int = CHUNK_BYTES, slack: int = SLACK) -> DataFrame:
    """(part, n, fingerprints) of each hash partition: all n-grams that occur
    ``min_count`` times, and some others. ``docs`` has (lang, text)."""
    hashed = docs.mapInArrow(
        _hashed(part_bits, max_words, chunk), "part int, mass bigint, once binary, more binary, counts binary"
    )
    return hashed.groupBy("part").applyInArrow(_survivors(min_count, slack), SURVIVORS)


def bitmap(found: DataFrame, part_bits: int, filter_bits: int = FILTER_BITS) -> bytes:
    """One bit for each of the first hash values that a survivor can have."""
    n = found.agg(F.sum("n")).first()[0] or 0
    wanted = min(filter_bits, 1 << max(16, (BITS_EACH * n - 1).bit_length()))
    bits = max(wanted.bit_length() - 1, part_bits + 3)
    own = bits - part_bits  # at most 32

    def run(batches: Batches) -> Batches:
        for batch in batches:
            segments = []
            for raw in batch.column("fingerprints").to_pylist():
                flags = np.zeros(1 << own, bool)
                flags[np.frombuffer(raw, np.uint32) >> np.uint32(32 - own)] = True
                segments.append(np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(segments, pa.binary())], ["part", "bits"])

    out, size = bytearray(1 << bits - 3), 1 << own - 3
    for row in found.mapInArrow(run, "part int, bits binary").toLocalIterator():
        out[row.part * size : (row.part + 1) * size] = row.bits
    return bytes(out)


def _counted(shared, max_words: int, chunk: int):
    """Rows (lang, words, phrase, f) of the n-grams in the bitmap; a row of no
    words has the number of all words."""

    def run(batches: Batches) -> Batches:
        flags = np.frombuffer(shared.value, np.uint8)
        shift = np.uint64(64 - (8 * len(flags)).bit_length() + 1)
        for lang, grams in _all_grams(batches, max_words, chunk):
            for size, (first, counts, hashes) in enumerate(grams.by_size, 1):
                at = hashes >> shift
                known = (flags[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 > 0
                starts = first[known].tolist()
                words = grams.words
                phrases = [words[i] for i in starts] if size == 1 else [b" ".join(words[i : i + size]) for i in starts]
                yield _rows(lang, size, phrases, counts[known])
            yield _rows(lang, 0, [b""], grams.by_size[0][1].sum(keepdims=True))

    return run


def _rows(lang: str, size: int, phrases: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
    n = len(phrases)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([lang] * n, pa.string()),
            pa.array(np.full(n, size, np.int32)),
            pa.array(phrases, pa.binary()).cast(pa.string()),
            pa.array(counts.astype(np.int64)),
        ],
        ["lang", "words", "phrase", "f"],
    )


def frequent(
    docs: DataFrame,
    max_words: int = MAX_WORDS,
    min_count: int = MIN_COUNT,
    part_bytes: int = PART_BYTES,
    chunk: int = CHUNK_BYTES,
    filter_bits: int = FILTER_BITS,
    slack: int = SLACK,
) -> DataFrame:
    """(lang, words, phrase, f): the exact count of every n-gram with at least
    ``min_count``; with words = 0 and an empty phrase, of all words of the language."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of())
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    part_bits = min(28, max(3, (size // part_bytes).bit_length()))
    found = stored(survivors(rows, part_bits, max_words, min_count, chunk, slack), "survivors")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(found, part_bits, filter_bits))
    counted = rows.mapInArrow(_counted(shared, max_words, chunk), "lang string, words int, phrase string, f bigint")
    total = counted.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    return total.filter((F.col("words") == 0) | (F.col("f") >= min_count))


def _scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """Candidates with l, r and score of their weakest cut."""
    words = F.split("phrase", " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang",
        "phrase",
        "words",
        "a",
        "k",
        F.array_join(F.slice(words, 1, F.col("k")), " ").alias("left"),
        F.array_join(F.slice(words, F.col("k") + 1, F.col("words")), " ").alias("right"),
    )
    for side, name in (("left", "l"), ("right", "r")):
        cuts = attach(cuts, counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    wide = {c: F.col(c).cast("decimal(18,0)") for c in "alr"}
    ratio = F.lit(1_000_000).cast("decimal(7,0)") * wide["a"] * wide["a"], wide["l"] * wide["r"]
    cuts = cuts.withColumn("up", ratio[0]).withColumn("down", ratio[1]).withColumn("score", F.expr("up div down"))
    weakest = F.min(F.struct("score", "k", "l", "r")).alias("weakest")
    return cuts.groupBy("lang", "phrase", "a").agg(weakest).select("lang", "phrase", "a", "weakest.*").drop("k")


def _covered(candidates: DataFrame) -> DataFrame:
    """(lang, phrase, longer): for every phrase inside a candidate, the largest
    count of a longer one."""
    words = F.split("phrase", " ")
    n = F.col("words")
    inside = F.flatten(
        F.transform(
            F.sequence(F.lit(2), n - 1),
            lambda size: F.transform(
                F.sequence(F.lit(1), n - size + 1), lambda i: F.array_join(F.slice(words, i, size), " ")
            ),
        )
    )
    rows = candidates.filter("words > 2").select("lang", F.explode(F.array_distinct(inside)).alias("phrase"), "a")
    return rows.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))


def collocations(
    docs: DataFrame,
    max_words: int = MAX_WORDS,
    min_count: int = MIN_COUNT,
    limit: int = LIMIT,
    share: int = SHARE,
    **settings,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``limit`` phrases of each
    language by score, count and phrase. ``a`` is the phrase's count, ``l`` and ``r``
    those of the two parts of its weakest cut, ``n`` that of all words; the score is
    a million times a * a / (l * r), rounded down."""
    counts = stored(frequent(docs, max_words, min_count, **settings), "counts")
    candidates = counts.filter("words > 1").withColumnRenamed("f", "a")
    within = _covered(candidates)
    scored = _scored(candidates, counts.filter("words > 0")).join(within, ["lang", "phrase"], "left")
    kept = scored.filter(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    order = F.desc("score"), F.desc("a"), F.asc("phrase")
    kept = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS_RANKED)))
    for keys in (["lang", "part"], ["lang"]):  # a language's phrases meet in two steps
        rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
        kept = kept.withColumn("rank", rank).filter(F.col("rank") <= limit)
    ranked = kept.withColumn("rank", F.col("rank").cast("long"))
    totals = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    return attach(ranked, totals, ["lang"]).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
