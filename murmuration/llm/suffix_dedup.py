"""Passages of ``WINDOW`` bytes that occur more than once, removed wherever they stand.

Every window holds an anchor: the substring of ``GRAM`` bytes with the smallest
hash, the first such. Equal windows have equal anchors at equal places, so only
anchors have to meet, about one for every 70 bytes. The context of an anchor is the bytes
of all windows it stands for.

1. A pass over the texts counts anchors by hash. Those met once are done with.
   If all contexts of an anchor are the same, all of its windows are repeated.
2. Bitmaps of fixed size say, perhaps wrongly, which anchors are of the one kind
   or the other; a second pass emits only these, contexts for the mixed ones.
   Joins with the exact table put wrong guesses right.
3. Equal mixed contexts become one, with their number; these meet by anchor. What follows the anchor and, read backwards,
   what precedes it are sorted by hash-compared merge sort; neighbours' common
   lengths give classes, and two windows are equal if they are in one class on
   both sides. An anchor of very many different contexts is not brought
   together: its windows are counted by hash instead, combined before they are
   shuffled.

Documents never mix: windows end with their document. A null text is empty. Rows that
repeat an id, or have none, are documents of their own, so a repeated row of at
least ``WINDOW`` bytes loses all. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from murmuration.llm.common import Batches, pieces, spread, stored, text_of
from murmuration.llm.suffix_sort import PrefixHashes, Strings, mix, sorted_common

WINDOW = 200
GRAM = 64
#: Bytes of text looked at together; one longer text is looked at by itself.
BLOCK = 1 << 19
PLACE_BITS = 31
MAP_BITS = 27
SLICE_BITS = 21
#: Different contexts of one anchor that are brought together in a task.
HOT = 5000
BROADCAST_KEYS = 100_000
CELLS = 1 << 20
REMEMBERED = 100_000
U = np.uint64


class Anchors:
    """Of the texts joined: place of each anchor, first and last window it stands
    for, its text's number, and two hashes: of the anchor and of its context."""

    def __init__(self, texts: list[bytes], window: int, gram: int):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        n, span = len(self.data), window - gram + 1
        self.starts = ends - np.fromiter(map(len, texts), np.int64, len(texts))
        if n < window:
            self.at = self.low = self.high = self.text = np.zeros(0, np.int64)
            self.anchor = self.context = np.zeros(0, np.uint64)
            return
        grams = PrefixHashes(self.data, 0).every(gram)
        hashes = mix(grams)
        key = (hashes & ~U((1 << PLACE_BITS) - 1)) | np.arange(len(hashes), dtype=np.uint64)
        least, width = key, 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        place = (least & U((1 << PLACE_BITS) - 1)).astype(np.int64)  # by first byte of a window
        text = np.repeat(np.arange(len(texts)), np.diff(np.concatenate(([0], ends))))[: len(place)]
        whole = np.flatnonzero(np.arange(len(place)) + window <= ends[text])
        place, text = place[whole], text[whole]
        new = np.concatenate(([True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])))[: len(place)]
        first = np.flatnonzero(new)
        self.at, self.text = place[first], text[first]
        self.low, self.high = whole[first], whole[np.append(first[1:], len(whole)) - 1] if len(first) else first
        self.anchor = hashes[self.at]
        context = PrefixHashes(self.data, 1).of(self.low, self.high + window)
        shape = (self.at - self.low) * 4096 + (self.high - self.low)
        self.context = mix(context + mix(shape.astype(np.uint64)))


def _blocks(batches: Batches):
    """Texts and the other columns of a few documents at a time."""
    for batch in pieces(batches):
        rows, size = [], 0
        for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True):
            rows.append((row[0].encode(), *row[1:]))
            size += len(rows[-1][0])
            if size >= BLOCK:
                yield list(zip(*rows, strict=True))
                rows, size = [], 0
        if rows:
            yield list(zip(*rows, strict=True))


def _counted(window: int, gram: int):
    def run(batches: Batches) -> Batches:
        for (texts,) in _blocks(batches):
            a = Anchors(texts, window, gram)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.anchor.view(np.int64)), pa.array(a.context.view(np.int64))], ["anchor", "context"]
            )

    return run


def _sliced(table: pa.Table) -> pa.Table:
    at = table.column("bit").to_numpy().astype(np.int64)
    bits = np.zeros(1 << SLICE_BITS, bool)
    bits[at] = True
    raw = np.packbits(bits, bitorder="little").tobytes()
    return pa.table({"mixed": table.column("mixed")[:1], "slice": table.column("slice")[:1], "bits": [raw]})


def bitmaps(repeated: DataFrame) -> tuple[bytes, bytes]:
    """One bit for each leading MAP_BITS of an anchor, for uniform and mixed ones:
    16 MB each at any size of the corpus, put together slice by slice."""
    position = F.shiftrightunsigned("anchor", 64 - MAP_BITS)
    rows = repeated.select(
        "mixed",
        F.shiftright(position, SLICE_BITS).cast("int").alias("slice"),
        position.bitwiseAND(F.lit((1 << SLICE_BITS) - 1)).cast("int").alias("bit"),
    ).distinct()
    made = np.zeros((2, 1 << (MAP_BITS - SLICE_BITS), 1 << (SLICE_BITS - 3)), np.uint8)
    for r in rows.groupBy("mixed", "slice").applyInArrow(_sliced, "mixed boolean, slice int, bits binary").collect():
        made[int(r.mixed), r.slice] = np.frombuffer(r.bits, np.uint8)
    return made[0].tobytes(), made[1].tobytes()


def _in(bits: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    at = anchor >> U(64 - MAP_BITS)
    return (bits[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 > 0


FOUND = (
    "id bigint, digest bigint, anchor bigint, context bigint, mixed boolean, "
    "low array<bigint>, high array<bigint>, place int, bytes binary"
)


def _emitted(shared, window: int, gram: int):
    def run(batches: Batches) -> Batches:
        uniform, mixed = (np.frombuffer(x, np.uint8) for x in shared.value)
        seen: set[int] = set()  # contexts whose bytes this task has given
        for texts, ids, digests in _blocks(batches):
            if len(seen) > REMEMBERED:
                seen.clear()
            a = Anchors(texts, window, gram)
            is_mixed = _in(mixed, a.anchor)
            rows = []
            raw = a.data.tobytes()
            lows, highs = a.low - a.starts[a.text], a.high - a.starts[a.text]
            for k in np.flatnonzero(is_mixed).tolist():
                t, pair = int(a.text[k]), int(a.anchor[k]) << 64 | int(a.context[k])
                own = None if pair in seen else raw[a.low[k] : a.high[k] + window]
                seen.add(pair)
                rows.append((t, k, True, [int(lows[k])], [int(highs[k])], int(a.at[k] - a.low[k]), own))
            # anchors of a document met several times are one row
            plain = np.flatnonzero(~is_mixed & _in(uniform, a.anchor))
            order = plain[np.lexsort((a.low[plain], a.anchor[plain], a.text[plain]))]
            if len(order):
                t, h = a.text[order], a.anchor[order]
                cut = np.flatnonzero((t[1:] != t[:-1]) | (h[1:] != h[:-1])) + 1
                for part in np.split(order, cut):
                    rows.append(
                        (int(a.text[part[0]]), int(part[0]), False, lows[part].tolist(), highs[part].tolist(), None, None)
                    )
            if rows:
                t, k, kind, low, high, place, own = zip(*rows, strict=True)
                k = np.array(k)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[x] for x in t], pa.int64()),
                        pa.array([digests[x] for x in t], pa.int64()),
                        pa.array(a.anchor[k].view(np.int64)),
                        pa.array(a.context[k].view(np.int64)),
                        pa.array(kind, pa.bool_()),
                        pa.array(low, pa.list_(pa.int64())),
                        pa.array(high, pa.list_(pa.int64())),
                        pa.array(place, pa.int32()),
                        pa.array(own, pa.binary()),
                    ],
                    ["id", "digest", "anchor", "context", "mixed", "low", "high", "place", "bytes"],
                )

    return run


def _padded(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    rows = np.zeros((len(parts), width), np.uint8)
    rows[np.arange(width)[None, :] < sizes[:, None]] = np.frombuffer(b"".join(parts), np.uint8)
    return rows, sizes


def repeated_windows(
    group: np.ndarray, place: np.ndarray, parts: list[bytes], copies: np.ndarray, window: int
) -> tuple[np.ndarray, np.ndarray]:
    """For contexts of ascending groups, each given once with its number of copies:
    the least and the greatest distance from a window's first byte to the anchor
    such that this window occurs more than once; -1 where there is none.

    All windows of a context hold its anchor, so what the repeated ones cover is
    one run from the farthest first byte to the nearest one's end."""
    n = len(parts)
    nearest = np.array([len(p) for p in parts], np.int64) - window  # windows start at 0..nearest
    least, most = place - nearest, place
    width = int(most.max()) + 1
    after = Strings(*_padded([p[k:] for p, k in zip(parts, place.tolist(), strict=True)], window))
    before = Strings(*_padded([p[:k][::-1] for p, k in zip(parts, place.tolist(), strict=True)], max(width, 1)))
    distance = np.arange(width)
    classes = []
    for strings, needed in ((after, window - distance), (before, distance)):
        order, common = sorted_common(strings, group)
        breaks = common[:, None] < needed[None, :]
        breaks[common < 0] = True
        number = np.empty((n, width), np.int64)
        number[order] = np.cumsum(breaks, axis=0)
        classes.append(number)
    inside = (distance[None, :] >= least[:, None]) & (distance[None, :] <= most[:, None])
    key = (distance[None, :] * (n + 1) + classes[0]) * (n + 1) + classes[1]
    _, at, count = np.unique(key[inside], return_inverse=True, return_counts=True)
    again = np.zeros((n, width), bool)
    again[inside] = count[at] > 1
    again |= inside & (copies > 1)[:, None]
    some = again.any(axis=1)
    low = np.where(some, again.argmax(axis=1), -1)
    high = np.where(some, width - 1 - again[:, ::-1].argmax(axis=1), -1)
    return low, high


REACH = "anchor bigint, context bigint, nearest bigint, farthest bigint"


def _reached(window: int):
    """Contexts, each once, sorted by anchor: how far their repeated windows reach."""

    def whole(rows: list[tuple]):
        anchors = np.array([r[0] for r in rows])
        copies = np.array([r[4] for r in rows])
        size = np.bincount(np.unique(anchors, return_inverse=True)[1])
        lone = np.repeat(size, size) == 1
        look = np.flatnonzero(~lone | (copies > 1))
        step = max(1, CELLS // window)
        while len(look):
            # as many contexts as fit, whole groups
            n = min(step, len(look))
            while n < len(look) and anchors[look[n]] == anchors[look[n - 1]]:
                n += 1
            part, look = look[:n], look[n:]
            group = np.cumsum(np.concatenate(([0], anchors[part][1:] != anchors[part][:-1])))
            places, parts = np.array([rows[k][2] for k in part]), [rows[k][3] for k in part]
            low, high = repeated_windows(group, places, parts, copies[part], window)
            some = np.flatnonzero(low >= 0)
            contexts = np.array([rows[part[k]][1] for k in some], np.int64)
            arrays = [pa.array(x.astype(np.int64)) for x in (anchors[part[some]], contexts, low[some], high[some])]
            yield pa.RecordBatch.from_arrays(arrays, ["anchor", "context", "nearest", "farthest"])

    def run(batches: Batches) -> Batches:
        names = "anchor", "context", "place", "bytes", "copies"
        held: list[tuple] = []
        for batch in pieces(batches, 1000):
            held.extend(zip(*(batch.column(c).to_pylist() for c in names), strict=True))
            last = held[-1][0]
            cut = len(held)
            while cut and held[cut - 1][0] == last:
                cut -= 1
            if cut > 4000:
                yield from whole(held[:cut])
                held = held[cut:]
        if held:
            yield from whole(held)

    return run


def _windows(window: int):
    """(anchor, context, distance, copies, one, two): every window of a context by
    two hashes."""

    def run(batches: Batches) -> Batches:
        for batch in pieces(batches, 500):
            out = []
            for anchor, context, place, raw, copies in zip(
                *(batch.column(c).to_pylist() for c in ("anchor", "context", "place", "bytes", "copies")), strict=True
            ):
                data = np.frombuffer(raw, np.uint8)
                one, two = (mix(PrefixHashes(data, k).every(window)).view(np.int64) for k in (0, 1))
                n = len(one)
                out.append((np.full(n, anchor), np.full(n, context), place - np.arange(n), np.full(n, copies), one, two))
            arrays = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["anchor", "context", "distance", "copies", "one", "two"])

    return run


def _counted_reach(contexts: DataFrame, window: int) -> DataFrame:
    """What ``_reached`` does, for anchors of very many contexts: by counting windows."""
    spec = "anchor bigint, context bigint, distance bigint, copies bigint, one bigint, two bigint"
    windows = stored(contexts.mapInArrow(_windows(window), spec), "windows")
    key = ["anchor", "distance", "one", "two"]
    often = stored(windows.groupBy(*key).agg(F.sum("copies").alias("n")).filter("n > 1").drop("n"), "often")
    return (
        windows.join(often, key, "left_semi")
        .groupBy("anchor", "context")
        .agg(F.min("distance").alias("nearest"), F.max("distance").alias("farthest"))
    )


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(id, digest, first, last): byte spans to remove, in arrays, by the key of
    ``_rows``; a document may have several rows, and spans may overlap."""
    spark, rows = docs.sparkSession, _rows(docs)
    pairs = rows.select("text").mapInArrow(_counted(window, gram), "anchor bigint, context bigint")
    counts = pairs.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), (F.min("context") != F.max("context")).alias("mixed")
    )
    repeated = stored(counts.filter("n > 1"), "repeated")
    shared = spark.sparkContext.broadcast(bitmaps(repeated))  # 32 MB at any size
    found = stored(rows.select("text", "id", "digest").mapInArrow(_emitted(shared, window, gram), FOUND), "found")
    uniform = repeated.filter("not mixed").select("anchor")
    plain = (
        found.filter("not mixed")
        .select("id", "digest", "anchor", "low", "high")
        .join(uniform, "anchor", "left_semi")
        .select("id", "digest", F.col("low").alias("first"), F.transform("high", lambda x: x + window).alias("last"))
    )
    mixed = found.filter("mixed")
    # equal contexts become one before anything meets by anchor
    contexts = stored(
        mixed.groupBy("anchor", "context").agg(
            F.count(F.lit(1)).alias("copies"), F.first("place").alias("place"), F.first("bytes", True).alias("bytes")
        ),
        "contexts",
    )
    heavy = stored(contexts.groupBy("anchor").count().filter(F.col("count") > hot).select("anchor"), "heavy")
    n_heavy = heavy.count()
    cold, reach = contexts, []
    if n_heavy:
        few = F.broadcast(heavy) if n_heavy <= BROADCAST_KEYS else heavy
        reach.append(_counted_reach(contexts.join(few, "anchor", "left_semi"), window))
        cold = contexts.join(few, "anchor", "left_anti")
    dealt = spread(cold, "anchor").sortWithinPartitions("anchor")
    reach.append(dealt.select("anchor", "context", "place", "bytes", "copies").mapInArrow(_reached(window), REACH))
    every = reach[0] if len(reach) == 1 else reach[0].unionByName(reach[1])
    at = F.col("low")[0] + F.col("place")
    spans = mixed.select("id", "digest", "anchor", "context", at.alias("at")).join(stored(every, "reach"), ["anchor", "context"])
    first, last = F.array(F.col("at") - F.col("farthest")), F.array(F.col("at") - F.col("nearest") + window)
    return plain.union(spans.select("id", "digest", first.alias("first"), last.alias("last")))


def _rows(docs: DataFrame) -> DataFrame:
    """A row's key: its id (least of all where null) and a hash of its text. Rows
    equal in both have the same spans, and each gets them."""
    least = F.lit(-(1 << 63))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of()).select(
        "doc_id", "text", F.coalesce("doc_id", least).alias("id"), F.xxhash64("text").alias("digest")
    )


def _merged(first: list[int], last: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(first, last, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, digest: bool = False
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): every row with the bytes that
    stay, or, with ``digest``, their SHA-256 in hex as bytes. Cutting can split a
    character, so what stays is binary."""
    spans = repeated_spans(docs, window, gram, hot)
    lists = spans.groupBy("id", "digest").agg(
        F.flatten(F.collect_list("first")).alias("first"), F.flatten(F.collect_list("last")).alias("last")
    )
    joined = _rows(docs).join(lists, ["id", "digest"], "left").select("doc_id", "text", "first", "last")

    def run(batches: Batches) -> Batches:
        for batch in pieces(batches):
            out = []
            for doc, text, first, last in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                raw, at, kept, removed = text.encode(), 0, [], 0
                runs = _merged(first or [], last or [])
                for a, b in runs:
                    kept.append(raw[at:a])
                    removed, at = removed + b - a, b
                stays = b"".join([*kept, raw[at:]])
                stays = hashlib.sha256(stays).hexdigest().encode() if digest else stays
                out.append((doc, len(raw), removed, len(runs), stays))
            kinds = pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()
            arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    spec = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    return joined.mapInArrow(run, spec)
