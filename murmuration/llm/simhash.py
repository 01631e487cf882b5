"""Near-duplicate documents by 64-bit SimHash.

Fingerprints are made where the documents are read; only distinct fingerprints
go on, so exact copies weigh nothing. To find all pairs within ``radius`` bits,
the 64 bits are cut into parts: as few parts differ as bits do, so near
fingerprints agree in at least ``parts - radius`` parts, and meet under the key
of those. Keys are dealt into buckets of some ten thousand fingerprints; a key
with many is cut once more by its remaining bits, which bounds what one key can
hold (2^16 fingerprints for the usual radius of 2). All fingerprints of a bucket are
one Gray-order index, in which each of them is looked up: every link comes from
there. What leaves it is fewer links than fingerprints, never all pairs of a
large group, and components join the links.

Very long texts are fingerprinted whole; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from murmuration.llm.common import Batches, map_rows, pieces, spread, stored, text_of
from murmuration.llm.components import components
from murmuration.llm.gray_index import linked
from murmuration.llm.jaccard import FIRST, bands, groups_of, near_components

SEED = 42
WORDS = 3
RADIUS = 2
#: Jaccard similarity of shingles that confirms a link in ``keep_one``.
SIMILARITY = 0.8
#: More fingerprints than this under one key are dealt again by more bits.
HOT = 1 << 15
#: How often keys that are still hot are cut again.
CUTS = 1
#: Fingerprints of a bucket, about.
BUCKET = 1 << 14
#: Keys broadcast at most, of 16 bytes each.
BROADCAST_KEYS = 100_000


def tokens_of(text: str | None) -> list[bytes]:
    """Blanks are ASCII white space, letters A-Z count as a-z."""
    return (text or "").encode().lower().split()


def shingle_hashes(tokens: list[bytes], words: int) -> np.ndarray:
    """A hash of each run of so many words, of all words if they are fewer."""
    if not tokens:
        return np.zeros(0, "<u8")
    whole = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)], "<u8")
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    digest = xxhash.xxh64_intdigest
    spans = zip((ends - sizes).tolist(), ends[words - 1 :].tolist(), strict=False)
    return np.array([digest(whole[a:b], SEED) for a, b in spans], "<u8")


def majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    major = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(major.view("<u8")[0])


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The bits that most shingles have; no words: zero."""
    return majority(shingle_hashes(tokens_of(text), words))


def text_digest(tokens: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(tokens), SEED)


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, code): the fingerprint as a signed 64-bit integer."""

    def columns(batch: pa.RecordBatch) -> dict:
        codes = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64)
        return {"doc_id": batch.column("doc_id"), "code": codes.view(np.int64)}

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of()), "doc_id long,code long", columns)


def cut(bits: list[int], radius: int, parts: int) -> list[int]:
    """Masks of all choices of ``parts - radius`` of ``parts`` runs of the bits."""
    runs = [sum(1 << int(b) for b in run) for run in np.array_split(bits, parts)]
    return [sum(chosen) for chosen in combinations(runs, parts - radius)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keyed(rows: DataFrame) -> DataFrame:
    """(route, mask, key, code): the masked bits of each code for every choice of
    its column ``choices``."""
    each = rows.select("code", F.explode("choices").alias("c")).select("c.*", "code")
    return each.select("route", "mask", F.col("code").bitwiseAND(F.col("mask")).alias("key"), "code")


def _choices(name: str, fixed: int, bits: list[int], radius: int, parts: int) -> list[tuple[str, int]]:
    return [(f"{name}.{k}", _signed(fixed | m)) for k, m in enumerate(cut(bits, radius, parts))]


CHOICES = "array<struct<route: string, mask: bigint>>"


def _links(radius: int):
    """Links inside complete groups of equal ``bucket``, which are sorted: the codes
    of a group become one Gray-order index, and each of them asks it."""

    def joined(codes: list[np.ndarray]) -> pa.RecordBatch:
        own = np.unique(np.concatenate(codes))
        label = linked(own.view(np.uint64), radius)
        other = np.flatnonzero(label != np.arange(len(own)))
        return pa.RecordBatch.from_arrays([pa.array(own[other]), pa.array(own[label[other]])], ["a", "b"])

    def run(batches: Batches) -> Batches:
        now, held = None, []
        for batch in batches:
            buckets, codes = batch.column("bucket").to_numpy(), batch.column("code").to_numpy()
            edges = [0, *(np.flatnonzero(buckets[1:] != buckets[:-1]) + 1).tolist(), len(buckets)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a < b:
                    if buckets[a] != now:
                        if held:
                            yield joined(held)
                        now, held = buckets[a], []
                    held.append(codes[a:b])
        if held:
            yield joined(held)

    return run


def links(codes: DataFrame, radius: int = RADIUS, parts: int | None = None, hot: int = HOT, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between codes that join whatever chains of pairs within the
    radius join. ``codes`` are distinct.

    Keys only say where codes meet: those under one key lie in one bucket, which
    holds the codes of many keys, and its index finds all pairs among them. Keys of
    more than ``hot`` codes are dealt by more bits, ``CUTS`` times at most, as each
    time multiplies their rows; what is still together then is one bucket."""
    spark, parts = codes.sparkSession, parts or radius + 2
    first = spark.createDataFrame([(_choices("", 0, list(range(64)), radius, parts),)], f"choices {CHOICES}")
    keyed, light = _keyed(codes.crossJoin(F.broadcast(first))), []  # one row of choices
    while True:
        sizes = keyed.groupBy("route", "mask", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot)
        heavy = stored(sizes.select("route", "mask", "key"), "heavy")
        found, finer = heavy.count(), []
        for route, mask in heavy.select("route", "mask").distinct().collect():  # as many as choices at most
            bits = [b for b in range(64) if not mask >> b & 1]
            if len(bits) >= 2 * parts and len(light) < CUTS:
                finer.append((route, _choices(route, mask % (1 << 64), bits, radius, parts)))
        if not finer:
            light.append(keyed)
            break
        few = heavy.filter(F.col("route").isin([route for route, _ in finer])).select("route", "key")
        few = F.broadcast(few) if found <= BROADCAST_KEYS else few
        light.append(keyed.join(few, ["route", "key"], "left_anti"))
        table = F.broadcast(spark.createDataFrame(finer, f"route string, choices {CHOICES}"))
        again = keyed.join(few, ["route", "key"], "left_semi").select("route", "code").join(table, "route")
        keyed = stored(_keyed(again.drop("route")), "dealt-again")
    met = reduce(DataFrame.unionByName, light)
    n = max(1, -(-met.count() // bucket))
    dealt = met.select(F.pmod(F.xxhash64("route", "key"), F.lit(n)).alias("bucket"), "code")
    return spread(dealt, "bucket").sortWithinPartitions("bucket").mapInArrow(_links(radius), "a bigint, b bigint")


def _labelled(
    codes: DataFrame, radius: int = RADIUS, parts: int | None = None, hot: int = HOT
) -> DataFrame:
    """(code, root, component_id): of every distinct code the smallest code and
    the smallest id that links lead to. ``codes`` has rows (doc_id, code)."""
    distinct = stored(codes.groupBy("code").agg(F.min("doc_id").alias("first")), "distinct")
    found = components(links(distinct.select("code"), radius, parts, hot))
    roots = stored(
        distinct.join(found.withColumnRenamed("node", "code"), "code", "left").select(
            "code", "first", F.coalesce("component", "code").alias("root")
        ),
        "roots",
    )
    smallest = stored(roots.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    return stored(roots.join(smallest, "root").select("code", "root", "component_id"), "labels")


def near_duplicates(
    docs: DataFrame, words: int = WORDS, radius: int = RADIUS, parts: int | None = None, hot: int = HOT
) -> DataFrame:
    """(doc_id, code, component_id): one row for every row of ``docs``.

    Documents link when their fingerprints differ in at most ``radius`` bits;
    ``component_id`` is the smallest id that links lead to. Null and empty texts
    have fingerprint zero and link to each other. Rows without an id link like
    others; a component of such rows alone has the id null. Rows that repeat an
    id are separate documents. Other columns are ignored.
    """
    codes = stored(fingerprints(docs, words), "codes")
    return codes.join(_labelled(codes, radius, parts, hot), "code").select("doc_id", "code", "component_id")


def _signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, sid, code, bands): digest of the words, fingerprint, MinHash bands."""

    def columns(batch: pa.RecordBatch) -> dict:
        sids, codes, keys = [], [], []
        for text in batch.column("text"):  # one text's words and hashes at a time
            tokens = tokens_of(text.as_py())
            hashes = shingle_hashes(tokens, words)
            sids.append(text_digest(tokens))
            codes.append(majority(hashes))
            keys.append(bands(hashes))
        signed = (np.array(x, np.uint64).view(np.int64) for x in (sids, codes))
        return {"doc_id": batch.column("doc_id"), **dict(zip(("sid", "code"), signed, strict=True)), "bands": keys}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of())
    return map_rows(rows, "doc_id long,sid long,code long,bands array<long>", columns)


def _shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(sid, members) of the texts of ``wanted``, rows (sid, first) with one id each."""

    def digests(batch: pa.RecordBatch) -> dict:
        sids = np.array([text_digest(tokens_of(t)) for t in batch.column("text").to_pylist()], np.uint64)
        return {"doc_id": batch.column("doc_id"), "sid": sids.view(np.int64), "text": batch.column("text")}

    def members(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").to_pylist()
        return {
            "sid": batch.column("sid"),
            "members": [np.unique(shingle_hashes(tokens_of(t), words)).astype("<u8").tobytes() for t in texts],
        }

    rows = map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of()), "doc_id long,sid long,text string", digests)
    w = wanted.select(F.col("sid").alias("_sid"), "first")
    own = rows.join(w, (F.col("sid") == F.col("_sid")) & F.col("doc_id").eqNullSafe(F.col("first"))).select("sid", "text")
    return map_rows(own, "sid long,members binary", members).dropDuplicates(["sid"])


def _confirmed_labels(
    docs: DataFrame, rows: DataFrame, words: int, similarity: float, radius: int, parts: int | None, hot: int
) -> DataFrame:
    """(sid, root, component_id), as ``_labelled`` but by confirmed links alone."""
    distinct = stored(
        rows.groupBy("sid").agg(F.min("doc_id").alias("first"), F.min("code").alias("code"), F.first("bands").alias("bands")),
        "distinct",
    )
    codes = stored(distinct.filter(F.size("bands") > 0).groupBy("code").agg(F.min("sid").alias("sid")), "codes")
    by_code = stored(links(codes.select("code"), radius, parts, hot).distinct(), "near-codes")
    ends = by_code.select("a", F.explode(F.array("a", "b")).alias("code")).distinct().join(codes, "code")
    by_code = ends.select(F.xxhash64("a", F.lit("code")).alias("key"), "sid", F.lit(True).alias("early"))
    by_band = distinct.select("sid", F.posexplode("bands").alias("band", "key")).select("key", "sid", (F.col("band") < FIRST).alias("early"))
    keyed = stored(by_band.union(by_code), "keyed")
    sizes = stored(groups_of(keyed), "sizes")
    asked = keyed.join(sizes.select("key"), "key", "left_semi").select("sid").distinct()
    sets = stored(_shingle_sets(docs, distinct.select("sid", "first").join(asked, "sid"), words), "sets")
    found = near_components(keyed, sizes, sets, similarity)
    roots = stored(
        distinct.join(found.withColumnRenamed("node", "sid"), "sid", "left").select(
            "sid", "first", F.coalesce("component", "sid").alias("root")
        ),
        "roots",
    )
    smallest = stored(roots.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    return stored(roots.join(smallest, "root").select("sid", "root", "component_id"), "labels")


def keep_one(
    docs: DataFrame,
    words: int = WORDS,
    radius: int = RADIUS,
    parts: int | None = None,
    hot: int = HOT,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """The rows of ``docs``, all columns, that stay when of every component only
    one does: one with the smallest id; a row without an id only where no row of
    the component has one. Texts link when their sets of shingles overlap by the
    Jaccard similarity; fingerprints within ``radius`` and MinHash bands only say
    which texts to compare. Texts of the same words are one text, told by a
    64-bit digest. The names _own, _sid, _id and _n are reserved."""
    rows = stored(_signatures(docs, words), "signatures")
    labels = _confirmed_labels(docs, rows, words, similarity, radius, parts, hot)
    first = rows.select("doc_id", "sid").join(labels, "sid").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = stored(first.select("doc_id", "sid", "root"), "first")
    # one text for each component; only a repeated id can have more than one row
    each = first.groupBy("root").agg(
        F.min("sid").alias("_sid"), F.min("doc_id").alias("_id"), F.count(F.lit(1)).alias("_n")
    )
    one = stored(each.drop("root"), "one")
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("_own", T.LongType())])

    def run(batches: Batches) -> Batches:
        for batch in pieces(batches):
            own = np.array([text_digest(tokens_of(t)) for t in batch.column(at).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.view(np.int64))], [*batch.schema.names, "_own"])

    id_ = F.col("doc_id").cast("long")
    kept = docs.mapInArrow(run, schema).join(one, (F.col("_own") == F.col("_sid")) & id_.eqNullSafe(F.col("_id")))
    single = kept.filter("_n = 1").select(*docs.columns)
    repeated = kept.filter("_n > 1").dropDuplicates(["_sid"]).select(*docs.columns)
    return single.union(repeated)


def as_hex(code: str = "code"):
    """A fingerprint as 16 lower-case digits."""
    return F.lower(F.lpad(F.hex(code), 16, "0"))
