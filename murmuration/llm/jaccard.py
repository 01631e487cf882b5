"""Pairs of texts whose sets of shingles overlap by a given Jaccard similarity.

Candidates come as groups (key, sid): texts under one key are to be compared.
Bands of MinHash values give such keys; two texts of similarity 0.8 share one of
20 bands of four values with probability 1 - (1 - 0.8^4)^20, all but 3 in 100,000.
Only the shingles' hashes decide: they are brought to the key's groups, and what
leaves a task is a confirmed link. A first round looks at few bands and deals a
large group over tasks in blocks, each with one common member; a second one
looks at all keys, and there only at pairs that no links join yet. Blocks of one
component never meet each other, so a large group of near copies costs little.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from murmuration.llm.common import Batches, pieces, spread, stored
from murmuration.llm.components import components

SEED = 42
BANDS, ROWS = 20, 4
#: Bands of the first round.
FIRST = 4
#: Texts of a block, about.
BLOCK = 256
_ADD, _ODD = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * ROWS, 1), dtype=np.uint64)
_ODD |= np.uint64(1)


def bands(hashes: np.ndarray) -> np.ndarray:
    """One signed 64-bit key for each band; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for k in range(0, len(hashes), 1024):
        np.minimum(least, ((hashes[k : k + 1024] ^ _ADD) * _ODD).min(axis=1), out=least)
    raw, size = least.tobytes(), 8 * ROWS
    keys = [xxhash.xxh64_intdigest(raw[b * size : (b + 1) * size], b) for b in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64)


def joined(sets: list[np.ndarray], label: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of positions that reach the similarity, enough of them to join all
    that such pairs join and that equal labels do not. Sets have no repeats."""
    sizes = np.array([len(s) for s in sets])
    firsts = np.cumsum(sizes) - sizes
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    label, mark, out = label.copy(), np.zeros(len(values), bool), []
    part = round(similarity * 10_000)
    for a in range(len(sets) - 1):
        if (label[a + 1 :] == label[a]).all():
            continue
        own = at[firsts[a] : firsts[a] + sizes[a]]
        mark[own] = True
        both = np.add.reduceat(mark[at[firsts[a + 1] :]], firsts[a + 1 :] - firsts[a + 1], dtype=np.int64)
        mark[own] = False
        near = 10_000 * both >= part * (sizes[a] + sizes[a + 1 :] - both)
        for b in (np.flatnonzero(near) + a + 1).tolist():
            if label[a] != label[b]:
                out.append((a, b))
                label[label == label[b]] = label[a]
    return out


def _confirm(similarity: float):
    def links(rows):
        rows = [r for r in rows if r[2]]  # an empty set is near to none
        if len(rows) < 2:
            return []
        _, label = np.unique([r[1] for r in rows], return_inverse=True)
        pairs = joined([np.frombuffer(r[2], "<u8") for r in rows], label, similarity)
        return [(rows[a][0], rows[b][0]) for a, b in pairs]

    def run(batches: Batches) -> Batches:
        group, rows = None, []
        for batch in pieces(batches):
            out = []
            for *unit, sid, comp, members in zip(*(batch.column(c).to_pylist() for c in COLUMNS), strict=True):
                if unit != group:
                    out += links(rows)
                    group, rows = unit, []
                rows.append((sid, comp, members))
            yield _batch(out)
        yield _batch(links(rows))

    return run


COLUMNS = ("key", "i", "j", "sid", "comp", "members")


def _batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _confirmed(units: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    rows = units.join(sets, "sid").select(*COLUMNS)
    dealt = spread(rows, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(_confirm(similarity), "a bigint, b bigint")


def _blocks(count, *salt):
    """A block by the hash of the text, for about BLOCK texts each."""
    return F.pmod(F.xxhash64("sid", *salt), F.ceil(count / F.lit(BLOCK)))


def _first_round(keyed: DataFrame, sizes: DataFrame) -> DataFrame:
    own = F.col("sid").alias("comp")
    rows = keyed.join(sizes, "key").select("key", _blocks(F.col("n")).alias("i"), F.lit(0).cast("long").alias("j"), "sid", own)
    large = sizes.filter(F.col("n") > BLOCK)
    common = large.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / F.lit(BLOCK)) - 1)).alias("i"), F.col("least").alias("sid"))
    return rows.union(common.select("key", "i", F.lit(0).cast("long").alias("j"), "sid", own))


def _open_pairs(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """Units of all texts under one key that ``found`` does not join."""
    labels = found.select(F.col("node").alias("sid"), "component")
    rows = keyed.join(labels, "sid", "left").select("key", "sid", F.coalesce("component", "sid").alias("comp"))
    rows = stored(rows, "labelled")
    each = stored(rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")), "each")
    few = F.when(F.col("n") < BLOCK, F.col("n")).otherwise(0)
    mixed = stored(each.groupBy("key").agg(F.count(F.lit(1)).alias("comps"), F.sum(few).alias("few")).filter("comps > 1").drop("comps"), "mixed")
    whole = F.col("n") >= BLOCK
    own = F.xxhash64("comp", _blocks(F.col("n"), F.lit(1)))
    rows = each.join(mixed, "key").join(rows, ["key", "comp"]).select(
        "key", "sid", "comp",
        F.when(whole, own).otherwise(_blocks(F.col("few"), F.lit(2))).alias("block"),
        F.when(whole, F.col("comp")).alias("only"),
    )
    rows = stored(rows, "blocks")
    blocks = rows.groupBy("key", "block").agg(F.first("only").alias("only"))
    left, right = (blocks.select("key", F.col("block").alias(x), F.col("only").alias(f"only_{x}")) for x in "ij")
    units = left.join(right, "key").filter("i <= j and not coalesce(only_i = only_j, false)").select("key", "i", "j")
    sides = units.select("key", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"), "i", "j")
    return rows.drop("only").join(sides, ["key", "block"]).drop("block")


def groups_of(keyed: DataFrame) -> DataFrame:
    """(key, n, least) of the keys that have more than one text."""
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("sid").alias("least")).filter("n > 1")


def near_components(keyed: DataFrame, sizes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(node, component) of the texts that confirmed links join. ``keyed`` has
    distinct rows (key, sid, early): those marked early are of the first round;
    ``sizes`` is what ``groups_of`` makes of it; ``sets`` has (sid, members),
    sorted 64-bit hashes, for every text of such a key."""
    early = keyed.filter("early").select("key", "sid")
    links = stored(_confirmed(_first_round(early, sizes), sets, similarity), "confirmed")
    open_ = _open_pairs(keyed.join(sizes.select("key"), "key", "left_semi").select("key", "sid"), components(links))
    further = stored(_confirmed(open_.select(*COLUMNS[:-1]), sets, similarity), "confirmed")
    return components(links.union(further))
