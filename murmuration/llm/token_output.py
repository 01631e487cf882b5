"""Token ids in binary blocks, coded by a static asymmetric numeral system.

Documents are tokenized where they are read. Only ids move: they are shuffled by
ranges of ``doc_id`` and sorted inside each range. A task cuts its range into
shards of about a million ids, one row of a Parquet file each: the frequency
table shared by the blocks of the shard, and independent interleaved blocks with
checkpoints and checksums, so blocks, and parts of blocks, decode in parallel.
Nothing holds more than a shard and one document. A small table beside the
shards gives the first token of every range.

Null or empty texts are documents of the end id alone. A null ``doc_id`` sorts
first; repeated ids are separate documents, in the order of their ids' bytes.
Other columns of the input are ignored. An empty table gives empty files.
"""

from __future__ import annotations

import os
import zlib
from array import array
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from murmuration.llm.common import Batches, pieces, text_of
from murmuration.llm.rans import Block, Decoder, Table, encode
from murmuration.plans.stage import run_folder, shuffle_partitions

END_ID = 1
SHARD_TOKENS = 1 << 20
BLOCK_TOKENS = 1 << 18
CACHED_WORDS = 200_000
PIECES_AT_ONCE = 20_000
ENCODED_BYTES = 4 << 20

BLOCK_TYPE = (
    "struct<n: int, lanes: int, words: binary, states: binary, offsets: array<bigint>, "
    "crc_words: bigint, crc_ids: bigint>"
)
SHARD_SPEC = (
    "bucket int, seq int, n_tokens bigint, doc_ids array<bigint>, doc_tokens array<bigint>, "
    f"symbols binary, freqs binary, blocks array<{BLOCK_TYPE}>"
)
BLOCK_ARROW = pa.struct(
    [
        ("n", pa.int32()),
        ("lanes", pa.int32()),
        ("words", pa.binary()),
        ("states", pa.binary()),
        ("offsets", pa.list_(pa.int64())),
        ("crc_words", pa.int64()),
        ("crc_ids", pa.int64()),
    ]
)
SHARD_ARROW = pa.schema(
    [
        ("bucket", pa.int32()),
        ("seq", pa.int32()),
        ("n_tokens", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("doc_tokens", pa.list_(pa.int64())),
        ("symbols", pa.binary()),
        ("freqs", pa.binary()),
        ("blocks", pa.list_(BLOCK_ARROW)),
    ]
)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: ASCII signs other than the apostrophe (which joins letters) and "<" (special tokens).
SIGNS = "!-&(-/:;=-@\\[-`{-~"
#: Words of letters of ASCII and Latin-1, digits and such signs: the normalizers only
#: lower their letters, and their pieces are runs of letters, single digits and runs of signs.
PLAIN = f"^[A-Za-zÀ-ÖØ-Þß-öø-ÿ0-9{SIGNS}]+$"
NO_LETTERS = f"([0-9]|[{SIGNS}]+)"


def byte_letters() -> dict[str, str]:
    """How a byte-level vocabulary spells a Latin-1 letter: its two UTF-8 bytes,
    where bytes without a printable Latin-1 character follow on from 256."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    of_byte = {b: chr(b if b in printable else next(others)) for b in range(256)}
    return {chr(c): "".join(of_byte[b] for b in chr(c).encode()) for c in range(0xDF, 0x100)}


class _Whole(dict):
    """Words that are not plain, encoded whole."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        self.older: dict[str, bytes] = {}

    def trimmed(self) -> _Whole:
        """Forget what has not been asked for since the memory was last full."""
        if len(self) <= CACHED_WORDS:
            return self
        fresh = _Whole(self.tokenizer)
        fresh.older, self.older = self, {}
        return fresh

    def __missing__(self, word: str) -> bytes:
        if (made := self.older.get(word)) is None:
            made = array("H", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        self[word] = made
        return made


def taken(ids: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``ids`` has runs of these sizes: the runs that ``which`` names, one after the
    other, and their bounds."""
    bounds = np.concatenate(([0], np.cumsum(sizes[which])))
    back = np.repeat((np.cumsum(sizes) - sizes)[which] - bounds[:-1], sizes[which])
    back += np.arange(len(back))
    return ids[back], bounds


class WordEncoder:
    """Ids of whole texts as 16-bit integers.

    This tokenizer never joins what a blank or a line feed separates. Arrow splits
    texts into words, and the plain ones of the distinct words into pieces; the
    distinct pieces go to the tokenizer's model together, without an object of Python
    for each. Other words are encoded whole and remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        whole = Tokenizer.from_file(path)
        vocabulary = whole.get_vocab()
        if len(vocabulary) > 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        self.words = _Whole(whole)
        self.model = Tokenizer(whole.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.ends_piece = np.zeros(1 << 16, bool)
        suffix = whole.model.end_of_word_suffix
        self.ends_piece[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.spelling = byte_letters()

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        if isinstance(texts, list):
            texts = pa.array(texts, pa.string())
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        plain = pc.match_substring_regex(words.dictionary, PLAIN)
        ids, sizes = self._composed(words.dictionary.filter(plain))
        self.words = self.words.trimmed()
        others = [self.words[w] for w in words.dictionary.filter(pc.invert(plain)).to_pylist()]
        ids = np.concatenate((ids, np.frombuffer(b"".join(others), np.uint16)))
        sizes = np.concatenate((sizes, np.array([len(x) // 2 for x in others], np.int64)))
        # plain words come first in ``ids``
        place = np.argsort(np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable"))
        ids, bounds = taken(ids, sizes, place[words.indices.to_numpy()])
        raw = ids.tobytes()
        return [raw[a:b] for a, b in pairwise((2 * bounds[split.offsets.to_numpy()]).tolist())]

    def _composed(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain words, one after the other, and how many each has."""
        spaced = pc.replace_substring_regex(pc.utf8_lower(words), NO_LETTERS, r" \1 ")
        split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(spaced))
        pieces = split.flatten().dictionary_encode()
        distinct = [np.zeros(0, np.uint16)]
        for first in range(0, len(pieces.dictionary), PIECES_AT_ONCE):
            distinct.append(self._modelled(pieces.dictionary.slice(first, PIECES_AT_ONCE)))
        ids = np.concatenate(distinct)
        sizes = np.diff(np.flatnonzero(self.ends_piece[ids]), prepend=-1)
        ids, bounds = taken(ids, sizes, pieces.indices.to_numpy())
        return ids, np.diff(bounds[split.offsets.to_numpy()])

    def _modelled(self, pieces: pa.Array) -> np.ndarray:
        """The model's ids of these pieces; the last of a piece ends a word, no other does."""
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(pieces)], pieces), " ")[0].as_py()
        if not joined.isascii():
            for letter, spelt in self.spelling.items():
                joined = joined.replace(letter, spelt)
        ids = np.array(self.model.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint16)
        if np.count_nonzero(self.ends_piece[ids]) != len(pieces):
            raise ValueError("a piece does not end where the tokenizer ends a word")
        return ids


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per worker process, so that its memory of words outlives a task."""
    if path not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def range_bounds(docs: DataFrame, ranges: int) -> list[int]:
    """Ids that cut the documents into ranges of about equal count."""
    cuts = [k / ranges for k in range(1, ranges)]
    if not cuts:
        return []
    row = docs.select(F.col("doc_id").cast("long").alias("i")).agg(F.percentile_approx("i", cuts, 10_000)).first()
    return sorted(set(row[0] or []))


def of_size(batches: Batches, most: int = ENCODED_BYTES) -> Batches:
    """Batches whose texts have few bytes more than ``most``, unless one text has."""
    for batch in batches:
        sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
        parts = np.cumsum(sizes, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), batch.num_rows]
        for a, b in pairwise(cuts):
            yield batch.slice(a, b - a)


def tokenized(docs: DataFrame, path: str, bounds: list[int]) -> DataFrame:
    """(bucket, doc_id, ids): the range of the document and its 16-bit ids."""
    cuts = np.array(bounds, np.int64)

    def run(batches: Batches) -> Batches:
        for batch in of_size(pieces(batches, 4000)):
            ids = batch.column("doc_id")
            where = np.searchsorted(cuts, ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), "left")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(where, pa.int32()),
                    ids,
                    pa.array(encoder(path).encode(batch.column("text")), pa.binary()),
                ],
                ["bucket", "doc_id", "ids"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of())
    return source.mapInArrow(run, "bucket int, doc_id bigint, ids binary")


def _shard(bucket: int, seq: int, doc_ids: list, parts: list[np.ndarray]) -> dict:
    ids = np.concatenate(parts)
    table = Table.of(ids)
    blocks = [encode(ids[k : k + BLOCK_TOKENS], table) for k in range(0, len(ids), BLOCK_TOKENS)]
    return {
        "bucket": bucket,
        "seq": seq,
        "n_tokens": len(ids),
        "doc_ids": doc_ids,
        "doc_tokens": [len(p) for p in parts],
        "symbols": table.symbols.astype("<u4").tobytes(),
        "freqs": table.freqs.astype("<u4").tobytes(),
        "blocks": [vars(b) for b in blocks],
    }


def _shards(end_id: int, shard_tokens: int):
    def run(batches: Batches) -> Batches:
        _encoders.clear()  # the worker's memory of words is not needed any more
        bucket, seq, doc_ids, parts, held = None, 0, [], [], 0

        def flush():
            return pa.RecordBatch.from_pylist([_shard(bucket, seq, doc_ids, parts)], SHARD_ARROW)

        for batch in pieces(batches):
            for b, doc, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if parts and (b != bucket or held >= shard_tokens):
                    yield flush()
                    seq, doc_ids, parts, held = seq + 1 if b == bucket else 0, [], [], 0
                bucket = b
                doc_ids.append(doc)
                parts.append(np.append(np.frombuffer(raw, "<u2"), np.uint16(end_id)))
                held += len(parts[-1])
        if parts:
            yield flush()

    return run


def write_tokens(
    docs: DataFrame,
    folder: str,
    path: str | None = None,
    end_id: int = END_ID,
    shard_tokens: int = SHARD_TOKENS,
    ranges: int | None = None,
) -> None:
    """Encode the documents into ``folder``/shards and ``folder``/ranges."""
    n = ranges or 2 * shuffle_partitions(docs)
    bounds = range_bounds(docs, n)
    rows = tokenized(docs, path or tokenizer_path(), bounds)
    dealt = rows.repartition(n, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "ids")
    dealt.mapInArrow(_shards(end_id, shard_tokens), SHARD_SPEC).write.parquet(f"{folder}/shards")
    shards = docs.sparkSession.read.parquet(f"{folder}/shards")
    totals = shards.groupBy("bucket").agg(F.sum("n_tokens").alias("n_tokens"))
    # one row per range, of which there are as many as partitions
    starts = F.sum("n_tokens").over(W.orderBy("bucket")) - F.col("n_tokens")
    totals.withColumn("first_token", starts).write.parquet(f"{folder}/ranges")


def _decoded(batches: Batches) -> Batches:
    for batch in pieces(batches, 1):
        for row in batch.to_pylist():
            table = Table(np.frombuffer(row["symbols"], "<u4"), np.frombuffer(row["freqs"], "<u4"))
            decoder = Decoder(table)
            blocks = [decoder.block(Block(**b)) for b in row["blocks"]]
            ids = np.concatenate(blocks).astype("<u4")
            ends = np.cumsum(row["doc_tokens"])
            firsts = ends - row["doc_tokens"]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["start"] + firsts, pa.int64()),
                    pa.array([ids[a:b].tobytes() for a, b in zip(firsts, ends, strict=True)], pa.binary()),
                ],
                ["doc_id", "start", "ids"],
            )


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids): every document of the files, ids as little-endian
    unsigned 32-bit integers, ``start`` counting the ids of all earlier ones."""
    shards = spark.read.schema(SHARD_SPEC).parquet(f"{folder}/shards")
    ranges = spark.read.parquet(f"{folder}/ranges").select("bucket", "first_token")
    # shards of one range follow each other; their counts alone go through the window
    within = F.sum("n_tokens").over(W.partitionBy("bucket").orderBy("seq")) - F.col("n_tokens")
    starts = (
        shards.select("bucket", "seq", "n_tokens")
        .withColumn("within", within)
        .join(ranges, "bucket")
        .select("bucket", "seq", (F.col("within") + F.col("first_token")).alias("start"))
    )
    return shards.join(starts, ["bucket", "seq"]).mapInArrow(_decoded, "doc_id bigint, start bigint, ids binary")


def digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what ``read_tokens`` returns."""

    def run(batches: Batches) -> Batches:
        for batch in pieces(batches):
            raw = batch.column("ids").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("start"),
                    pa.array([len(x) // 4 for x in raw], pa.int64()),
                    pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                ],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return tokens.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_output(docs: DataFrame) -> DataFrame:
    """Write the files to the shared folder, read them back and describe each document."""
    folder = run_folder(docs.sparkSession, "tokens")
    write_tokens(docs, folder)
    return digests(read_tokens(docs.sparkSession, folder))
