import random
import string
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from murmuration.llm import rans
from murmuration.llm import token_output as module
from murmuration.llm.token_output import WordEncoder, digests, read_tokens, token_output, tokenizer_path, write_tokens
from murmuration.plans.stage import run_folder

ODD = [
    None,
    "",
    "  ",
    'the "quoted" 12,5% and it\'s DON\'T. x',
    "á b　c\x85d e, f.. g's don't <|endoftext|> x<|endoftext|>y <|ENDOFTEXT|> I'LL,",
    "İstanbul ΣΑΣ. ́ q́ x5 '. 's. '' _a-b_ [x] `y` a\tb\nc",
    "word " * 5000,
]


def expected(rows):
    t = Tokenizer.from_file(tokenizer_path())
    start, out = 0, {}
    for doc, text in sorted(rows):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        out[doc] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    return out


@pytest.mark.parametrize("n", [0, 1, 63, 64, 5000, 140_000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 49_407).astype(np.uint32) if n else np.zeros(0, np.uint32)
    t = rans.Table.of(ids)
    block = rans.encode(ids, t)
    assert int(t.freqs.sum()) == (1 << rans.BITS if n else 0)
    decoder = rans.Decoder(t)
    assert (decoder.block(block) == ids).all()
    step = rans.CHECKPOINT * block.lanes
    for k in reversed(range(len(block.offsets))):  # every part by itself
        assert (decoder.part(block, k) == ids[k * step : (k + 1) * step]).all()


def test_damage_is_noticed():
    ids = np.arange(5000, dtype=np.uint32) % 77
    t = rans.Table.of(ids)
    block = rans.encode(ids, t)
    words = bytearray(block.words)
    words[5] ^= 1
    damaged = rans.Block(**{**vars(block), "words": bytes(words)})
    with pytest.raises(rans.CorruptBlock):
        rans.Decoder(t).block(damaged)
    with pytest.raises(rans.CorruptBlock):  # also without the checksum of the words
        rans.Decoder(t).block(rans.Block(**{**vars(damaged), "crc_words": zlib.crc32(bytes(words))}))


def test_words_are_encoded_as_whole_texts(spark, folder):
    texts = [t or "" for t in ODD] + [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    t = Tokenizer.from_file(tokenizer_path())
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    got = WordEncoder(tokenizer_path()).encode(texts)
    assert [np.frombuffer(g, np.uint16).tolist() for g in got] == want


class Counted:
    """A tokenizer that counts its calls."""

    def __init__(self, tokenizer):
        self.tokenizer, self.calls = tokenizer, 0

    def encode(self, *a, **b):
        self.calls += 1
        return self.tokenizer.encode(*a, **b)

    def encode_batch_fast(self, *a, **b):
        self.calls += 1
        return self.tokenizer.encode_batch_fast(*a, **b)


def test_new_plain_words_cost_no_call_each():
    rng = random.Random(5)
    letters = string.ascii_letters + "ÀÉàéßøÿ"
    words = ["".join(rng.choices(letters, k=9)) + rng.choice(["", ",", "-7b", "42.5%%"]) for _ in range(30_000)]
    texts = [" ".join(words[k::3]) for k in range(3)]
    want = [e.ids for e in Tokenizer.from_file(tokenizer_path()).encode_batch(texts, add_special_tokens=False)]
    encoder = WordEncoder(tokenizer_path())
    encoder.model, encoder.words.tokenizer = Counted(encoder.model), Counted(encoder.words.tokenizer)
    got = encoder.encode(pa.array(texts))
    assert [np.frombuffer(g, np.uint16).tolist() for g in got] == want
    assert encoder.model.calls <= 3 and encoder.words.tokenizer.calls == 0 and not encoder.words


@pytest.mark.parametrize("remembered, at_once", [(3, 2), (200_000, 20_000)])
def test_odd_texts_in_any_cut(monkeypatch, remembered, at_once):
    monkeypatch.setattr(module, "CACHED_WORDS", remembered)
    monkeypatch.setattr(module, "PIECES_AT_ONCE", at_once)
    signs = ["".join(chr(c) for c in range(33, 127)), *(f"a{chr(c)}B{chr(c)}{chr(c)}0" for c in range(33, 0x180))]
    texts = ["", *[t or "" for t in ODD], " ".join(signs), "\n", "ÀÖØÞ ßöøÿ Ê,È ×÷ ªº µ", "x" * 3000, " a  b "]
    want = [e.ids for e in Tokenizer.from_file(tokenizer_path()).encode_batch(texts, add_special_tokens=False)]
    encoder = WordEncoder(tokenizer_path())
    for most in (1, 50, 1 << 20):
        batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]).slice(1)
        cut = list(module.of_size(iter([batch]), most))
        assert sum(b.num_rows for b in cut) == len(texts) - 1
        got = [g for b in cut for g in encoder.encode(b.column("text"))]
        assert [np.frombuffer(g, np.uint16).tolist() for g in got] == want[1:]
    assert encoder.encode([]) == [] and encoder.encode([""]) == [b""]
    assert [b.num_rows for b in module.of_size(iter([batch.slice(0, 0)]))] == [0]


def test_files_give_back_every_document(spark, make_docs):
    rows = [(k * 7 % 40, t) for k, t in enumerate(ODD * 5)]
    docs = make_docs(rows).withColumn("start", F.lit("mine")).withColumn("bucket", F.lit(1))
    folder = run_folder(spark, "test-tokens")
    write_tokens(docs, folder, shard_tokens=3000, ranges=4)
    assert spark.read.parquet(f"{folder}/shards").count() > 4
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in digests(read_tokens(spark, folder)).collect()}
    assert got == expected(rows)


def test_null_and_repeated_ids(make_docs):
    got = token_output(make_docs([(5, "b"), (None, "first"), (5, "a"), (3, "a")])).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 3, 5, 5]
    assert [r.start for r in got] == [0, 2, 4, 6]


def test_empty_table(make_docs):
    assert token_output(make_docs([("x",)][:0])).count() == 0
