import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from murmuration.llm import ppm
from murmuration.llm.lm_scoring import SYMBOLS, WORDS, Events, learns, pack_keys, plain, score_texts, unpack_keys


class Plain:
    """The same model from dictionaries of contexts, symbol by symbol."""

    def __init__(self, texts, order):
        self.order, self.seen = order, defaultdict(Counter)
        for t in texts:
            data = b"\n" * order + t + b"\n"
            for i in range(order, len(data)):
                self.seen[data[i - order : i]][data[i]] += 1
        for k in range(order, 0, -1):  # a shorter context counts the longer ones
            for context in [c for c in self.seen if len(c) == k]:
                self.seen[context[1:]].update(set(self.seen[context]))

    def probability(self, context, symbol):
        p, gone = 1.0, set()
        for k in range(self.order, -1, -1):
            own = self.seen.get(context[self.order - k :])
            if own is None:
                continue
            left = {s: n for s, n in own.items() if s not in gone}
            total = 2 * sum(left.values())
            if symbol in left:
                return p * (2 * left[symbol] - 1) / total
            if left:
                p *= len(left) / total
            gone |= set(own)
        return p / (256 - len(gone)) if len(gone) < 256 else p

    def score(self, text):
        data = b"\n" * self.order + text + b"\n"
        return sum(math.log10(self.probability(data[i - self.order : i], data[i])) for i in range(self.order, len(data)))


def held_out(doc):
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % 10 == 0


def brute(docs, order):
    texts = [(i, plain(t or "")) for i, t in docs]
    train = [t for i, t in texts if not held_out(i)]
    tokens = Counter(w for t in train for w in [*t.split(), b""])
    n, v = sum(tokens.values()), len(tokens)
    model = Plain(train, order)
    out = []
    for i, t in texts:
        own = [*t.split(), b""]
        base = sum(math.log10((tokens[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        out.append((i, held_out(i), len(own), sum(tokens[w] > 0 for w in own), n, base, model.score(t)))
    return out


def same(got, want):
    key = lambda r: (str(r[0]), r[2], r[3], round(r[5], 4), round(r[6], 3))
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for k, precision in ((5, 1e-9), (6, 1e-6)):
        np.testing.assert_allclose([r[k] for r in got], [r[k] for r in want], rtol=precision, atol=precision)


def corpus(seed, n=60):
    rng = np.random.default_rng(seed)
    words = ["the", "The", "then", "hat", "élan", "a", "b\x00c", "ß", "10%", "ending."]
    return [(i, "".join(str(rng.choice(words)) + str(rng.choice([" ", "  ", "\n", "\t"])) for _ in range(rng.integers(0, 25)))) for i in range(n)]


@pytest.mark.parametrize("settings", [{}, {"order": 2}, {"order": 3, "batch_bytes": 50, "shard_bytes": 20, "asked": 10}, {"order": 6}])
def test_equals_brute_force(spark, make_docs, settings):
    docs = corpus(1)
    same(score_texts(make_docs(docs).repartition(3), **settings).collect(), brute(docs, settings.get("order", ppm.ORDER)))


def test_odd_rows(spark, make_docs):
    docs = [(None, "a b"), (None, None), (3, "a b"), (3, "a b"), (4, None), (5, ""), (-6, " \t\n"), (7, "ab " * 20_000)]
    given = make_docs(docs).selectExpr("*", "doc_id as batch", "text as keys", "doc_id as score", "n_chars as kind")
    same(score_texts(given).collect(), brute(docs, ppm.ORDER))


def test_empty_table_and_no_training(spark, make_docs):
    assert score_texts(make_docs([])).collect() == []
    ids = [i for i in range(100) if held_out(i)][:3]
    docs = [(i, "some text") for i in ids]
    got = score_texts(make_docs(docs)).collect()
    same(got, brute(docs, ppm.ORDER))
    assert got[0].score == pytest.approx(-10 * math.log10(256), rel=1e-6)


def test_result_does_not_depend_on_batches(spark, make_docs):
    docs = make_docs(corpus(3, 200))
    one = {r.doc_id: r for r in score_texts(docs.coalesce(1)).collect()}
    many = {r.doc_id: r for r in score_texts(docs.repartition(7), batch_bytes=300, shard_bytes=500, asked=100).collect()}
    assert one.keys() == many.keys()
    assert all(one[k].score == pytest.approx(many[k].score, rel=1e-6) for k in one)


@pytest.mark.parametrize("order", [2, 4, 6])
def test_probabilities_of_a_context_add_up_to_one(order):
    rng = np.random.default_rng(order)
    texts = [bytes(rng.choice(list(b"abcde "), 60).tolist()) for _ in range(20)]
    keys, which, _ = ppm.events(texts, order)
    trie = ppm.Trie(keys, np.bincount(which), order)
    contexts = np.concatenate([keys[:50] >> np.uint64(8), rng.integers(0, 1 << 8 * order, 20, dtype=np.uint64)])
    for c in contexts:
        row = (np.uint64(c) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert (10 ** trie.log10(row)).sum() == pytest.approx(1)


def test_shards_equal_the_whole_trie():
    texts = [t.encode() for _, t in corpus(5)]
    keys, which, _ = ppm.events(texts, 4)
    counts = np.bincount(which)
    whole = ppm.Trie(keys, counts, 4)
    pairs = ppm.pair_counts(keys, 4)
    shard = (keys >> np.uint64(24)) % np.uint64(3)
    for s in range(3):
        part = ppm.Trie(keys[shard == s], counts[shard == s], 4, pairs)
        np.testing.assert_allclose(part.log10(keys[shard == s]), whole.log10(keys[shard == s]))


@pytest.mark.parametrize("segment", [1, 7, 64])
def test_segments_do_not_matter(segment):
    texts = [b"", b"abc abc", b"x" * 50, b"abc"]
    whole, cut = ppm.events(texts, 3), ppm.events(texts, 3, segment)
    for a, b in zip(whole, cut, strict=True):
        assert (a == b).all()
    keys, which, lengths = whole
    assert lengths.tolist() == [1, 8, 51, 4] and len(which) == 64
    assert (keys[which] & np.uint64(255)).astype(np.uint8).tobytes() == b"\nabc abc\n" + b"x" * 50 + b"\nabc\n"


def test_keys_pack_and_unpack():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64))
    assert (unpack_keys(SYMBOLS, pack_keys(SYMBOLS, keys)) == keys).all()
    assert len(unpack_keys(SYMBOLS, pack_keys(SYMBOLS, keys[:0]))) == 0
    words = [b"", b"a", b"\x00"]
    assert unpack_keys(WORDS, pack_keys(WORDS, words)) == words


def test_events_give_every_symbol_and_word_a_place():
    events = Events([b"a b a", b""], 3, 3)
    assert events.word_counts.tolist() == [4, 1] and events.symbol_counts.tolist() == [6, 1]
    symbols, words = events.counts(np.array([True, False]))
    assert symbols.sum() == 6 and dict(zip(events.words, words.tolist(), strict=True)) == {b"a": 2, b"b": 1, b"": 1}
    assert (np.diff(events.key_shards) >= 0).all() and (np.diff(events.word_shards) >= 0).all()


def test_held_out_documents_are_better_known_than_by_words_alone(spark):
    got = score_texts(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).filter("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert learns(1) != learns(None)
