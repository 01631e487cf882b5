import re
from collections import Counter

import numpy as np
import pytest

from murmuration.llm.collocations import Grams, collocations, frequent, parts_of
from murmuration.llm.misra_gries import Summary

SCHEMA = "doc_id bigint, text string, lang string"


def counts_of(docs, max_words=3):
    out, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, max_words + 1):
                for i in range(len(words) - size + 1):
                    out[lang, tuple(words[i : i + size])] += 1
    return out, n


def brute(docs, max_words=3, min_count=10, limit=2000, share=50):
    f, n = counts_of(docs, max_words)
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    by_lang = {}
    for (lang, words), a in candidates.items():
        inside = any(
            other == lang and len(longer) > len(words) and 100 * b >= share * a
            and any(longer[i : i + len(words)] == words for i in range(len(longer)))
            for (other, longer), b in candidates.items()
        )
        if inside:
            continue
        cuts = [
            (1_000_000 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]])
            for k in range(1, len(words))
        ]
        score, _, left, right = min(cuts)
        by_lang.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted(
        (lang, rank, phrase.decode(), -a, left, right, n[lang], -score)
        for lang, rows in by_lang.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:limit], 1)
    )


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def corpus(seed, n=150):
    rng = np.random.default_rng(seed)
    words = ["of", "The", "new", "york", "City", "état", "x", "Y-z", "1"]
    blanks = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\r", "\x0b", "!", " new york city ", " a\x00b\x1c "]
    return [
        (
            [None, "und", "en", "de"][int(rng.integers(0, 4))],
            "".join(str(rng.choice(words)) + str(rng.choice(blanks)) for _ in range(rng.integers(0, 40))),
        )
        for _ in range(n)
    ]


def frame(spark, docs):
    return spark.createDataFrame([(i % 7, t, lang) for i, (lang, t) in enumerate(docs)], SCHEMA)


@pytest.mark.parametrize(
    "settings",
    [
        {},
        {"min_count": 2, "limit": 5},
        {"min_count": 3, "max_words": 4, "part_bytes": 50, "chunk": 60, "slack": 1},
        {"min_count": 3, "filter_bits": 8},
        {"share": 90, "max_words": 2},
    ],
)
def test_equals_brute_force(spark, settings):
    docs = corpus(1)
    got = rows(collocations(frame(spark, docs).repartition(5), **settings))
    plain = {k: v for k, v in settings.items() if k in ("min_count", "limit", "max_words", "share")}
    assert got == brute(docs, **plain) and got


def test_counts_equal_brute_force(spark):
    docs = corpus(2)
    f, n = counts_of(docs)
    got = {(r.lang, tuple(r.phrase.split(" "))): r.f for r in frequent(frame(spark, docs), min_count=4).collect() if r.words}
    assert got == {k: a for k, a in f.items() if a >= 4}


def test_odd_rows(spark):
    long = "some words here again " * 30_000
    docs = [(None, None), ("en", ""), ("en", " .,; "), ("en", long), ("de", "a b a b a b a b a b a b a b a b a b a b a b")]
    given = frame(spark, docs * 2).selectExpr("*", "lang as phrase", "doc_id as a", "text as words")
    assert rows(collocations(given, chunk=10_000)) == brute(docs * 2)


def test_empty_table(spark):
    assert rows(collocations(frame(spark, []))) == []
    assert rows(collocations(frame(spark, [("en", None)]))) == []


def test_scores_beyond_64_bits(spark):
    """a = 3,000,000: a million times its square passes 64 bits."""
    docs = [("en", "a b . " * 100_000)] * 30
    assert rows(collocations(frame(spark, docs))) == [("en", 1, "a b", 3_000_000, 3_000_000, 3_000_000, 6_000_000, 1_000_000)]


@pytest.mark.parametrize("capacity", [1, 3, 20, 200])
def test_summaries_keep_what_is_frequent(capacity):
    rng = np.random.default_rng(capacity)
    keys = np.concatenate([rng.zipf(1.4, 5000) % 1000, np.full(900, 7)]).astype(np.uint32)
    rng.shuffle(keys)
    left, right = Summary(capacity), Summary(capacity)
    for k in range(0, len(keys), 100):
        (left if k % 200 else right).add(keys[k : k + 100], np.ones(len(keys[k : k + 100])))
    left.merge(right)
    kept, counts = left.counts()
    true = Counter(keys.tolist())
    assert len(kept) <= capacity
    assert left.taken <= len(keys) / (capacity + 1)
    estimate = dict(zip(kept.tolist(), counts.tolist(), strict=True))
    assert all(true[k] - left.taken <= estimate.get(k, 0) <= true[k] for k in true)
    for threshold in (50, 500):
        assert {k for k, c in true.items() if c >= threshold} <= set(left.at_least(threshold).tolist()) or left.taken >= threshold


def test_parts_end_with_a_piece():
    texts = ["a b c. d e f, g h i\nj k", "l m. n"]
    whole = [w for part in parts_of(texts, 1 << 20) for w in part]
    cut = list(parts_of(texts, 3))
    assert len(cut) > 3 and all(b"." in part for part in cut[:-1])
    assert [w for part in cut for w in part] == whole


def test_grams_are_told_apart_by_their_words():
    grams = Grams(b"a b a b . a b c".split(), "en", 3)
    assert [sorted((grams.phrase(i, n), c) for i, c in zip(at.tolist(), k.tolist(), strict=True)) for n, (at, k, _) in enumerate(grams.by_size, 1)] == [
        [(b"a", 3), (b"b", 3), (b"c", 1)],
        [(b"a b", 3), (b"b a", 1), (b"b c", 1)],
        [(b"a b a", 1), (b"a b c", 1), (b"b a b", 1)],
    ]
