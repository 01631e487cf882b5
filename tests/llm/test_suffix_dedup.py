import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuration.llm import suffix_dedup
from murmuration.llm.queries import QUERIES
from murmuration.llm.suffix_dedup import Anchors, remove_repeats
from murmuration.llm.suffix_sort import Strings, merge_sort, sorted_common


def brute(rows, window):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k : k + window] for _, t in texts for k in range(len(t) - window + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, np.int64)
        for k in range(len(t) - window + 1):
            if seen[t[k : k + window]] > 1:
                gone[k : k + window] = 1
        keep = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        runs = int((np.diff(np.concatenate(([0], gone))) == 1).sum())
        out.append((i, len(t), int(gone.sum()), runs, keep))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect()), key=str)


@pytest.mark.parametrize("n,size", [(0, 5), (1, 5), (9, 4), (300, 6), (2000, 40)])
def test_sort_equals_python(n, size):
    rng = np.random.default_rng(n)
    rows, sizes = rng.integers(97, 99, (n, size)).astype(np.uint8), rng.integers(0, size + 1, n)
    rows[np.arange(size)[None, :] >= sizes[:, None]] = 0
    group = np.sort(rng.integers(0, max(1, n // 20), n))
    strings = Strings(rows, sizes)
    keys = [(g, r[:s].tobytes()) for g, r, s in zip(group, rows, sizes, strict=True)]
    assert [keys[k] for k in merge_sort(strings, group)] == sorted(keys)
    order, common = sorted_common(strings, group)
    assert [keys[k] for k in order] == sorted(keys)
    for k in range(1, n):
        a, b = keys[order[k - 1]], keys[order[k]]
        shared = next((x for x in range(len(a[1])) if a[1][: x + 1] != b[1][: x + 1]), len(a[1]))
        assert common[k] == (shared if a[0] == b[0] else -1)


def test_colliding_hashes_are_noticed(monkeypatch):
    rng = np.random.default_rng(1)
    rows = rng.integers(97, 100, (200, 8)).astype(np.uint8)
    strings = Strings(rows, np.full(200, 8))
    strings.prefix[:] = 7  # everything collides
    order, _ = sorted_common(strings, np.zeros(200, np.int64))
    assert [rows[k].tobytes() for k in order] == sorted(r.tobytes() for r in rows)


def test_every_window_has_one_anchor():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"abc") for _ in range(n)) for n in (0, 3, 19, 20, 21, 500)] + [b"xy" * 60]
    a = Anchors(texts, 20, 6)
    for t, text in enumerate(texts):
        own = [(x - a.starts[t], y - a.starts[t], z - a.starts[t]) for x, y, z, w in zip(a.low, a.high, a.at, a.text, strict=True) if w == t]
        assert [k for x, y, _ in own for k in range(x, y + 1)] == list(range(max(0, len(text) - 19)))
        assert all(y <= z and z + 6 <= x + 20 for x, y, z in own)


def planted(seed, n, window):
    """Few letters, passages shared with other surroundings, copies, near copies."""
    rng = random.Random(seed)

    def noise(k):
        return "".join(rng.choice("abcdefgh é") for _ in range(k))

    passages = [noise(k) for k in (window - 3, window, window + 1, 3 * window)]
    texts = []
    for k in range(n):
        kind = k % 5
        if kind == 0:
            texts.append(noise(rng.randrange(4 * window)))
        elif kind == 1:
            texts.append(noise(rng.randrange(window)) + rng.choice(passages) + noise(rng.randrange(window)))
        elif kind == 2:
            texts.append(texts[rng.randrange(len(texts))])
        elif kind == 3:
            t = texts[rng.randrange(len(texts))]
            at = rng.randrange(len(t) + 1)
            texts.append(t[:at] + "Q" + t[at + 1 :])
        else:
            texts.append(noise(3) * rng.randrange(window))
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,hot", [(1, 5000), (2, 5000), (3, 2)])
def test_equals_brute_force(make_docs, seed, hot):
    rows = planted(seed, 60, 40)
    docs = make_docs(rows).withColumn("digest", F.lit("mine")).withColumn("first", F.lit(1))
    assert got(remove_repeats(docs, window=40, gram=12, hot=hot)) == brute(rows, 40)


def test_small_chunks_of_contexts(make_docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CELLS", 100)
    rows = planted(4, 40, 30)
    assert got(remove_repeats(make_docs(rows), window=30, gram=8)) == brute(rows, 30)


def test_null_empty_repeated_and_long(make_docs):
    long = "".join(random.Random(9).choice("abcdefghijklm ") for _ in range(3000))
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, long[100:320]), (None, "é" * 150), (4, "x" * 199), (5, "y" * 201)]
    assert got(remove_repeats(make_docs(rows))) == brute(rows, 200)
    assert remove_repeats(make_docs(rows).limit(0)).count() == 0


def test_query_equals_brute_force(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((i, n, g, s, hashlib.sha256(k).hexdigest()) for i, n, g, s, k in brute(rows, 200))
    result = QUERIES["op9_suffix_dedup"](spark, folder).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in result) == want
    assert any(r[2] for r in want)
