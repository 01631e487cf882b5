import math
import re
from collections import Counter

import numpy as np
import pytest

from murmuration.llm.fp_tree import Best, DocumentTree, parts
from murmuration.llm.lexical_search import item_blocks, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEM_SCHEMA = "item_id bigint, text string"


def terms(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    """Every document against every item, by the formula."""
    own = [(i, Counter(t)) for i, t in ((i, terms(t)) for i, t in docs) if t]
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c in own:
            m = 25 + 75 * sum(c.values()) * n // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in terms(text) if t in c
            )
            if score > 0:
                found.append((-score, doc is not None, doc or 0, doc))
        out.extend((item, r, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k], 1))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(seed, n, words=60):
    rng = np.random.default_rng(seed)
    names = [f"w{i}" for i in range(words)] + ["Élan", "ß9", "THE"]
    return [(i, " ".join(rng.choice(names, rng.integers(0, 40), p=None).tolist())) for i in range(n)]


@pytest.fixture
def make_items(spark):
    return lambda texts: spark.createDataFrame(list(enumerate(texts)), ITEM_SCHEMA)


@pytest.mark.parametrize("limits", [{}, {"tree_docs": 7}, {"tree_entries": 50}, {"block_terms": 5}, {"k": 3}])
def test_equals_scores_of_all_pairs(spark, make_docs, make_items, limits):
    docs = [*corpus(1, 120), (500, "w1 w2 W3"), (501, "w1 w2 W3"), (499, "w1 w2 W3"), (502, "w1-w2.w3 w1")]
    items = ["w1 w2 w3", "The élan Élan w59 w1 w1", "nothing here", "", None, "ß9 ß9", "w1 w2 w3"]
    got = rows(search(make_docs(docs).repartition(3), make_items(items), **limits))
    assert got == brute(docs, list(enumerate(items)), limits.get("k", 10))


def test_odd_rows(spark, make_docs, make_items):
    docs = [(None, "a b"), (None, "a b"), (3, "a b"), (3, "a b"), (4, None), (5, ""), (6, " .,; "), (-7, "a " * 50_000 + "b")]
    items = ["a", "b a", "c"]
    many = make_docs(docs).selectExpr("*", "doc_id * 2 as item_id", "text as rank", "n_chars as score")
    assert rows(search(many, make_items(items))) == brute(docs, list(enumerate(items)))


def test_repeated_items_are_items_of_their_own(spark, make_docs):
    docs = [(i, "a b c") for i in range(4)]
    items = spark.createDataFrame([(None, "a"), (1, "a"), (1, "b")], ITEM_SCHEMA)
    assert len(rows(search(make_docs(docs), items))) == 12


def test_empty_tables(spark, make_docs, make_items):
    assert rows(search(make_docs([]), make_items(["a"]))) == []
    assert rows(search(make_docs([(1, "a")]), make_items([]))) == []
    assert rows(search(make_docs([(1, None)]), make_items(["a"]))) == []


def test_string_ids_of_items(spark, make_docs):
    items = spark.createDataFrame([("x", "a")], "item_id string, text string")
    assert rows(search(make_docs([(1, "a"), (2, "b")]), items))[0][:3] == ("x", 1, 1)


def test_blocks_hold_every_item_once(make_items):
    items = make_items([f"a{i} b{i} c" for i in range(50)])
    blocks = list(item_blocks(items, block_terms=10))
    assert sorted(n for b in blocks for n in b.numbers) == list(range(50))
    assert all(len(b.terms) <= 10 for b in blocks)


def tree_of(vectors, m, n_terms, leaf=4):
    first = np.concatenate(([0], np.cumsum([len(v) for v in vectors])))
    flat = [x for v in vectors for x in sorted(v)]
    terms_, tf = (np.array([x[i] for x in flat], np.int64) for i in (0, 1))
    return DocumentTree(first, terms_, tf, np.array(m), np.arange(len(vectors)), n_terms, leaf)


def test_tree_finds_the_best_and_leaves_most_documents_out():
    rng = np.random.default_rng(4)
    n, n_terms = 4000, 200
    odds = 0.9 / (1 + np.arange(n_terms)) ** 0.7
    vectors = [[(int(t), int(rng.integers(1, 5))) for t in np.flatnonzero(rng.random(n_terms) < odds)] for _ in range(n)]
    m = rng.integers(25, 300, n)
    tree = tree_of(vectors, m, n_terms)
    dense = np.zeros((n, n_terms), np.int64)
    for i, v in enumerate(vectors):
        for t, f in v:
            dense[i, t] = f
    seen = 0
    for _ in range(20):
        asked = np.sort(rng.choice(n_terms, 8, replace=False))
        weights = (3000 / (200 * odds[asked])).astype(np.int64)
        best = Best(10)
        seen += tree.search(asked, weights, best)
        scores = parts(weights, dense[:, asked], m)
        want = sorted(zip((-scores).tolist(), range(n), strict=True))[:10]
        assert best.rows == [w for w in want if w[0] < 0]
    assert seen < 20 * n / 2


def test_bounds_hold_for_every_document_below():
    rng = np.random.default_rng(5)
    vectors = [[(int(t), int(rng.integers(1, 9))) for t in np.flatnonzero(rng.random(12) < 0.4)] for _ in range(300)]
    m = rng.integers(25, 90, 300)
    tree = tree_of(vectors, m, 12)
    asked, weights = np.arange(12), rng.integers(1, 50, 12)
    for k in range(len(tree.low)):
        low, high = int(tree.low[k]), int(tree.high[k])
        bound = parts(weights, tree.most[k : k + 1, asked], tree.least_m[k : k + 1])[0]
        assert (tree._scores(low, high, asked, weights) <= bound).all()
    leaves = [k for k in range(len(tree.low)) if not tree.n_kids[k]]
    assert sorted((int(tree.low[k]), int(tree.high[k])) for k in leaves)[-1][1] == 300
    assert sum(int(tree.high[k] - tree.low[k]) for k in leaves) == 300
