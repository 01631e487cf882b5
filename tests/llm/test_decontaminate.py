import hashlib
import random

import pytest
from pyspark.sql import functions as F

from murmuration.llm.automaton import SuffixAutomaton
from murmuration.llm.decontaminate import WORD, clean_texts, find_passages, report, words_of
from murmuration.llm.queries import QUERIES

ITEM = "one two three four five six seven eight nine ten eleven twelve"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        words = tokens(text)
        n = min(window, len(words))
        for k in range(len(words) - n + 1 if words else 0):
            windows.setdefault(tuple(words[k : k + n]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        words, hit, who = tokens(text), set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if found := windows.get(tuple(words[k : k + n])):
                    who |= found
                    hit.update(range(k, k + n))
        digest = hashlib.sha256(",".join(sorted(map(str, who))).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(who), digest, bool(hit)))
    return sorted(out, key=str)


def got(df):
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


@pytest.fixture
def make_items(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id bigint, text string")


def test_words_by_bytes_and_by_pattern():
    for text in (None, "", "Don't É-x 12_3\x00É|ß~\x7fq  a.b"):
        assert [w.decode() for w in words_of(text)] == tokens(text)


def test_automaton_equals_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        sequences = [[rng.randrange(3) for _ in range(rng.randrange(12))] for _ in range(4)]
        machine = SuffixAutomaton()
        for s in sequences:
            machine.add(s)
        text = [rng.randrange(4) for _ in range(40)]
        known = {tuple(s[a:b]) for s in sequences for a in range(len(s)) for b in range(a, len(s) + 1)}
        want = [max(n for n in range(k + 1) if n == 0 or tuple(text[k - n : k]) in known) for k in range(1, 41)]
        assert machine.matching(text) == want


DOCS = [
    (1, f"Before. {ITEM.upper()}! After"),
    (2, "one two three four five six seven eight nine"),
    (3, "x " + " ".join(ITEM.split()[1:11]) + " y " + " ".join(ITEM.split()[2:12])),
    (4, "a short item here"),
    (4, "a short, short item"),
    (5, None),
    (6, ""),
    (None, ITEM),
    (7, "kurz straße ünd"),
    (8, "one " * 3000 + ITEM + " six" * 3000),
    (9, "same words twice over and then again to fill ten"),
]
ITEMS = [(10, ITEM), (9, "Short item!"), (11, None), (12, "..."), (13, "STRAßE ünd"), (14, ITEM), (15, "one one one " * 8), (16, "fill ten")]


@pytest.mark.parametrize("block_words", [200_000, 5])
def test_equals_brute_force(make_docs, make_items, block_words):
    docs = make_docs([*DOCS, DOCS[0]]).withColumn("starts", F.lit("mine"))
    items = make_items(ITEMS).withColumn("extra", F.lit(1))
    found = find_passages(docs, items, block_words=block_words)
    assert got(report(found)) == brute([*DOCS, DOCS[0]], ITEMS)


def test_empty_tables(make_docs, make_items):
    assert report(find_passages(make_docs(DOCS).limit(0), make_items(ITEMS))).count() == 0
    assert got(report(find_passages(make_docs(DOCS), make_items([])))) == brute(DOCS, [])


def test_query_equals_brute_force(spark, folder):
    docs, items = (
        [tuple(r) for r in spark.read.parquet(f"{folder}/{t}.parquet").select(i, "text").collect()]
        for t, i in (("documents", "doc_id"), ("benchmark", "item_id"))
    )
    want = brute(docs, items)
    assert got(QUERIES["op7_decontaminate"](spark, folder)) == want
    assert any(r[-1] for r in want)


def test_spans_go_and_covered_documents_go(make_docs, make_items):
    rows = [(1, f"Keep this: {ITEM}. And this, {'w ' * 20}"), (2, ITEM + " so"), (3, "clean"), (4, None)]
    found = find_passages(make_docs(rows), make_items([(1, ITEM)]))
    texts = {r.doc_id: r.text for r in clean_texts(found).collect()}
    assert texts == {1: f"Keep this: . And this, {'w ' * 20}", 3: "clean", 4: ""}
    texts = {r.doc_id: r.text for r in clean_texts(found, min_words=13, max_coverage=1.0).collect()}
    assert texts == {1: rows[0][1], 2: rows[1][1], 3: "clean", 4: ""}
