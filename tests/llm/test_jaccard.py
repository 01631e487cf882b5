import numpy as np
import pytest

import corpus_pipeline
from murmuration.llm import jaccard
from murmuration.llm.common import table
from murmuration.llm.quality import fit_quality, keep_good
from murmuration.llm.simhash import keep_one, shingle_hashes, tokens_of
from test_simhash import closure


def shingles(text, words=5):
    return set(shingle_hashes(tokens_of(text), words).tolist())


def kept_ids(texts, ids, similarity=0.8):
    """What brute force over all pairs leaves."""
    sets = [shingles(t) for t in texts]
    near = [
        (a, b)
        for a in range(len(sets))
        for b in range(a)
        if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])
    ]
    return sorted({ids[k] for k in closure(len(sets), near)})


def edited(rng, words, runs):
    """A copy with so many single words replaced."""
    out = list(words)
    for k in rng.choice(len(words), runs, replace=False):
        out[k] = f"new{rng.integers(10**9)}"
    return out


def corpus():
    """Near copies of similarity 0.75 to 0.97, short texts, and a large group."""
    rng, texts = np.random.default_rng(5), []
    for k in range(120):
        base = [f"w{rng.integers(10**6)}" for _ in range(200)]
        texts += [base, edited(rng, base, 1 + k % 6)]
    base = [f"w{rng.integers(10**6)}" for _ in range(150)]
    texts += [edited(rng, base, 1 + k % 5) for k in range(150)]
    texts += [[f"s{rng.integers(10**6)}" for _ in range(6)] for _ in range(60)]
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("block", [256, 16])
def test_keep_one_equals_brute_force_jaccard(make_docs, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = corpus()
    docs = make_docs(list(enumerate(texts)))
    got = sorted(r.doc_id for r in keep_one(docs, words=5, radius=6, parts=8).collect())
    assert got == kept_ids(texts, list(range(len(texts))))


def test_near_fingerprints_alone_do_not_link(make_docs):
    """Within 20 bits unrelated short texts meet; none may go."""
    texts = [" ".join(f"t{k}x{n}" for n in range(6)) for k in range(40)]
    kept = keep_one(make_docs(texts), words=5, radius=20, parts=21)
    assert kept.count() == len(texts)


def test_stage_equals_brute_force_jaccard(spark, folder):
    docs = table(spark, folder, "documents")
    docs = keep_good(docs, fit_quality(docs, table(spark, folder, "labels")))
    rows = docs.orderBy("doc_id").collect()
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, folder).collect())
    assert got == kept_ids([r.text for r in rows], [r.doc_id for r in rows])
