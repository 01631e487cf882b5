from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuration.llm.mixing import MARGINALS, STEPS, fit_topics, mix, probabilities, profile, rake, sampled, target_shares
from murmuration.llm.multi_index import codes_of
from murmuration.llm.queries import QUERIES


def brute_rake(cells, shares, sweeps=500, tolerance=1e-3):
    """cells: {(source, lang, topic): tokens}; shares by marginal and category."""
    total = sum(cells.values())
    w = {c: t / total for c, t in cells.items()}

    def sums(k):
        out = defaultdict(float)
        for c, x in w.items():
            out[c[k]] += x
        return out

    for _ in range(sweeps):
        for k, name in enumerate(MARGINALS):
            s = sums(k)
            w = {c: x * (shares[name][c[k]] / s[c[k]] if s[c[k]] else 0) for c, x in w.items()}
        if all(
            abs(s - shares[name][g]) / max(shares[name][g], 1e-12) <= tolerance
            for k, name in enumerate(MARGINALS)
            for g, s in sums(k).items()
        ):
            break
    return w


def brute_probabilities(cells, w, budget):
    """By bisection."""
    wanted = budget * sum(cells.values())
    low, high = 0.0, 1e18
    for _ in range(400):
        c = (low + high) / 2
        if sum(t * min(1, c * w[k] / t) for k, t in cells.items()) < wanted:
            low = c
        else:
            high = c
    return {k: min(1, high * w[k] / t) for k, t in cells.items()}


def tempered(cells, temperature=0.7):
    out = {}
    for k, name in enumerate(MARGINALS):
        s = defaultdict(float)
        for c, t in cells.items():
            s[c[k]] += t
        p = {g: x**temperature for g, x in s.items()}
        out[name] = {g: x / sum(p.values()) for g, x in p.items()}
    return out


def cell_frame(spark, cells):
    return spark.createDataFrame([(*c, float(t)) for c, t in cells.items()], "source string, lang string, topic string, tokens double")


@pytest.fixture
def cells():
    rng = np.random.default_rng(0)
    return {
        (f"s{a}", f"l{b}", str(c)): int(rng.integers(1, 5000))
        for a in range(5)
        for b in range(3)
        for c in range(4)
        if rng.random() < 0.8
    }


@pytest.mark.parametrize("budget", [0.0, 0.1, 0.5, 0.97, 1.0])
def test_raking_and_calibration_equal_brute_force(spark, cells, budget):
    frame = cell_frame(spark, cells)
    shares = tempered(cells)
    frames = {m: target_shares(frame, m, {}, 0.7) for m in MARGINALS}
    for m in MARGINALS:
        assert {r[m]: r.share for r in frames[m].collect()} == pytest.approx(shares[m])
    raked, far = rake(frame, frames)
    assert far <= 1e-3
    w = {tuple(r[m] for m in MARGINALS): r.weight for r in raked.collect()}
    assert w == pytest.approx(brute_rake(cells, shares))
    for k, m in enumerate(MARGINALS):
        for g, share in shares[m].items():
            assert sum(x for c, x in w.items() if c[k] == g) == pytest.approx(share, rel=2e-3)
    p = {tuple(r[m] for m in MARGINALS): r.probability for r in probabilities(raked, budget).collect()}
    assert p == pytest.approx(brute_probabilities(cells, w, budget), abs=1e-9)
    assert sum(t * p[c] for c, t in cells.items()) == pytest.approx(budget * sum(cells.values()), abs=1e-3)


def test_given_targets(spark, cells):
    got = {r.lang: r.share for r in target_shares(cell_frame(spark, cells), "lang", {"l0": 0.5, "no": 0.1}, 1.0).collect()}
    sums = defaultdict(float)
    for c, t in cells.items():
        sums[c[1]] += t
    rest = sums["l1"] + sums["l2"]
    assert got == pytest.approx({"l0": 0.5, "l1": 0.5 * sums["l1"] / rest, "l2": 0.5 * sums["l2"] / rest})
    every = {r.lang: r.share for r in target_shares(cell_frame(spark, cells), "lang", {"l0": 2.0, "l1": 1, "l2": 1}, 1.0).collect()}
    assert every == pytest.approx({"l0": 0.5, "l1": 0.25, "l2": 0.25})


def test_query_equals_brute_force(spark, folder):
    rows = QUERIES["op10_mixing"](spark, folder).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    cells = defaultdict(int)
    for r in rows:
        assert r.n_tokens == max(1, len(docs[r.doc_id].text.encode().split()))
        assert (r.source, r.lang) == (docs[r.doc_id].source, docs[r.doc_id].lang)
        cells[r.source, r.lang, str(r.topic)] += r.n_tokens
    p = brute_probabilities(cells, brute_rake(cells, tempered(cells)), 0.5)
    for r in rows:
        assert r.probability == pytest.approx(p[r.source, r.lang, str(r.topic)], abs=1e-9)
    assert {r.deviation for r in rows} == {rows[0].deviation} and rows[0].deviation <= 1e-3
    kept = sum(r.n_tokens for r in rows if r.sampled)
    assert 0.35 < kept / sum(cells.values()) < 0.65
    assert len({r.topic for r in rows}) > 3


def test_null_empty_and_repeated(make_docs):
    texts = [None, "", "a b c " * 30_000, "d e f", "d e f", "g"]
    docs = make_docs([(k // 2 if k < 5 else None, t) for k, t in enumerate(texts)])
    docs = docs.withColumn("source", F.lit(None).cast("string")).withColumn("topic", F.lit("mine")).withColumn("tokens", F.lit(1))
    got = mix(docs).collect()
    assert len(got) == 6 and {r._topic for r in got if not r.text} == {-1}
    assert {r._tokens for r in got} == {1, 3, 90_000}
    assert sampled(docs, budget=1.0).count() == 6 and sampled(docs, budget=1.0).columns == docs.columns
    assert sampled(docs, budget=0.0).count() == 0
    assert mix(docs.limit(0)).count() == 0 and profile(None)[0] == 0
    for name in ("_topic", "_deviation"):
        with pytest.raises(ValueError, match=name):
            mix(docs.withColumn(name, F.lit(1)))


def test_shares_that_cannot_be_met_are_reported(spark):
    """One source speaks one language: its shares contradict each other."""
    cells = {("a", "x", "0"): 100, ("b", "y", "0"): 100, ("b", "x", "0"): 1}
    frame = cell_frame(spark, cells)
    frames = {m: target_shares(frame, m, {}, 0.7) for m in ("source", "topic")}
    frames["lang"] = target_shares(frame, "lang", {"x": 0.1, "y": 0.9}, 0.7)
    raked, far = rake(frame, frames)
    sums = defaultdict(float)
    for r in raked.collect():
        sums[r.source] += r.weight
        sums[r.lang] += r.weight
    want = {r.source: r.share for r in frames["source"].collect()} | {"x": 0.1, "y": 0.9}
    assert far > 0.1
    assert far == pytest.approx(max(abs(sums[g] - s) / s for g, s in want.items()), rel=1e-6)


def test_topics_come_from_all_texts(spark, make_docs):
    """A start from few rows ends where brute force over all rows does, for any partitioning."""
    rng = np.random.default_rng(1)
    kinds = ["apple pear plum fig", "iron lead tin zinc", "dog cat cow hen"]
    docs = make_docs([" ".join(rng.choice(kinds[k % 3].split(), 30)) for k in range(300)])
    one, many = (fit_topics(d, topics=3, fit_rows=20, rounds=30) for d in (docs.coalesce(1), docs.repartition(7)))
    assert (one == many).all()
    x = np.array([np.round(profile(r.text)[1] * STEPS) / STEPS for r in docs.collect()])
    at = codes_of(x, one)
    assert np.allclose(one, [x[at == k].mean(axis=0) for k in range(3)])
