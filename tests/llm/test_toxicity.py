import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuration.llm import toxicity
from murmuration.llm.queries import QUERIES
from murmuration.llm.toxicity import FILTERS, WIDTHS, WORD, Network, buckets, calibrate, fit_toxicity, score_toxicity, train


def slow_pooled(net, text):
    words = WORD.findall((text or "").lower())
    vectors = [net.table[list(buckets(w))].sum(axis=0) for w in words]
    out = []
    for k, width in enumerate(WIDTHS):
        for f in range(FILTERS):
            all_ = [
                sum(vectors[i + j] @ net.filters[k][j][:, f] for j in range(width)) + net.bias[k * FILTERS + f]
                for i in range(len(words) - width + 1)
            ]
            out.append(max([0.0, *all_]))
    return out


@pytest.mark.parametrize("text", [None, "", "one", "one two", "A b c d? é one, TWO b a", "12 34 _"])
def test_pooling_equals_brute_force(text):
    net = toxicity._start(0.3, 2)
    net.bias += 0.05
    assert np.allclose(net.pooled(text), slow_pooled(net, text), atol=1e-5)


def test_whole_text_is_read(monkeypatch):
    monkeypatch.setattr(toxicity, "CACHED_WORDS", 30_000)
    net = toxicity._start(0.3, 2)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}q" for k in range(45_000)]
    parts = [net.pooled(" ".join(words[a : a + 20_100])) for a in (0, 20_000, 40_000)]
    assert np.allclose(net.pooled(" ".join(words)), np.max(parts, axis=0), atol=1e-5)


def test_training_finds_words_stems_and_pairs():
    rng = np.random.default_rng(0)
    plain = ["haus", "baum", "wald", "feld", "bach", "berg"]
    texts, y = [], []
    for k in range(600):
        words = list(rng.choice(plain, 30))
        bad = k % 3 == 0
        if bad:
            words[rng.integers(30)] = "schund" + str(rng.choice(["er", "lich", "keit", "ung"])) if k % 2 else "mist"
        texts.append(" ".join(words))
        y.append(float(bad))
    y = np.array(y)
    net = train(texts[:450], y[:450], epochs=8)
    assert ((net.score(texts[450:]) >= 0.5) == y[450:]).mean() > 0.97
    assert net.score(["haus schundhaft baum"])[0] > 0.5  # an ending never seen
    calibrate(net, texts[450:], y[450:], ["de"] * 100 + [None] * 50)
    assert set(net.thresholds) == {"de", ""}
    again = pickle.loads(pickle.dumps(net))
    assert np.allclose(again.score(texts[:9]), net.score(texts[:9]))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = QUERIES["op6_toxicity"](spark, folder).join(labels, "doc_id").filter("held_out").collect()
    toxic = [r for r in rows if r.toxic]
    assert np.mean([r.predicted for r in toxic]) > 0.85
    assert np.mean([r.predicted for r in rows if not r.toxic]) < 0.01
    assert all((r.predicted == 1) == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)


def test_null_empty_and_repeated(spark, make_docs):
    rows = [(1, None), (2, ""), (2, "x y"), (2, "x y"), (None, "a b c"), (3, "long " * 30_000)]
    docs = make_docs(rows).withColumn("y", F.lit("mine")).withColumn("flagged", F.lit(7))
    labels = spark.createDataFrame([(1, None), (2, 1), (3, 0), (None, 1)], "doc_id bigint, toxic int")
    got = score_toxicity(docs.withColumn("lang", F.lit(None).cast("string")), fit_toxicity(docs, labels, epochs=1)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "2", "2", "3", "None"]
    nothing = fit_toxicity(docs.limit(0), labels.limit(0))
    assert isinstance(nothing, Network) and len({r.score for r in score_toxicity(docs, nothing).collect()}) == 1
    assert score_toxicity(docs.limit(0), nothing).count() == 0


def test_training_is_bounded_by_ids_and_characters(spark, make_docs):
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(60)], "doc_id bigint, quality int, toxic int")
    docs = make_docs([(i, "vile words" if i % 2 else "kind words") for i in range(60)])
    hot = spark.range(300_000).selectExpr("cast(2 as bigint) as doc_id", "'kind words' as text", "'en' as lang", "'s' as source", "2L as n_chars")
    long = make_docs([(3, "vile " * 2_000)])
    texts = ["vile words", "kind words", "others"]
    once, many = (fit_toxicity(d, labels, epochs=2).score(texts) for d in (docs, docs.union(hot)))
    assert (once == many).all()
    docs = docs.filter("doc_id <> 3")
    without, beyond = (fit_toxicity(d, labels, max_chars=5_000, epochs=2).score(texts) for d in (docs, docs.union(long)))
    assert (without == beyond).all()


def test_every_labelled_document_is_learnt_from(spark, make_docs, monkeypatch):
    """A harmless word like a toxic one, which only some of thousands of documents
    hold, those late in the order of a hash; learnt in one block or in several."""
    ids = spark.range(6_000).filter("crc32(cast(id as string)) % 5 != 0").orderBy(F.xxhash64("id"))
    ids = [r.id for r in ids.collect()]
    toxic, clean = ids[:600], ids[600:]
    docs = [(i, "haus mist wald") for i in toxic] + [(i, "haus baum wald") for i in clean[:3_000]]
    docs = make_docs(docs + [(i, "haus mistel wald") for i in clean[3_000:]])
    labels = spark.createDataFrame([(i, 1) for i in toxic] + [(i, 0) for i in clean], "doc_id bigint, toxic int")
    for rows in (6_000, 1_500):
        monkeypatch.setattr(toxicity, "BLOCK_ROWS", rows)
        score = fit_toxicity(docs, labels).score(["haus mist wald", "haus mistel wald", "haus baum wald"])
        assert score[0] > 0.9 and score[1] < 0.1 and score[2] < 0.1


def test_blocks_do_not_depend_on_partitioning(spark, make_docs, monkeypatch, partitions):
    monkeypatch.setattr(toxicity, "BLOCK_ROWS", 10)
    monkeypatch.setattr(toxicity, "BLOCK_CHARS", 60)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int")
    docs = make_docs([(i, f"vile {chr(97 + i % 9)}words" if i % 2 else "kind words") for i in range(60)])
    nets = []
    for n in (2, 5):
        partitions(n)
        nets.append(fit_toxicity(docs.repartition(n), labels, epochs=2))
    assert (nets[0].table == nets[1].table).all() and (nets[0].out == nets[1].out).all()


def test_long_texts_are_pooled_in_parts():
    net = toxicity._start(0.3, 2)
    words = toxicity._Words()
    text = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}q" for k in range(45_000))
    words.add(text)
    best, _ = toxicity._Trainer(net)._pooled(words.docs[0], words.of_word())
    assert np.allclose(best, net.pooled(text), atol=1e-5)
