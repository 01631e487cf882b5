import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuration.llm import boosting
from murmuration.llm.common import held_out, is_held_out
from murmuration.llm.quality import fit_quality, keep_good, score_quality, statistics
from murmuration.llm.queries import QUERIES


def walk(trees, row):
    total = trees.base
    for f, t, v in zip(trees.feature, trees.threshold, trees.value, strict=True):
        node = 0
        for _ in range(trees.depth):
            node = 2 * node + (2 if row[f[node]] > t[node] else 1)
        total += v[node - len(f)]
    return 1 / (1 + np.exp(-total))


def test_trees_learn_an_interaction_and_walk_flat():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) != (x[:, 2] > -0.2)).astype(float)
    trees = boosting.fit(x[:2000], y[:2000], trees=30, depth=3)
    score = trees.score(x[2000:])
    assert ((score > 0.5) == y[2000:]).mean() > 0.97
    assert np.allclose(score[:20], [walk(trees, r) for r in x[2000:2020]])


@pytest.mark.parametrize("y", [[], [1.0, 1.0], [0.0]])
def test_without_both_classes_the_score_is_constant(y):
    trees = boosting.fit(np.zeros((len(y), 3)), np.array(y))
    assert np.allclose(trees.score(np.ones((2, 3))), (sum(y) + 1) / (len(y) + 2))


def test_statistics_are_finite_and_as_many():
    texts = [None, "", " ", "\n\n", "a", "é", "| | |", "word " * 40_000, "\x00\x01", "no-break\xa0space"]
    rows = np.array([statistics(t) for t in texts])
    assert np.isfinite(rows).all() and rows.shape[0] == len(texts)
    assert (rows[0] == rows[1]).all()


def test_fold_is_the_same_in_python_and_spark(spark):
    rows = spark.range(200).withColumnRenamed("id", "doc_id").select("doc_id", held_out().alias("h")).collect()
    assert [r.h for r in rows] == [is_held_out(r.doc_id) for r in rows]
    assert 20 < sum(r.h for r in rows) < 60
    assert spark.sql("select cast(null as bigint) as doc_id").select(held_out().alias("h")).first().h == is_held_out(None)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = QUERIES["op5_quality"](spark, folder).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.93
    assert all((r.predicted == 1) == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got)


def test_no_input_but_the_text(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_quality(docs, labels)
    turned = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = fit_quality(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None)), turned)
    assert all((a == b).all() for a, b in zip((model.feature, model.value), (again.feature, again.value), strict=True))


def test_null_empty_long_and_repeated(spark, make_docs):
    rows = [(1, None), (2, ""), (2, "x y"), (2, "x y"), (None, "a b c"), (3, "long " * 50_000)]
    docs = make_docs(rows).withColumn("y", F.lit("mine")).withColumn("score", F.lit(7))
    labels = spark.createDataFrame([(1, None), (2, 1), (3, 0), (3, 1), (None, 1)], "doc_id bigint, quality int")
    model = fit_quality(docs, labels)
    got = score_quality(docs, model).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "2", "2", "3", "None"]
    assert keep_good(docs, model, 0.0).columns == docs.columns and keep_good(docs, model, 0.0).count() == 6
    assert keep_good(docs, model, 1.1).count() == 0
    nothing = fit_quality(docs.limit(0), labels.limit(0))
    assert {r.score for r in score_quality(docs, nothing).collect()} == {0.5}
    assert score_quality(docs.limit(0), nothing).count() == 0


def test_a_labelled_id_that_many_rows_repeat_is_one_example(spark, make_docs):
    """A million rows of one id reach the driver as one."""
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id bigint, quality int, toxic int")
    docs = make_docs([(i, "good words in a row . " * (1 + i % 2)) for i in range(40)])
    hot = spark.range(1_000_000).selectExpr("cast(1 as bigint) as doc_id", "'zz' as text", "'en' as lang", "'s' as source", "2L as n_chars")
    once, many = fit_quality(docs.union(hot.limit(1)), labels), fit_quality(docs.union(hot), labels)
    x = np.array([statistics("good words"), statistics("zz")])
    assert (once.score(x) == many.score(x)).all()
