import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import queries
from murmuration.llm.common import stored, table
from murmuration.llm.decontaminate import cut_passages, find_passages, keep_clean, report
from murmuration.llm.mixing import mix
from murmuration.llm.quality import fit_quality, score_quality
from murmuration.llm.simhash import keep_one
from test_jaccard import kept_ids
from test_token_output import expected


@pytest.fixture(scope="module")
def stages(spark, folder):
    docs, out = table(spark, folder, "documents"), {}
    out["input"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder), "test-stage")
        out[name] = docs
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_and_order(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name in names[:-1]:
        assert stages[name].columns == stages["input"].columns
    kept = [stages[n].count() for n in ["input", *names]]
    assert kept[0] > kept[1] > kept[2] >= kept[3] > kept[4] == kept[5] > 0
    # passages are cut out; only a document that is mostly benchmark goes as a whole
    before, after = ({r.doc_id: r.text for r in stages[n].collect()} for n in ("near_duplicates", "decontaminated"))
    assert any(before[k] != text for k, text in after.items()) and after.keys() <= before.keys()


def test_quality_keeps_what_scores(spark, folder, stages):
    docs = stages["input"]
    scores = score_quality(docs, fit_quality(docs, table(spark, folder, "labels")))
    assert ids(scores.filter("predicted = 1")) == ids(stages["quality"])


def test_one_of_each_group_stays(stages):
    """Brute force over all pairs by the Jaccard similarity of five-word shingles."""
    rows = stages["quality"].orderBy("doc_id").collect()
    assert ids(stages["near_duplicates"]) == kept_ids([r.text for r in rows], [r.doc_id for r in rows])


def brute_cut(text, items, window=10):
    """The text without covered words, and whether half of them are."""
    spans = [m.span() for m in WORD_RUN.finditer(text or "")]
    words = [(text[a:b]).translate(LOWER) for a, b in spans]
    hit = set()
    for item in items:
        size = min(window, len(item))
        windows = {tuple(item[k : k + size]) for k in range(len(item) - size + 1)} if item else set()
        for k in range(len(words) - size + 1 if windows else 0):
            if tuple(words[k : k + size]) in windows:
                hit |= set(range(k, k + size))
    out, at, k = [], 0, 0
    while k < len(words):
        if k in hit:
            out.append(text[at : spans[k][0]])
            while k + 1 < len(words) and k + 1 in hit:
                k += 1
            at = spans[k][1]
        k += 1
    return "".join([*out, (text or "")[at:]]), 2 * len(hit) <= len(words)


WORD_RUN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def item_words(rows):
    return [[w.translate(LOWER) for w in WORD_RUN.findall(r.text or "")] for r in rows]


def test_passages_are_cut_out(spark, folder, stages):
    items = item_words(table(spark, folder, "benchmark").collect())
    want = {}
    for r in stages["near_duplicates"].collect():
        text, stays = brute_cut(r.text, items)
        if stays:
            want[r.doc_id] = text, len(text) if text != r.text else r.n_chars
    got = {r.doc_id: (r.text, r.n_chars) for r in stages["decontaminated"].collect()}
    assert got == want
    found = report(find_passages(stages["decontaminated"], table(spark, folder, "benchmark")))
    assert found.filter("contaminated").count() == 0


@pytest.mark.parametrize("block_words", [200_000, 12])
def test_cutting_odd_rows(spark, make_docs, block_words):
    item = "one two three four five six seven eight nine ten"
    more = "a b c d e f g h i j k l"
    items = spark.createDataFrame([(1, item), (2, "short one"), (3, None), (4, more)], "item_id bigint, text string")
    words = item_words(items.collect())
    filler = " ".join(f"f{i}" for i in range(30))
    texts = [
        (1, f"{filler}. One, two three four five six seven eight nine TEN! {more}"), (2, f"x {item} y"), (3, None), (4, ""),
        (4, "one two"), (None, filler), (5, f"{filler} a short one"), (6, f"{filler} {more} and {item} {filler}"),
        (7, f"{filler} " * 3_000 + item),
    ]
    docs = make_docs(texts).withColumn("items", F.lit("mine"))
    got = cut_passages(docs, items, block_words=block_words)
    assert got.columns == docs.columns
    want = [(i, brute_cut(t, words)[0] if t is not None else None) for i, t in texts if brute_cut(t, words)[1]]
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, want))
    assert cut_passages(docs.limit(0), items).count() == 0
    assert cut_passages(docs, items.limit(0)).count() == docs.count()
    with pytest.raises(ValueError):
        cut_passages(docs.withColumn("_hits", F.lit(1)), items)


def test_sampling_follows_probabilities(stages):
    assert ids(mix(stages["decontaminated"]).filter("_sampled")) == ids(stages["mixed"])


def test_tokens_are_of_what_was_kept(stages):
    want = expected([(r.doc_id, r.text) for r in stages["mixed"].collect()])
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in stages["tokens"].collect()} == want


def test_run_is_the_stages(spark, folder, stages):
    assert sorted(map(tuple, queries()["pipeline"](spark, folder).collect())) == sorted(map(tuple, stages["tokens"].collect()))


def test_keep_one_of_odd_rows(make_docs):
    text = "one two three four five six seven"
    rows = [(9, text), (9, text), (9, "other words that stand alone here now"), (4, None), (2, ""), (None, text), (None, "x"), (None, "x")]
    docs = make_docs(rows).withColumn("code", F.lit("mine")).withColumn("root", F.lit(1))
    kept = keep_one(docs, words=5, radius=3)
    assert kept.columns == docs.columns
    assert sorted(((str(r.doc_id), r.text) for r in kept.collect()), key=str) == [
        ("2", ""),
        ("9", "one two three four five six seven"),
        ("9", "other words that stand alone here now"),
        ("None", "x"),
    ]
    assert keep_one(docs.limit(0)).count() == 0


def test_keep_clean_in_blocks(spark, make_docs):
    item = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([(1, item), (2, "short one"), (3, None)], "item_id bigint, text string")
    docs = make_docs([(1, f"x {item} y"), (2, "a short one"), (3, None), (4, "one two"), (4, "one two"), (None, "")])
    for words in (200_000, 3):
        kept = keep_clean(docs.withColumn("items", F.lit("mine")), items, block_words=words)
        assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "4", "None"]


def test_an_empty_corpus_and_odd_documents_run_through(spark, folder, tmp_path):
    """Nulls, empty and very long texts, repeated ids; then no document at all."""
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = [(None, None, None, None, None), (1, None, "en", "s", 0), (1, "", None, "s", 0), (1, "word " * 200_000, "xx", None, 9)]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() > 0
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_workers_give_memory_back(monkeypatch):
    """After the last batch of a task, whatever operator reads it."""
    import pyarrow as pa

    from murmuration.llm import common

    seen, batch = [], pa.RecordBatch.from_pydict({"x": list(range(7))})
    monkeypatch.setattr(common, "give_back", lambda: seen.append("back"))
    for piece in common.pieces(iter([batch]), 3):
        assert not seen
        assert piece.num_rows <= 3
    assert seen == ["back"]
    monkeypatch.undo()
    common.give_back()
