"""Five stages that turn ``documents`` into training data.

Each stage gets what the stage before has kept and passes on the columns of
``documents``; the last returns what the token files hold. In order:

quality         documents that the boosted trees reject go
near_duplicates of documents whose sets of five-word shingles overlap by 0.8 or
                more (Jaccard) one stays; SimHash fingerprints within 2 of 64
                bits and MinHash bands only say which ones to compare
decontaminated  passages of benchmark items that reach ten words are cut out;
                documents go of whose words such passages hold more than half
mixed           documents are sampled so that sources, languages and topics
                approach their tempered shares
tokens          ids in binary files, read back

Nulls, empty texts, repeated rows and other columns are treated as the operators
say. A stage of empty input has empty output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from murmuration.llm.common import stored, table
from murmuration.llm.decontaminate import cut_passages
from murmuration.llm.mixing import sampled
from murmuration.llm.quality import fit_quality, keep_good
from murmuration.llm.simhash import keep_one
from murmuration.llm.token_output import token_output

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
WORDS = 5
RADIUS = 2
PARTS = 4


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    return keep_good(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs.select(*COLUMNS), words=WORDS, radius=RADIUS, parts=PARTS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cut_passages(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sampled(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_output(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("mixed", mixed),
    ("tokens", tokens),
]

#: Classifier, clustering and tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
