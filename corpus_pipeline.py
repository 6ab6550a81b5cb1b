"""A corpus from raw documents: language, quality, near duplicates, mixture, pieces.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept;
all but the last return the columns of documents. run() applies them to documents and
writes each stage's rows as Parquet in the shared folder, so a later stage never computes
an earlier one again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolo.llm._sample import labelled
from tremolo.llm._store import checkpoint_dir
from tremolo.llm.jaccard_join import keep_one_of_each
from tremolo.llm.language_id import keep_identified, learn
from tremolo.llm.mixing import emit, mix
from tremolo.llm.quality_nbsvm import PER_LABEL, fit, keep_good
from tremolo.llm.sampled_pieces import sample_encodings

#: A language given with less than this is no language.
LEAST_LANGUAGE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, and those whose language isn't clear."""
    return keep_identified(docs, learn(docs), LEAST_LANGUAGE)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the quality classifier puts under its threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_good(docs, fit([r[1:] for r in labelled(docs, labels, "quality", PER_LABEL)]))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by five-word shingles at 0.8 or more, the smallest id stays.

    Rows without words all stay, null ids come last in a group, rows alike in every column are one.
    """
    return keep_one_of_each(docs, n=5, num=80, den=100)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy it takes; files in order of their names are in order of shards."""
    return emit(mix(docs, carry=True)).select(docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled encodings of each row, and their digest."""
    e = sample_encodings(docs, k=2)
    return e.select("doc_id", "sample", F.size("ids").cast("long").alias("n_pieces"), "ids", F.xxhash64("ids").alias("ids_hash"), "log_prob", "log_inclusion", "round_trip")


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("pieces", pieces),
]

#: The fitted models of two stages, and the sampled pieces, can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
