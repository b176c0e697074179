"""A training corpus from the documents table, in five stages that each call an operator of tessera.llm.

Each stage takes (spark, docs, sf_dir), works on all rows of the stage before, and returns the columns of
documents; the last adds n_tokens, ids and decoded. n_chars follows the text. Other columns of docs go, also those
that have the name of one that a stage makes. An empty table gives an empty one. Texts are looked at whole,
however long. A null doc_id, lang, source or n_chars changes nothing but where a stage says so.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, lines, quality, setjoin
from tessera.llm.tables import Tables, small_enough

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go.

    A null or empty text has too few words and goes. Equal rows are judged alike, each on its own; a document that is
    labelled twice is learned from twice, null labels aren't.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.judge(docs, labels).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat one of another place go, and with them a document of which no line with words is left.

    Of equal lines the one of the lowest (doc_id, line) stays. Rows with one doc_id are one document and don't repeat
    each other line by line; rows without one, or without a text, stay as they are.
    """
    left = lines.dedup(docs).where("n_removed = 0 or n_removed < n_lines")
    return _measured(left, F.col("n_removed") > 0)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose sets of five-word shingles are linked at a similarity of 0.8, the one with the lowest id stays.

    Rows with one doc_id stay or go together, rows without one stay, and so do texts without words, null ones too.
    """
    linked = setjoin.linked(docs, n=5, percent=80)
    copies = Tables(spark).keep(linked.where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(small_enough(copies), "doc_id", "left_anti").select(*COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that share ten words in a row with a benchmark item are cut out; a document with no word left goes.

    Rows are looked at one by one. A document that had no word to begin with stays; null text stays null. Items without an
    id or a text aren't looked for; items that are there twice count once.
    """
    found = decontaminate.cut(decontaminate.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    words = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return _measured(found.where((F.size("hit_spans") == 0) | (F.col("n_words") > words)), F.size("hit_spans") > 0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text and the text that they decode to; a null text has none, and decodes to an empty one. Rows are looked at one by one."""
    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), outputs=("n_tokens", "ids", "decoded"))


def _measured(docs: DataFrame, changed: Column) -> DataFrame:
    return docs.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("BPE encoding and decoding", tokens),
]

#: SQL can't express the learned rules, the banding or the merges; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again as the next one's documents."""
    tables = Tables(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = tables.keep(stage(spark, docs, sf_dir))
    return docs
