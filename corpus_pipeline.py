"""From raw documents to packed training sequences: four stages over what the one before has kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's documents. All but the last return the columns of `documents`.

1. quality rules: documents that fail the base rule or an adaptive fence go; thresholds come from these rows.
2. line dedup: repeated multi-line chunks are cut from the texts; n_chars follows the text. A text may become
   empty; its document stays.
3. n-gram Jaccard join: one document of each group of near duplicates stays, the one with the smallest id.
4. packing: the ids of each document in sequences of at most 1024 tokens.

Null texts and ids, empty tables and repeated rows have the results that the operators' docstrings state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom.llm.common import Stored, ship
from stackroom.llm.jaccard import keep_one
from stackroom.llm.linededup import dedup_lines
from stackroom.llm.packing import pieces
from stackroom.llm.quality import quality_filter


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    out = dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return keep_one(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return pieces(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates), ("packing", packing)]
#: Packing needs the tokenizer, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; a stage's table goes when the next one's is written, but for the last, which the result reads."""
    ship(spark)
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            now = Stored(docs, f"stage{k}")
            if held is not None:
                held.drop()
            docs, held = now.df, now
    return docs
