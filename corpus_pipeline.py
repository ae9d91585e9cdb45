"""Corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the
next one's docs; all but the last return the columns of documents. Labels come from the tables in sf_dir.
Mixing aims at 88 % of the tokens in good documents with a budget of 1.3 times what there is and no rate under one:
no document that the filters kept is lost, good ones come more than once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import materialize, table
from logloom.llm.lines import dedup_lines
from logloom.llm.mixing import domain_labels, resample
from logloom.llm.nearcopies import keep_one_near_copy
from logloom.llm.packing import pack_documents
from logloom.llm.quality import filter_documents
from logloom.llm.queries import tokenizer_path

MIX = {"good": 0.88, "poor": 0.04, "toxic": 0.08}
BUDGET, LEAST_RATE = 1.3, 1.0
#: A repeated line of more words is deleted without a repeated neighbour.
SINGLE_WORDS = 50


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_documents(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs, min_lines=2, single_words=SINGLE_WORDS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_near_copy(docs, least=0.8, shingle=5)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return resample(docs, domain_labels(table(spark, sf_dir, "labels")), MIX, BUDGET, LEAST_RATE)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer_path(), window=2048)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Packing and mixing aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", F.col("n_chars"))
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
