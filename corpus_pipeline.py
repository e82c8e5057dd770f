"""The corpus pipeline: every stage works on all that the one before it kept, written as Parquet and read again.

language ID -> quality rules -> one document of each near-duplicate component -> mix of the sources -> token ids.

Defined cases, in all stages: a null text, or one without letters, goes in the first; a null source is a source, and a host, of its own;
null ids are documents like others (near copies without any id are represented by the text whose SHA-256 comes first); repeated rows
count one by one until near_duplicates keeps one of them; ties go to the smaller id, or as the operators state; very long texts are read
whole; extra columns pass through whatever their names, up to token_ids; an empty table gives an empty one in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chatlake.llm.langid import well_identified
from chatlake.llm.mixing import mixed_documents
from chatlake.llm.ngramjoin import one_per_component
from chatlake.llm.pieces import encoded_texts
from chatlake.llm.quality import good_documents
from chatlake.llm.shared import written

WEIGHTS, SHARE = [3, 1, 2], 1.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return well_identified(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return good_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_per_component(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs, WEIGHTS, SHARE)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # fewer remembered words and pairs than op5, in smaller batches: the executors' heaps are as large as the stages before left them
    return written(encoded_texts(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True, most_words=50_000, most_pairs=100_000), "token-ids", mb=1)


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("mix", mix), ("token_ids", token_ids)]
#: SQL cannot express the first, third and last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
