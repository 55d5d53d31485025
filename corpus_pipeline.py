"""From documents to token files: keep known languages, one of each group of near copies, no benchmark text; mix; encode.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the next one's
``docs``. The mixture is an order of rows: its stage writes files in that order, and the last stage numbers tokens by the
place of a row in the files that it reads.

Edge cases: those of each operator. A null id or source, an empty text and further columns pass through until the language stage,
which rejects texts without a letter. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanframe.llm.decontaminate import without_benchmark
from cleanframe.llm.language import fit_language, known_language
from cleanframe.llm.mixing import mix_sources
from cleanframe.llm.ngram_join import one_of_each_group
from cleanframe.llm.scratch import Scratch, writing
from cleanframe.llm.token_store import read_tokens, write_tokens

TOKENIZER = "byte_bpe_50k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts like no language in ``lang``."""
    return known_language(docs, fit_language(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group."""
    return one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their sources interleaved: the files' names and the rows in them are in the order of the mixture."""
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["mix_slot", "mix_offset"]
    return mix_sources(docs).repartitionByRange(files, *order).sortWithinPartitions(*order).select(*docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token files in the order in which ``docs`` lies in its files, else of the ids, and reads them back.

    Returns doc_id, start, n_tokens and ids_crc32, as the token files have them.
    """
    try:
        number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1)
        placed = docs.select("doc_id", "text", F.coalesce(number.try_cast("bigint"), F.lit(0)).alias("file_place"), F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.row_index").alias("row_place"))
        order = ("file_place", "file_name", "row_place")
    except AnalysisException:  # not read from files
        placed, order = docs, ("doc_id",)
    root = Scratch(spark, "token-files").root
    write_tokens(placed, root, public_tokenizers.path(TOKENIZER), order=order)
    return read_tokens(spark, root, with_ids=False)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_files", token_files),
]

#: The language model and the tokenizer cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with writing(spark):
            stage(spark, docs, sf_dir).write.parquet(scratch.path(name))
        docs = spark.read.parquet(scratch.path(name))
    return docs
