"""Runnable queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contamination_report
from .hard_negatives import hard_negatives
from .html_text import extract_main_text
from .language import fit_language, identify
from .merkle import edit_report
from .mixing import mix_sources
from .ngram_join import ngram_jaccard_groups
from .oracle import DECONTAMINATION, HARD_NEGATIVES, MAIN_TEXT, MERKLE, MIXING, NGRAM_JOIN
from .periodic_runs import periodic_runs, repeat_tails, run_digests
from .quality import fit_quality, score_quality, text_shape
from .scratch import Scratch
from .suffix_tree import score_texts
from .token_store import read_tokens, write_tokens
from .toxicity import fit_toxicity, score_toxicity
from .wordpiece import token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(modulus: int):
    """Fold of a document: the CRC-32 of its id as text, by a modulus."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


@query("op1_ngram_jaccard_join", NGRAM_JOIN)
def op1(spark, sf_dir):
    return ngram_jaccard_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op2_merkle_fingerprints", MERKLE)
def op2(spark, sf_dir):
    return edit_report(table(spark, sf_dir, "documents"))


@query("op3_language_kernel")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit_language(docs.filter(fold(4) != 2).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


@query("op4_quality_additive")
def op4(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    shapes = Scratch(spark, "quality").keep(text_shape(table(spark, sf_dir, "documents")), "shapes")
    model = fit_quality(shapes.filter(fold(3) != 1), labels)
    return score_quality(shapes, model).select("doc_id", (fold(3) == 1).alias("held_out"), "score", "predicted")


@query("op5_toxicity_ftrl")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = fit_toxicity(docs.filter(fold(5) != 0), labels=labels)
    return score_toxicity(docs, model).select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


@query("op6_pfair_mixing", MIXING)
def op6(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("text")


@query("op7_token_store")
def op7(spark, sf_dir):
    import public_tokenizers

    root = Scratch(spark, "tokens").root
    write_tokens(table(spark, sf_dir, "documents"), root, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, root, with_ids=False)


@query("op10_spaced_seed_decontamination", DECONTAMINATION)
def op10(spark, sf_dir):
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_word_piece_counts")
def op8(spark, sf_dir):
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op9_suffix_tree_scores")
def op9(spark, sf_dir):
    return score_texts(table(spark, sf_dir, "documents"), fold(5) == 1)


@query("op11_hard_negatives", HARD_NEGATIVES)
def op11(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0, label)


@query("op12_html_main_text", MAIN_TEXT)
def op12(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", "n_chars")


@query("op13_periodic_runs")
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return run_digests(periodic_runs(repeat_tails(docs)))
