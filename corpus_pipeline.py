"""Corpus pipeline: the stages that turn raw documents into packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.llm import language, mixing, packing, simhash, substring
from rangeloom.operators.names import fresh
from rangeloom.operators.staging import release, scoped


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fit a learned language by their bits per letter; gibberish, other languages and those without any letter go.

    Every document stays where nothing is labelled to learn from.
    """
    samples = language.labelled_samples(docs)
    lang, score, fits = fresh(docs.columns, "_lang", "_score", "_fits")
    found = language.with_language(docs, samples, lang_out=lang, score_out=score, fits_out=fits, usual=language.usual_bits(samples))
    return found.where(fits).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-equal fingerprints."""
    return simhash.one_of_each_group(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages that occur earlier; ``n_chars`` follows the text."""
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    kept = substring.remove_repeats(docs.select("doc_id", "text", row.alias("row")), keep=["row"])
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long"))}
    return kept.select(*[F.coalesce(new[c], F.col(f"row.c{i}")).alias(c) if c in new else F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece in the training sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]
#: No engine's SQL expresses the cross-parsing of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``, each written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        done = scoped(lambda step=step, docs=docs: step(spark, docs, sf_dir), name)
        release(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
