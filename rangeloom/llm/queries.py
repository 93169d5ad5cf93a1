"""The ``opN_<name>`` queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.llm import alignment, fill_middle, images, language, learned_partitions, mixing, packing, quality, simhash, substring, token_output, urls, vectors
from rangeloom.llm.sql import OP4_SQL, OP7_SQL, OP13_SQL, op8_sql
from rangeloom.operators.staging import scoped, scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document's token ids, read back from the files."""
    path = scratch_path(spark, "tokens")
    coded = token_output.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    token_output.write_tokens(coded, path)
    return token_output.token_digest(token_output.read_tokens(spark, path))


def op2_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    return scoped(lambda: simhash.simhash_groups(_table(spark, sf_dir, "documents")), "simhash")


def op3_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of edited copies among the pictures of all vectors, as no table has images."""
    return scoped(lambda: images.image_groups(images.vector_images(_table(spark, sf_dir, "embeddings"))), "images")


def op4_pstable_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and group of every vector."""
    return scoped(lambda: vectors.vector_groups(_table(spark, sf_dir, "embeddings")), "vectors")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in the packed sequences."""
    return scoped(lambda: packing.pack(_table(spark, sf_dir, "documents")), "packed")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = _table(spark, sf_dir, "documents")
    found = language.with_language(docs.select("doc_id", "text"), language.labelled_samples(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_weighted_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mixture takes."""
    docs = _table(spark, sf_dir, "documents")
    size = {"doc_id": F.col("doc_id"), "size": F.col("mix_size"), "source_size": F.col("mix_source_size"), "target": F.col("mix_target"), "taken": F.col("mix_size") * F.col("mix_times")}
    return scoped(lambda: mixing.mix(docs).select(*[v.alias(c) for c, v in size.items()]), "mix")


#: Fixed rules of the query.
URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def page_number() -> Column:
    """The number of the document that a page shows: the last segment of its ``path`` that is a number, with or without an ending such as ``.html``."""
    return F.regexp_extract("path", r"(?s).*/([0-9]{1,18})(?:\.[A-Za-z]+)?(?:/|$)", 1).try_cast("long")


def op8_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url; a page is labelled through the document whose number its path has."""
    bad = F.greatest(F.when(F.col("quality") == 0, 1).when(F.col("quality").isNotNull(), 0), F.col("toxic"))
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), bad.alias("bad"))
    return scoped(lambda: urls.judge_urls(_table(spark, sf_dir, "pages"), labels, URL_RULES, key=page_number()), "urls")


def op9_substring_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document without its repeated windows."""
    return scoped(lambda: substring.remove_repeats(_table(spark, sf_dir, "documents")).drop("text"), "repeats-removed")


def op10_empirical_bayes_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; its site is that of the page whose path has its number."""
    pages = _table(spark, sf_dir, "pages").select(urls.url_host("url").alias("host"), urls.url_path("url").alias("path"))
    sites = pages.select(page_number().alias("doc_id"), "host", F.get(F.split("path", "/"), F.lit(1)).alias("path"))
    return scoped(lambda: quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), sites), "quality")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers over every document."""
    return alignment.align_tokenizers(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return learned_partitions.nearest_by_partitions(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's transformed and restored text."""
    made = fill_middle.fill_middle(_table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text, 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fill_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every numbered query by name."""
    return {
        "op1_token_output": op1_token_output,
        "op2_simhash_pivots": op2_simhash_pivots,
        "op3_image_copies": op3_image_copies,
        "op4_pstable_vectors": op4_pstable_vectors,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_language_id": op6_language_id,
        "op7_weighted_fair_mix": op7_weighted_fair_mix,
        "op8_path_templates": op8_path_templates,
        "op9_substring_suffix_trees": op9_substring_suffix_trees,
        "op10_empirical_bayes_quality": op10_empirical_bayes_quality,
        "op11_token_alignment": op11_token_alignment,
        "op12_learned_partitions": op12_learned_partitions,
        "op13_fill_middle": op13_fill_middle,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return {"op4_pstable_vectors": OP4_SQL, "op7_weighted_fair_mix": OP7_SQL, "op8_path_templates": op8_sql(URL_RULES), "op13_fill_middle": OP13_SQL}
