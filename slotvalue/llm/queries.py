"""Registered queries of the operators for training data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotvalue.llm import ann, chunks, decontam, langid, lines, mixing, neardup, negatives, pii, runs, toxicity, urls, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_cross_polytope_ann(spark, sf_dir):
    return ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op2_url_reputation(spark, sf_dir):
    """A labelled page is bad if it is marked toxic or of low quality; labels share the page's id."""
    bad = F.greatest((F.col("toxic") == 1).cast("int"), (F.col("quality") == 0).cast("int"))
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return urls.judge_urls(table(spark, sf_dir, "pages"), outcomes)


@query
def op3_decontamination(spark, sf_dir):
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_line_dedup(spark, sf_dir):
    return lines.line_digests(table(spark, sf_dir, "documents"))


@query
def op5_jaccard_join(spark, sf_dir):
    return neardup.document_classes(table(spark, sf_dir, "documents"))


@query
def op6_language_fusion(spark, sf_dir):
    model = langid.fit_text(table(spark, sf_dir, "documents"))
    return langid.identify(table(spark, sf_dir, "pages"), model)


@query
def op7_source_mixing(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query
def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query
def op9_warc_roundtrip(spark, sf_dir):
    return warc.archive_listing(table(spark, sf_dir, "pages"))


@query
def op10_content_chunks(spark, sf_dir):
    return chunks.span_report(table(spark, sf_dir, "documents"))


@query
def op11_personal_data(spark, sf_dir):
    return pii.span_digests(table(spark, sf_dir, "documents"))


@query
def op12_periodic_runs(spark, sf_dir):
    """A tenth of the documents repeat a stretch of their own words (``with_planted_runs``)."""
    return runs.run_digests(table(spark, sf_dir, "documents"), text=runs.with_planted_runs())


@query
def op13_hard_negatives(spark, sf_dir):
    """Vectors in steps of 1/256; ids divisible by 7 get the next label, ids divisible by 50 are anchors."""
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        negatives.scaled_floor("embedding", 256).alias("vector"),
    )
    return negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0)
