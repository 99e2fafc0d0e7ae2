"""The corpus queries of the driver's contract, one for each operator, and the pipeline."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from . import ann, bayes_dedup, chat_views, curriculum, exact_dedup, genetic_packing, licences, quality, sharding, toxicity
from .common import table

SHARDS = [f"shard-{i:04d}" for i in range(256)]


def op1_quality_classifier(spark, sf_dir):
    return quality.weak_label_quality(table(spark, sf_dir, "documents"))


def op2_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.assign_shards(docs, ["doc_id"], SHARDS)


def op3_curriculum_mix(spark, sf_dir):
    mixed = curriculum.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))


def op4_hilbert_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), keep="max")


def op6_bayes_dedup(spark, sf_dir):
    return bayes_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_toxicity_chain(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_perspectives(spark, sf_dir):
    views = chat_views.perspectives(table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string")))
    return views.withColumn("mask", F.array_join(spans, ","))


def op9_licence_scan(spark, sf_dir):
    return licences.digest(licences.scan(table(spark, sf_dir, "documents")))


def op10_genetic_packing(spark, sf_dir):
    return genetic_packing.pack(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_sharding": op2_sharding,
    "op3_curriculum_mix": op3_curriculum_mix,
    "op4_hilbert_neighbours": op4_hilbert_neighbours,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_bayes_dedup": op6_bayes_dedup,
    "op7_toxicity_chain": op7_toxicity_chain,
    "op8_perspectives": op8_perspectives,
    "op9_licence_scan": op9_licence_scan,
    "op10_genetic_packing": op10_genetic_packing,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op2_sharding": sharding.oracle(SHARDS),
    "op3_curriculum_mix": curriculum.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op6_bayes_dedup": bayes_dedup.ORACLE,
    "op8_perspectives": chat_views.ORACLE,
    "op9_licence_scan": licences.oracle(),
}
