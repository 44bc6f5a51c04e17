"""The corpus pipeline: quality classifier, exact dedup, n-gram Jaccard join, mixing of sources, packing.

Each stage takes what its predecessor kept. All but the last return the columns of documents; the last returns the pieces
of the packed documents. Null and empty texts, repeated rows and empty tables are as the operators' docstrings define them.
Stages that choose among documents choose rows: where ids are null or repeated, those rows are told apart and come after all
others. Further columns pass through, whatever their names, but those of a stage itself, which begin with two underscores.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import exact_dedup, jaccard_join, mixing, packing, quality
from cairn.llm.common import Scratch


def _keyed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with a unique number for each row, __row: the id, if no other row has it; else one behind all ids, fixed in a written table."""
    again = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias("__again"))
    if not again.limit(1).count():
        return docs.withColumn("__row", F.col("doc_id").cast("long"))
    scratch = Scratch(spark, "rows")
    again = scratch.save(again.where("__again is not null"), "again")
    last = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
    marked = docs.join(again, docs["doc_id"] == again["__again"], "left")
    odd = F.col("doc_id").isNull() | F.col("__again").isNotNull()
    return scratch.save(marked.withColumn("__row", F.when(odd, F.lit(last + 1) + F.monotonically_increasing_id()).otherwise(F.col("doc_id"))).drop("__again"), "keyed")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject (a score of 0.7 or more)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score(docs, quality.fit(docs, labels), "__quality").where("__quality >= 0.7").drop("__quality")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space: the longest, then the smallest id."""
    keyed = _keyed(spark, docs)
    index = exact_dedup.DigestIndex(spark, f"cairn_corpus_{uuid.uuid4().hex}")
    found = index.add(keyed, "corpus", id_col="__row")
    gone = Scratch(spark, "copies").save(found.where("not kept").select("id"), "gone")
    index.drop()
    return keyed.join(gone, keyed["__row"] == gone["id"], "left_anti").drop("__row")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles at a similarity of 0.8 or more connect: the smallest id."""
    keyed = _keyed(spark, docs)
    found = jaccard_join.jaccard_join(keyed, words=5, num=4, den=5, id_col="__row")
    gone = found.where("id <> component_id").select("id")
    return keyed.join(gone, keyed["__row"] == gone["id"], "left_anti").drop("__row")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    keyed = _keyed(spark, docs)
    copies = mixing.mix_sources(keyed, id_col="__row").where("copies > 0").select("id", "copies")
    taken = keyed.join(copies.withColumnsRenamed({"id": "__id", "copies": "__copies"}), F.col("__row") == F.col("__id"))
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__copies"))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, packed into sequences of 1024."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), kind="bytes", end_id=2, capacity=1024).withColumnRenamed("id", "doc_id")


STAGES = [("quality classifier", keep_good), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies), ("mixing sources", mix), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, f"stage{k}")
    return docs


#: The classifier and the tokenizer have no SQL; tests/llm/test_pipeline.py holds each stage and the whole against brute force.
ORACLE_SQL = None
