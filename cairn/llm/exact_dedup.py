"""Exact dedup through a persistent digest index that is bucketed and sorted by digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, Scratch, attach


def digest(text):
    """SHA-256 of the text without ASCII white space; a null text counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS, ""), 256)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, digest) of each row; n_chars counts the code points of the original text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.char_length(text).cast("long").alias("n_chars"), digest(F.col(text_col)).alias("digest"))


def _rank(n_chars, id_):
    """The smallest one stays: the longest original, then the smallest id, null last."""
    return F.struct((-n_chars).alias("less"), id_.isNull().alias("none"), id_.alias("id"))


class DigestIndex:
    """A table (digest, keep_id, n_chars, batch), bucketed and sorted by digest, to which batches of documents are added.

    A row says that the batch brought a text that no other batch had, or a longer original of it (or one as long with a smaller
    id), which takes over. A batch joins the table by sort-merge, without a shuffle or sort of the table itself, and only such
    rows are appended. A batch is known by its name: adding it again, after a failure or by mistake, adds what is missing and
    gives the same answer.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int = 64):
        self.spark, self.table, self.buckets = spark, table, buckets
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} (digest STRING, keep_id BIGINT, n_chars BIGINT, batch STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS")

    def read(self, but: str | None = None) -> DataFrame:
        """(digest, keep_id, n_chars): the best document of each text, of all batches but one."""
        rows = self.spark.table(self.table)
        rows = rows if but is None else rows.where(F.col("batch") != but)
        return rows.groupBy("digest").agg(F.min(_rank(F.col("n_chars"), F.col("keep_id"))).alias("best")).select("digest", F.col("best.id").alias("keep_id"), (-F.col("best.less")).alias("n_chars"))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def append(self, rows: DataFrame, batch: str) -> None:
        """rows: written (id, n_chars, digest) of a batch."""
        best = rows.groupBy("digest").agg(F.min(_rank(F.col("n_chars"), F.col("id"))).alias("best")).select("digest", F.col("best.id").alias("keep_id"), (-F.col("best.less")).alias("n_chars")).alias("b")
        known = self.read(but=batch).hint("merge").alias("k")
        as_good = _rank(F.col("k.n_chars"), F.col("k.keep_id")) <= _rank(F.col("b.n_chars"), F.col("b.keep_id"))
        fresh = best.join(known, (F.col("b.digest") == F.col("k.digest")) & as_good, "left_anti")
        there = self.spark.table(self.table).where(F.col("batch") == batch).select(F.col("digest").alias("there")).hint("merge")
        fresh = fresh.join(there, F.col("b.digest") == F.col("there"), "left_anti").select("digest", "keep_id", "n_chars", F.lit(batch).alias("batch"))
        # a written table between, as a table can't be appended to while it is read
        fresh = Scratch(self.spark, "digests").save(fresh, "fresh")
        # by the number of the bucket, so that each has one file, however many partitions there are
        fresh.repartition(self.buckets, F.pmod(F.hash("digest"), F.lit(self.buckets))).write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)

    def judge(self, rows: DataFrame, total: int) -> DataFrame:
        """(id, keep_id, group_size, kept, digest) for written (id, n_chars, digest), total in number, that were appended before.

        keep_id is the id of the best row of all batches so far, group_size counts the equal rows given here. kept: the row has the
        best one's id and length; rows that repeat both are all kept, as they can't be told apart.
        """
        scratch = Scratch(self.spark, "digests")
        groups = rows.groupBy("digest").agg(F.count("*").alias("n"))
        best = self.read().withColumnRenamed("n_chars", "most").hint("merge")
        groups = scratch.save(groups.join(best, "digest"), "groups")
        kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("most"))
        return attach(rows, groups, "digest", "n", total).select("id", "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), "digest")

    def add(self, docs: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Dedups a batch against itself and the index, appends what is new or takes over, and judges each row of the batch.

        Of equal texts the longest original stays, then the smallest id (null last). Rows of earlier batches that are taken over are
        found by judging them again. Null texts are empty ones, null ids stay null, other columns are not read, whatever their
        names. An empty batch gives no rows and leaves the index.
        """
        rows = Scratch(self.spark, "digests").save(digests(docs, id_col, text_col), "rows")
        self.append(rows, batch)
        return self.judge(rows, rows.count())


def dedup(docs: DataFrame, table: str, batches: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Judges all rows of docs, added to a new index in batches (by a hash of the id) that take over from one another. The index stays."""
    spark = docs.sparkSession
    index = DigestIndex(spark, table)
    rows = Scratch(spark, "digests").save(digests(docs, id_col, text_col), "rows")
    for k in range(batches):
        index.append(rows.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == k), str(k))
    return index.judge(rows, rows.count())
