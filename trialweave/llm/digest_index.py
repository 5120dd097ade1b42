"""Exact dedup against a persistent digest index, bucketed and sorted by digest.

The index is one parquet table.  A batch of documents is reduced to one row per digest before
anything is shuffled to the index; the rows that a sort-merge anti-join finds to be new are
appended, and so are the counts of those already known, in one commit.  As the batch is laid
out in the same buckets, neither the anti-join nor a look-up moves the index.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.llm.filters import shown_key, whole_key
from trialweave.sources.stages import shared_dir, stage

#: A digest of more than one row in so many is resolved without a shuffle; there are fewer of them than this.
HOT_SHARE = 1000


def text_digest(text: Column) -> Column:
    """SHA-256 of the text's UTF-8 bytes; a null text is an empty one."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


class DigestIndex:
    """``(digest, keep, n, fresh, batch)`` rows in ``buckets`` buckets, each file sorted by digest.

    ``folder`` must be one that all executors reach; an index found there is opened, with the
    number of buckets it was made with.  One writer at a time.  ``keep`` is the largest key
    of the batch's rows with the digest, a null key the smallest of all; ``fresh`` marks the
    row by which the digest entered the index.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.name = f"digest_index_{uuid.uuid4().hex}"
        made = self._made_with()
        # fewer buckets than shuffle partitions would be shuffled by the planner
        self.buckets = made or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not made:
            spark.range(1).select(F.lit(self.buckets).alias("buckets")).write.parquet(f"{self.folder}/layout")
        self._attach()

    def _made_with(self) -> int | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/layout/_SUCCESS")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.parquet(f"{self.folder}/layout").first()["buckets"]

    def _attach(self) -> None:
        self.spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep BIGINT, n BIGINT, fresh BOOLEAN, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/entries'"
        )

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def state(self) -> DataFrame:
        """``(digest, keep, n)`` over all batches, grouped inside the buckets."""
        return self.rows().groupBy("digest").agg(F.max("keep").alias("keep"), F.sum("n").alias("n"))

    def add(self, rows: DataFrame, batch: str) -> None:
        """Append the digests of ``(k, digest)`` rows; a batch that is there already is left alone.

        The append is one job with one commit, so a batch cut short is simply added again.
        """
        known = self.rows()
        if known.where(F.col("batch") == batch).limit(1).count():
            return
        groups = rows.groupBy("digest").agg(F.max("k").alias("keep"), F.count("*").alias("n"))
        groups = stage(groups, "digest-groups")
        seen = known.select("digest").hint("merge")
        fresh = groups.join(seen, "digest", "left_anti").withColumn("fresh", F.lit(True))
        again = groups.join(seen, "digest", "left_semi").withColumn("fresh", F.lit(False))
        both = fresh.unionAll(again).select("digest", "keep", "n", "fresh", F.lit(batch).alias("batch"))
        # the same hash as the buckets', so one file a bucket
        both.repartition(self.buckets, "digest").write.insertInto(self.name)

    def compact(self, folder: str) -> DigestIndex:
        """A new index with one sorted file a bucket and one row per digest."""
        new = DigestIndex(self.spark, folder, self.buckets)
        merged = self.state().select("digest", "keep", "n", F.lit(True).alias("fresh"), F.lit("compact").alias("batch"))
        merged.repartition(self.buckets, "digest").write.insertInto(new.name)
        return new

    def resolve(self, rows: DataFrame) -> DataFrame:
        """``rows`` with a digest, and the ``keep`` and ``n`` of the index for it.

        Digests of very many rows, ``HOT_SHARE`` at most, are matched where the rows are, so
        no task gets all copies of one text; the others are matched bucket by bucket.
        """
        state = self.state()
        total = rows.agg(F.count("*")).first()[0]
        hot = stage(state.where(F.col("n") * HOT_SHARE > total).orderBy(F.desc("n"), "digest").limit(HOT_SHARE), "hot-digests")
        hot = hot.select(F.col("digest").alias("hot_digest"), F.col("keep").alias("hot_keep"), F.col("n").alias("hot_n"))
        marked = rows.join(F.broadcast(hot), F.col("digest") == F.col("hot_digest"), "left")
        there = marked.where("hot_n is not null").select(*rows.columns, F.col("hot_keep").alias("keep"), F.col("hot_n").alias("n"))
        rest = marked.where("hot_n is null").select(*rows.columns).join(state.hint("merge"), "digest")
        return there.unionAll(rest.select(*rows.columns, "keep", "n"))


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, batch: str = "batch", text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, keep_id, group_size, kept, text_sha256)``, one row per row of ``docs``.

    Texts are equal when their bytes are; a null text is an empty one.  Of the rows with one
    text, in this batch and all others of the index, the one with the largest key stays and
    ``group_size`` counts them all.  A null key is the smallest and shown as null.  Rows that
    share both key and text are all kept or all dropped.  Texts are read once, for their
    digests.  Without an index a new one in the shared folder is filled.  The key is an
    integer; other columns don't matter; an empty table gives no rows.
    """
    spark = docs.sparkSession
    if index is None:
        index = DigestIndex(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/digest-index-{uuid.uuid4().hex}")
    rows = stage(docs.select(whole_key(F.col(key)).alias("k"), text_digest(F.col(text)).alias("digest")), "digests")
    index.add(rows, batch)
    found = index.resolve(rows)
    return found.select(
        shown_key(F.col("k")).alias(key),
        shown_key(F.col("keep")).alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("k") == F.col("keep")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, index: DigestIndex | None = None, batch: str = "batch", text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that stay: new texts of the largest key.

    Rows whose text an earlier batch has are dropped whatever their key, so that what was kept
    before need not be taken back.
    """
    spark = docs.sparkSession
    if index is None:
        index = DigestIndex(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/digest-index-{uuid.uuid4().hex}")
    rows = stage(docs.select(whole_key(F.col(key)).alias("k"), text_digest(F.col(text)).alias("digest")), "digests")
    index.add(rows, batch)
    fresh = index.rows().where((F.col("batch") == batch) & F.col("fresh")).select("digest", F.col("keep").alias("k"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), whole_key(F.col(key)).alias("k"), text_digest(F.col(text)).alias("digest"))
    kept = keyed.join(fresh.hint("merge"), ["digest", "k"], "left_semi")
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))
