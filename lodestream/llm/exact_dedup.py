"""Exact deduplication over a persistent digest index (DataFrame operations only).

The index is a table bucketed and sorted by the SHA-256 of the text. A batch is reduced to
one row per digest (hash aggregation before the shuffle), compared with the index by a
sort-merge anti-join that needs no exchange on the index side, and what is new is appended.
The number of buckets follows from the data and is kept with the table. While a bucket is one
file, the join takes its order as it is; appended batches give a bucket more files, and
:meth:`DigestIndex.compact` makes them one again.

Defined results: a null text counts as the empty text; of equal texts the row with the
largest id stays, and of rows that also repeat the id exactly one stays; a null id sorts
below every other; an empty table gives an empty result; other columns are never read, and
may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import whole_text, written

INDEX_SCHEMA = "digest binary, keep_id bigint, keep_row bigint, batch int"
#: Digests in a bucket that the bucket count is chosen for: about 100 MB.
BUCKET_ROWS = 2_000_000
#: Files of a bucket from which a batch's end compacts the index.
MOST_FILES = 8
#: Makes a scan of a bucketed table keep the order of buckets that are one file each.
KEEP_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"
BEFORE_ALL = -(1 << 63)


class DigestIndex:
    """Digests of all texts seen so far, in the table ``name``.

    ``buckets`` counts for a new table only; without it, the first batch decides: one bucket for
    ``BUCKET_ROWS`` digests, and as many as the session's shuffle partitions at least.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        self.spark, self.name = spark, name
        self.buckets = self._stored_buckets() or buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def _stored_buckets(self) -> int | None:
        if not self.exists():
            return None
        told = {r.col_name: r.data_type for r in self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name}").collect()}
        return int(told["Num Buckets"])

    def _for_rows(self, n: int) -> int:
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BUCKET_ROWS))

    def _write(self, rows: DataFrame, name: str, mode: str) -> None:
        rows.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode(mode).saveAsTable(name)

    @contextmanager
    def _in_order(self) -> Iterator[None]:
        before = self.spark.conf.get(KEEP_ORDER, "false")
        self.spark.conf.set(KEEP_ORDER, "true")
        try:
            yield
        finally:
            self.spark.conf.set(KEEP_ORDER, before)

    def table(self) -> DataFrame:
        return self.spark.table(self.name) if self.exists() else self.spark.createDataFrame([], INDEX_SCHEMA)

    def batches(self) -> int:
        """How many batches have been appended."""
        return (self.table().agg(F.max("batch")).first()[0] or 0) if self.exists() else 0

    def files_per_bucket(self) -> float:
        return len(self.table().inputFiles()) / self.buckets if self.exists() else 0.0

    def compact(self) -> None:
        """Rewrite the index as one sorted file a bucket, with the bucket count of its present size.

        No other job may use the index meanwhile. The old table goes only when the new one is whole.
        """
        self.buckets = self._for_rows(self.table().count())
        new = f"{self.name}_compacted"
        self.spark.sql(f"DROP TABLE IF EXISTS {new}")
        self._write(self.table().repartition(self.buckets, "digest"), new, "errorifexists")
        self.drop()
        self.spark.sql(f"ALTER TABLE {new} RENAME TO {self.name}")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Append a batch and say of each of its rows whether it stays.

        Returns id, digest, keep_id (the row that stays, perhaps of an earlier batch),
        group_size (rows of this batch with the text), kept. The result no longer needs the index.
        """
        batch = self.batches() + 1
        rows = written(
            docs.select(
                F.col(id_col).cast("bigint").alias("doc_id"),
                F.unhex(F.sha2(whole_text(text_col).cast("binary"), 256)).alias("digest"),
                F.monotonically_increasing_id().alias("row"),
            ),
            "digests",
        )
        # one row per digest, combined before the shuffle; then dealt out as the index is
        groups = written(
            rows.groupBy("digest").agg(
                F.max("doc_id").alias("last_id"),
                F.max_by("row", F.coalesce("doc_id", F.lit(BEFORE_ALL))).alias("last_row"),
                F.count(F.lit(1)).alias("group_size"),
            ),
            "digest-groups",
        )
        if self.buckets is None:
            self.buckets = self._for_rows(groups.count())
        if not self.exists():
            self._write(self.spark.createDataFrame([], INDEX_SCHEMA), self.name, "errorifexists")
        dealt = groups.repartition(self.buckets, "digest")
        with self._in_order():
            fresh = dealt.join(self.table().hint("merge"), "digest", "left_anti")
            self._write(
                fresh.select("digest", F.col("last_id").alias("keep_id"), F.col("last_row").alias("keep_row"), F.lit(batch).alias("batch")), self.name, "append"
            )
            resolved = written(
                dealt.join(self.table().hint("merge"), "digest").select("digest", "keep_id", "keep_row", "batch", "group_size"),
                "digest-resolved",
            )
        if self.files_per_bucket() > MOST_FILES:
            self.compact()
        # a digest that a third of all rows share is split by adaptive execution: both sides are exchanged
        return rows.join(resolved.hint("merge"), "digest").select(
            "doc_id",
            "digest",
            "keep_id",
            "group_size",
            ((F.col("batch") == batch) & (F.col("row") == F.col("keep_row"))).alias("kept"),
        )


def drop_copies(index: DigestIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    judged = index.add(docs, id_col, text_col).groupBy("doc_id", "digest").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    digest = F.unhex(F.sha2(whole_text(f"d.{text_col}").cast("binary"), 256))
    return without(docs, judged, digest, "digest", id_col, text_col)


def without(docs: DataFrame, judged: DataFrame, told: Column, told_by: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` but those that ``judged`` (doc_id, ``told_by``, stays, n rows) lets go.

    told: what ``told_by`` holds, from the columns of ``d``. Texts are shuffled once. Only where rows
    repeat id and text (null is the empty text), of which one stays, the rows are dealt out by both.
    """
    judged = written(judged, "judged")
    gone = written(judged.where("not stays").select(F.col("doc_id").alias("gone_id"), F.col(told_by).alias("gone_told")), "gone")
    same = F.col(f"d.{id_col}").cast("bigint").eqNullSafe(F.col("g.gone_id")) & (told == F.col("g.gone_told"))
    survivors = docs.alias("d").join(gone.alias("g").hint("merge"), same, "left_anti")
    if judged.where("stays and n > 1").isEmpty():
        return survivors
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = survivors.select(whole.alias("row"), F.col(id_col).cast("bigint").alias("id"), whole_text(text_col).alias("told"))
    return keyed.dropDuplicates(["id", "told"]).select("row.*")
