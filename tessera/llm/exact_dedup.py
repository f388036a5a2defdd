"""Exact dedup with a heavy-hitter split.

Misra-Gries summaries find the digests that may be frequent; their exact sizes and winners are then counted, and a
broadcast of at most `counters` rows decides their losing rows where they are read. All other rows, and the winners of
the frequent groups, go through an ordinary shuffle by digest, whose groups are now all small.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, column, documents, fresh, trimmed

#: Parts in which rows that share a frequent group's text and key are numbered.
PARTS = 256


def digest(text: str) -> Column:
    return F.sha2(F.coalesce(column(text), F.lit("")), 256)


def _summaries(counters: int):
    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for x in batch.column(0).value_counts().to_pylist():
                held[x["values"]] += x["counts"]
            if len(held) > counters:  # as merging two summaries does: take the (k+1)-th largest count off all
                off = sorted(held.values(), reverse=True)[counters]
                held = Counter({k: v - off for k, v in held.items() if v > off})
        rows = [(k, v) for k, v in held.items() if v > 0]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.int64())], ["d", "n"])

    return run


def heavy_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", counters: int = 1024) -> list[tuple]:
    """(digest, rows, largest key) of at most `counters` digests, whose counts are exact. The summaries count each digest
    short by a share of 1/counters at most, and fewer than `counters` of them reach that share, so every digest with
    more than a share of 2/counters of the rows is among them."""
    spark = docs.sparkSession
    bounded(spark)
    digests = docs.select(digest(text).alias("d"), column(key).alias("k"))
    found = digests.select("d").mapInArrow(trimmed(_summaries(counters)), "d string, n long").groupBy("d").agg(F.sum("n").alias("n"))
    found = [r.d for r in found.orderBy(F.desc("n"), "d").limit(counters).collect()]
    if not found:
        return []
    asked = F.broadcast(spark.createDataFrame([(d,) for d in found], "d string"))
    exact = digests.join(asked, "d", "left_semi").groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("k"))
    return [tuple(r) for r in exact.where("n > 1").collect()]


def mark_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", counters: int = 1024) -> DataFrame:
    """docs and a last column, a struct of keep_id, group_size, kept and text_sha256; its name is `__xd`, or with more
    underscores where docs has that.

    Null texts count as empty, so they equal empty ones. Of equal texts the row with the largest key stays; null keys
    are smaller than all others, and of rows repeated with the same key and text exactly one stays. An empty table
    gives no rows. Other columns, whatever their names, pass through. Rows of a frequent group that share its largest
    key are numbered in PARTS parts first, so no task holds them all.
    """
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    mark_name, d, n, k, part, rank = (fresh(docs, x) for x in ("xd", "xd_digest", "xd_n", "xd_k", "xd_part", "xd_rank"))
    heavy = heavy_groups(docs, text, key, counters)
    table = F.broadcast(spark.createDataFrame(heavy, f"{d} string, {n} long, {k} {kind}"))
    rows = docs.withColumn(d, digest(text)).join(table, d, "left")
    own = [column(c) for c in docs.columns]

    def marked(of: DataFrame, keep: Column, size: Column, kept: Column) -> DataFrame:
        fields = [keep.alias("keep_id"), size.cast("long").alias("group_size"), kept.alias("kept"), F.col(d).alias("text_sha256")]
        return of.select(*own, F.struct(*fields).alias(mark_name))

    wins = F.col(n).isNotNull() & column(key).eqNullSafe(F.col(k))
    removed = marked(rows.where(F.col(n).isNotNull() & ~wins), F.col(k), F.col(n), F.lit(False))
    ties = rows.where(wins).withColumn(part, F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    ties = ties.withColumn(rank, F.row_number().over(Window.partitionBy(d, part).orderBy(F.lit(0))))
    firsts = ties.where(F.col(rank) == 1).withColumn(rank, F.row_number().over(Window.partitionBy(d).orderBy(part)))
    others = marked(ties.where(F.col(rank) > 1), F.col(k), F.col(n), F.lit(False))
    won = marked(firsts, F.col(k), F.col(n), F.col(rank) == 1)
    group = Window.partitionBy(d)
    first = F.row_number().over(group.orderBy(column(key).desc_nulls_last()))
    rest = marked(rows.where(F.col(n).isNull()), F.max(column(key)).over(group), F.count(F.lit(1)).over(group), first == 1)
    return removed.unionByName(others).unionByName(won).unionByName(rest)


def drop_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", counters: int = 1024) -> DataFrame:
    """One row of each group of equal texts, with the columns of docs."""
    out = mark_copies(docs, text, key, counters)
    return out.where(F.col(out.columns[-1])["kept"]).select(*map(column, docs.columns))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_copies(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "__xd.*")


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
