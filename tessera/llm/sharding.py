"""Sharding by a hierarchical weighted hash tree, in built-in expressions only.

A row descends region, rack and shard. At each level every child draws -ln(u) / weight, u from a hash of the row's key
and the child's place in the tree, and the smallest draw wins. A draw depends on its own child alone, so a change of
one weight moves rows only into or out of that child's subtree; the others' rows stay where they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, documents, fresh, materialize

#: regions > racks > weights of the shards: 3 x 2 x 4
TOPOLOGY = tuple(tuple(tuple(1.0 for _ in range(4)) for _ in range(2)) for _ in range(3))
#: Parts of a shard that are numbered on their own; the table of their sizes has shards x PARTS rows at any input size.
PARTS = 4096


def grow(tree: tuple, weight: float = 1.0) -> tuple:
    """One more shard. It opens a region of its own: rows move only into it, as no draw in the other regions changes."""
    return (*tree, ((weight,),))


def _pick(key: Column, place: tuple[int, ...], weights: list[float]) -> Column:
    """The index of the child with the smallest draw; of equal draws, the first."""
    draws = []
    for i, w in enumerate(weights):
        if w <= 0:
            continue
        bits = F.shiftrightunsigned(F.xxhash64(F.lit("/".join(map(str, (*place, i)))), key), 11)
        u = (bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
        draws.append(F.struct((-F.ln(u) / F.lit(float(w))).alias("draw"), F.lit(i).alias("i")))
    return F.array_min(F.array(*draws))["i"]


def _cases(at: Column, results: list[Column]) -> Column:
    return reduce(lambda acc, x: acc.when(at == x[0], x[1]), list(enumerate(results))[1:],
        F.when(at == 0, results[0])) if len(results) > 1 else results[0]


def place(df: DataFrame, key: Column, tree: tuple, name: str) -> DataFrame:
    """df with the shard of each row; shards are numbered in the tree's order. Levels are columns of their own, so each
    is computed once for a row, and of a level only the draws of the chosen parent."""
    total = lambda x: sum(map(total, x)) if isinstance(x, tuple) else x
    numbers, n = {}, 0
    for r, racks in enumerate(tree):
        for k, shards in enumerate(racks):
            for s in range(len(shards)):
                numbers[r, k, s] = n
                n += 1
    region, rack = fresh(df, f"{name}_region"), fresh(df, f"{name}_rack")
    df = df.withColumn(region, _pick(key, (), [total(x) for x in tree]))
    df = df.withColumn(rack, _cases(F.col(region), [_pick(key, (r,), [total(x) for x in racks]) for r, racks in enumerate(tree)]))
    leaf = _cases(F.col(region), [_cases(F.col(rack),
        [_pick(key, (r, k), list(shards)) + F.lit(numbers[r, k, 0]) for k, shards in enumerate(racks)]) for r, racks in enumerate(tree)])
    return df.withColumn(name, leaf.cast("int")).drop(region, rack)


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", tree: tuple = TOPOLOGY) -> DataFrame:
    """doc_id, size, text_crc32, law ('key'), shard, slot and grown_shard, a row for each row of docs.

    The key and the tree alone decide the shard, so rows repeated with the same key share one, and so do all null keys.
    Null texts count as empty: size 8, checksum 0. slot numbers a shard's rows from 0 without gaps: rows are numbered
    within PARTS hashed parts of each shard and the parts' sizes are summed up before them, so that no task holds a
    whole shard; rows repeated with key and text part by the partition they are read in. The sizes are a row a shard
    and part, at most 100 shards x PARTS x 24 bytes = 10 MB, and are broadcast. Which slot a row gets depends on how the
    table is read; that slots are gapless does not. Other columns are not read. An empty table gives no rows.
    """
    body = F.coalesce(column(text), F.lit(""))
    rows = docs.select(column(key).cast("long").alias("doc_id"), (F.octet_length(body).cast("long") + F.lit(8)).alias("size"),
        F.crc32(F.encode(body, "utf-8")).alias("text_crc32"))
    rows = place(place(rows, F.col("doc_id"), tree, "shard"), F.col("doc_id"), grow(tree), "grown_shard")
    spread = F.xxhash64(F.lit("slot"), "doc_id", "text_crc32", "size", F.spark_partition_id())
    # written, so that the parts' sizes and the numbers in them come from the same rows, and texts are read once
    rows = materialize(rows.withColumn("part", F.pmod(spread, F.lit(PARTS)).cast("int")), "shard-rows")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).select("shard", "part",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")) - 1
    rows = rows.withColumn("inside", inside).join(F.broadcast(sizes), ["shard", "part"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("before") + F.col("inside")).cast("long").alias("slot"), "grown_shard")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))
