"""Named queries over the stored tables, each with the SQL that must give the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The pictures of 48 vectors each, and the frames of 256 events each, as common table expressions.
PX = """px AS (SELECT vec_id // 48 AS image_id, (vec_id % 48) // 16 AS c, ((vec_id % 16) // 4) * 8 + i // 8 AS y, (vec_id % 4) * 8 + i % 8 AS x,
  CAST(greatest(0::DOUBLE, least(255::DOUBLE, floor(e::DOUBLE * 256::DOUBLE + 128.5::DOUBLE))) AS INT) AS v
  FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS e FROM embeddings) WHERE vec_id < (SELECT (count(*) // 48) * 48 FROM embeddings))"""
EV = """ev AS (SELECT event_id // 256 AS image_id, 0::BIGINT AS c, (event_id % 256) // 16 AS y, event_id % 16 AS x, CAST(floor(least(value, 255::DOUBLE)) AS INT) AS v
  FROM events WHERE event_id < (SELECT (count(*) // 256) * 256 FROM events))"""
#: A degraded copy, and a wide row a pixel.
PAIR = "pair AS (SELECT image_id, c, y, x, v AS a, v - v % 8 AS b FROM px)"
RGB = "rgb AS (SELECT image_id, y, x, max(v) FILTER (c = 0) AS r, max(v) FILTER (c = 1) AS g, max(v) FILTER (c = 2) AS b FROM px GROUP BY ALL)"
#: Blocks as rows of one sample, the orthonormal basis, and the transform.
BLK = "blk AS (SELECT image_id, c, y // 8 AS by, x // 8 AS bx, y % 8 AS j, x % 8 AS i, v::DOUBLE AS v FROM px)"
BASIS = (
    "basis AS (SELECT k, i, CASE WHEN k = 0 THEN sqrt(1.0 / 8) ELSE sqrt(2.0 / 8) END * cos((2 * i + 1) * k * pi() / 16) AS b FROM "
    "range(8) t(k), range(8) s(i))"
)
DCT = """h AS (SELECT image_id, c, "by", bx, j, k AS u, sum(blk.v * b) AS v FROM blk JOIN basis USING (i) GROUP BY ALL),
  dct AS (SELECT image_id, c, "by", bx, k AS w, u, sum(h.v * b) AS v FROM h JOIN (SELECT k, i AS j, b FROM basis) USING (j) GROUP BY ALL)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def r4(x: Column) -> Column:
    """Four decimals, zero without a sign."""
    return F.when(F.abs(x) < 0.00005, F.lit(0.0)).otherwise(F.round(x, 4))


def s4(x: str) -> str:
    return f"CASE WHEN abs({x}) < 0.00005 THEN 0.0::DOUBLE ELSE round(({x})::DOUBLE, 4) END"


def longs(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]
