"""Every raster query runs; those with SQL give the same rows as DuckDB."""

import pytest

from tessera import plans

from .oracle import SF, connection, rows


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_same_rows_as_sql(spark, con, name):
    assert rows(plans.QUERIES[name](spark, SF).toArrow()) == rows(con.sql(plans.ORACLE_SQL[name]).to_arrow_table())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_harness_measures(spark):
    rows = plans.QUERIES["harness"](spark, SF).collect()
    assert len(rows) == 32 and all(0 < r.bytes_out and r.bytes_in == 3 * 32 * 32 for r in rows)
    assert all((r.psnr, r.ssim, r.distance) == (float("inf"), 1.0, 0.0) for r in rows if r.mode == "lossless")
    assert all(r.psnr < 100 and r.distance > 0 for r in rows if r.mode == "lossy" and r.name != "dots")


def test_streams_and_matches_are_read_back(spark):
    for name in ("match_sections", "clustered_sections"):
        rows = plans.QUERIES[name](spark, SF).collect()
        assert rows and all(r.exact and 0 < r.coded < 2 * r.n + 100 for r in rows)


def test_clusters_join_what_is_alike(spark):
    hist = spark.createDataFrame([("a", 0, 50), ("a", 1, 50), ("b", 0, 51), ("b", 1, 49), ("c", 7, 100)], "ctx string, sym int, n long")
    from tessera.operators import entropy as E

    got = {r.ctx: r.cluster for r in E.cluster(hist, 2).collect()}
    assert got["a"] == got["b"] != got["c"]


def test_greedy_merge_covers_the_same_area(spark):
    with_area = lambda name: {tuple(r)[:3]: r[3] for r in plans.QUERIES[name](spark, SF).selectExpr("image_id", "dy", "dx",
        "w * h AS a").groupBy("image_id", "dy", "dx").sum("a").collect()}
    assert with_area("patch_merge_rows") == with_area("patch_merge_greedy")


def test_pixel_noise_is_normal(spark):
    from pyspark.sql import functions as F

    from tessera.operators import motion as M

    z = spark.range(40_000).select(M.pixel_gaussian(7, "id").alias("z")).agg(F.avg("z"), F.stddev("z"),
        F.avg(F.col("z") * F.col("z") * F.col("z"))).first()
    assert abs(z[0]) < 0.02 and abs(z[1] - 1) < 0.02 and abs(z[2]) < 0.05
