import math
import struct
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import sharding as S

from .helpers import ODD, table


def mixed(label, key):
    """Spark's xxhash64 of a string and a long, from the hash's definition: each value's hash is the next one's seed."""
    h = xxhash.xxh64_intdigest(label.encode(), seed=42)
    return h if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), seed=h)


def total(tree):
    return sum(map(total, tree)) if isinstance(tree, tuple) else tree


def descend(key, tree):
    """The shard by plain arithmetic: at each level the child with the smallest draw."""
    place, node, number = (), tree, 0
    while isinstance(node, tuple):
        draws = []
        for i, child in enumerate(node):
            if total(child) > 0:
                u = ((mixed("/".join(map(str, (*place, i))), key) >> 11) + 0.5) * 2.0**-53
                draws.append((-math.log(u) / total(child), i))
        i = min(draws)[1]
        number += sum(leaves(c) for c in node[:i])
        place, node = (*place, i), node[i]
    return number


def leaves(tree):
    return sum(map(leaves, tree)) if isinstance(tree, tuple) else 1


UNEVEN = (((1.0, 2.0, 0.5), (3.0,)), ((0.0, 1.0),), ((1.0, 1.0, 1.0, 4.0), (0.25, 0.25), (2.0,)))


@pytest.mark.parametrize("tree", [S.TOPOLOGY, S.grow(S.TOPOLOGY), UNEVEN])
def test_shards_against_plain_draws(spark, tree):
    keys = [*range(-50, 3000), 2**62, -(2**63), None]
    d = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    got = {r.doc_id: r.s for r in S.place(d, F.col("doc_id"), tree, "s").collect()}
    assert got == {k: descend(k, tree) for k in keys}


def test_operator_against_plain_draws(spark):
    rows = ODD + [(1000 + i, f"t{i}") for i in range(2000)]
    for r in S.shard(table(spark, rows)).collect():
        assert (r.shard, r.grown_shard) == (descend(r.doc_id, S.TOPOLOGY), descend(r.doc_id, S.grow(S.TOPOLOGY)))


def test_law_slots_and_movement(spark):
    rows = ODD + [(1000 + i, f"t{i}") for i in range(12000)]
    got = S.shard(table(spark, rows)).collect()
    assert len(got) == len(rows)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(24))
    assert min(counts.values()) > 0.8 * len(rows) / 24 and max(counts.values()) < 1.2 * len(rows) / 24
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    moved = [r for r in got if r.grown_shard != r.shard]
    assert {r.grown_shard for r in moved} == {24}
    assert 0.7 / 25 < len(moved) / len(rows) < 1.3 / 25
    text = dict(rows[len(ODD) :])
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.size == 8 + len(text[r.doc_id]) for r in got if r.doc_id in text)
    assert {(r.size, r.text_crc32) for r in got if r.doc_id in (1, 2)} == {(8, 0)}


def test_hot_rows_are_numbered_without_gaps(spark):
    """A third of the rows equal in key and text, a third with one key, a very long text."""
    rows = [(5, "same")] * 400 + [(6, f"t{i}") for i in range(400)] + [(7, "x" * 3_000_000)] + [(100 + i, "t") for i in range(400)]
    got = S.shard(table(spark, rows).repartition(7)).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(got) == len(rows) and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_a_changed_weight_moves_rows_only_to_its_subtree(spark):
    keys = spark.range(4000).withColumnRenamed("id", "doc_id")
    heavier = (S.TOPOLOGY[0], (S.TOPOLOGY[1][0], (1.0, 1.0, 3.0, 1.0)), S.TOPOLOGY[2])
    d = S.place(S.place(keys, F.col("doc_id"), S.TOPOLOGY, "a"), F.col("doc_id"), heavier, "b").where("a <> b").collect()
    assert d and all(r.b in range(8, 16) for r in d)  # only the region whose weight grew receives rows


def test_native_plan_and_empty_table(spark):
    d = S.shard(table(spark, ODD))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert S.shard(table(spark, ODD).limit(0)).count() == 0
