"""Kept features: what is made, what is only read, and what a failure leaves."""

import pytest

from stratagraph.operators import graph
from stratagraph.sources import features

SHAPE = "graph string, layer int, u bigint, v bigint"
BASE = [("g", 1, 0, 1), ("g", 1, 1, 2), ("g", 2, 0, 2), ("h", 1, 5, 6), ("h", 1, 6, 7), ("h", 1, 5, 7)]


def degree(nodes, edges):
    return graph.degree(nodes, graph.symmetric(edges))


def plain(rows):
    out = {}
    for g, k, u, v in rows:
        for x in (u, v):
            out[(g, k, x)] = out.get((g, k, x), 0) + 1
    return out


def rows_of(df):
    return {(r["graph"], r["layer"], r["node"]): r["deg"] for r in df.collect()}


def test_only_changed_layers_are_made_again(spark, tmp_path):
    asked = []

    def build(nodes, edges):
        asked.append({(r["graph"], r["layer"]) for r in edges.select("u.graph", "u.layer").distinct().collect()})
        return degree(nodes, edges)

    store, f = features.Store(spark, str(tmp_path)), features.Feature("degree", build)
    nets = spark.createDataFrame(BASE, SHAPE)
    got, made = store.get(nets, [f])
    assert made == {"degree": 3} and rows_of(got["degree"]) == plain(BASE)
    got, made = store.get(spark.createDataFrame(BASE[::-1], SHAPE).repartition(3), [f])  # the same rows in another order
    assert made == {"degree": 0} and rows_of(got["degree"]) == plain(BASE) and len(asked) == 1
    changed = [*BASE, ("g", 2, 2, 3)]
    nets = spark.createDataFrame(changed, SHAPE)
    got, made = store.get(nets, [f])
    assert made == {"degree": 1} and asked[-1] == {("g", 2)} and rows_of(got["degree"]) == plain(changed)
    assert [tuple(r)[:3] for r in store.stale(nets, [f]).collect()] == [("g", 2, "degree")]
    got, made = store.get(spark.createDataFrame(BASE, SHAPE), [f])  # back again: still there
    assert made == {"degree": 0} and rows_of(got["degree"]) == plain(BASE)
    other = features.Feature("degree", build, settings="p=2")
    assert store.get(nets, [other])[1] == {"degree": 3}


def test_a_failed_run_changes_nothing(spark, tmp_path):
    store = features.Store(spark, str(tmp_path))
    store.get(spark.createDataFrame(BASE[:2], SHAPE), [features.Feature("degree", degree)])

    def broken(nodes, edges):
        from pyspark.sql import functions as F

        return degree(nodes, edges).withColumn("deg", F.when(F.col("deg") > 1, F.raise_error(F.lit("broken"))).otherwise(F.col("deg")))

    with pytest.raises(Exception, match="broken"):
        store.get(spark.createDataFrame(BASE, SHAPE), [features.Feature("degree", broken)])
    got, made = store.get(spark.createDataFrame(BASE, SHAPE), [features.Feature("degree", degree)])
    assert made == {"degree": 2} and rows_of(got["degree"]) == plain(BASE)


def test_two_runs_at_once_count_once(spark, tmp_path):
    one, two = features.Store(spark, str(tmp_path)), features.Store(spark, str(tmp_path))
    nets, f = spark.createDataFrame(BASE, SHAPE), features.Feature("degree", degree)
    none = one.markers()
    two.markers = lambda: none  # sees nothing of what the first publishes meanwhile
    one.get(nets, [f])
    two.get(nets, [f])
    assert one.markers().count() == 6
    read = one.get(nets, [f])[0]["degree"]
    assert read.count() == len(plain(BASE)) and rows_of(read) == plain(BASE)


def test_layers_never_meet_and_none_is_fine(spark, tmp_path):
    same = [("g", 1, 0, 1), ("g", 2, 1, 2), ("h", 1, 0, 1)]
    cc = features.over_layers(spark.createDataFrame(same, SHAPE), graph.clustering)
    assert {(r["graph"], r["layer"], r["node"]): r["deg"] for r in cc.collect()} == plain(same)
    got, made = features.Store(spark, str(tmp_path)).get(spark.createDataFrame([], SHAPE), [features.Feature("degree", degree)])
    assert made == {"degree": 0} and got["degree"].columns == ["graph", "layer", "node", "deg"] and got["degree"].count() == 0
