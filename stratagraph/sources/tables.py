"""Parameter grids, networks in one table (graph, layer, u, v), and results as JSON."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def grid(spark: SparkSession, graphs: int, **choices: Iterable) -> DataFrame:
    """One row for each combination of the choices and each of ``graphs`` numbers; choices are lists of settings."""
    rows = spark.range(graphs).withColumnRenamed("id", "graph")
    for name, values in choices.items():
        rows = rows.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return rows


def layer_pairs(networks: DataFrame) -> DataFrame:
    """(graph, side, u, v): the first two layers of graphs that have at least two."""
    numbered = networks.select("graph", "layer").distinct().withColumn("side", F.row_number().over(Window.partitionBy("graph").orderBy("layer")))
    kept = numbered.filter("side <= 2").join(numbered.filter("side = 2").select("graph"), "graph", "left_semi")
    return networks.join(kept, ["graph", "layer"]).select("graph", "side", "u", "v")


def first_pair(networks: DataFrame) -> DataFrame:
    """(side, u, v): the first two layers of the smallest graph name; a single layer stands for both."""
    first = networks.agg(F.min("graph").alias("graph"))
    mine = networks.join(F.broadcast(first), "graph")
    layers = mine.agg(F.min("layer").alias("one"), F.array_sort(F.collect_set("layer")).alias("all"))
    sides = layers.select(F.posexplode(F.array(F.col("one"), F.coalesce(F.get("all", F.lit(1)), "one"))).alias("side", "layer"))
    return mine.join(F.broadcast(sides), "layer").select((F.col("side") + 1).alias("side"), "u", "v")


def results(best: DataFrame, key: str) -> DataFrame:
    """(key, json): each row's other columns as a JSON object."""
    return best.select(key, F.to_json(F.struct(*[c for c in best.columns if c != key])).alias("json"))


def union(layers: dict[tuple[str, int], DataFrame]) -> DataFrame:
    """(graph, layer, u, v) of edges by graph and layer."""
    return reduce(DataFrame.unionByName, [e.select(F.lit(g).alias("graph"), F.lit(k).alias("layer"), "u", "v") for (g, k), e in layers.items()])
