"""Multilayer edge-list text: a header ``layer:<i> nodes=<n> edges=<m>``, then lines ``u v``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import running


def parse(lines: DataFrame) -> DataFrame:
    """(graph, layer, u, v) of ``lines(graph, line_no, line)``.

    Lines are counted by ranges of their order, so that a graph may be of any size.
    Blank lines, lines before the first header and lines without exactly two
    tokens are left out; a token that is no integer is an error.  Edges are
    undirected and count once.
    """
    line = F.trim("line")
    rows = lines.withColumn("head", line.startswith("layer:"))
    rows = running(rows, [F.asc("graph"), F.asc("line_no")], _upto=F.col("head").cast("int"))
    first = rows.groupBy("graph").agg((F.min("_upto") - F.min_by(F.col("head").cast("int"), "line_no")).alias("_before"))  # heads of earlier graphs
    rows = rows.join(first, "graph").withColumn("layer", F.col("_upto") - F.col("_before"))
    parts = F.split(line, r"\s+")
    rows = rows.filter(~F.col("head") & (F.col("layer") > 0) & (F.size(parts) == 2) & (line != ""))
    ends = rows.select("graph", F.col("layer").cast("int").alias("layer"), parts[0].cast("bigint").alias("x"), parts[1].cast("bigint").alias("y"))
    return ends.select("graph", "layer", F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()


def node_counts(lines: DataFrame) -> DataFrame:
    """(graph, n_nodes): from the name (third token from the end), else the first header, else the largest id and 1."""
    named = F.expr("try_cast(element_at(split(element_at(split(graph, '/'), -1), '_'), -3) as bigint)")
    named = F.when(F.size(F.split(F.element_at(F.split("graph", "/"), -1), "_")) >= 3, named)
    head = F.when(F.trim("line").startswith("layer:"), F.regexp_extract("line", r"nodes=(\d+)", 1))
    top = parse(lines).groupBy("graph").agg((F.max(F.greatest("u", "v")) + 1).alias("top"))
    by = lines.groupBy("graph").agg(F.min_by(F.when(head != "", head), F.when(head != "", F.col("line_no"))).cast("bigint").alias("head"))
    return by.join(top, "graph", "left").select("graph", F.coalesce(named, "head", "top").alias("n_nodes"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Lines (graph, line_no, line) of one file or of all ``*.txt`` files in a folder; each file is one record."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt").select(F.input_file_name().alias("name"), "value")
    graph = F.regexp_replace(F.element_at(F.split("name", "/"), -1), r"\.txt$", "")
    return files.select(graph.alias("graph"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def order_of(graph: str):
    """Sort key of a graph's name: its integer prefix first, then the name."""
    return F.struct(F.expr(f"try_cast(split({graph}, '_')[0] as bigint)"), F.col(graph))


def lines_of(layers: dict[int, DataFrame], nodes: DataFrame) -> DataFrame:
    """(layer, ord, line): the text of layers (u, v), headers first."""
    n = nodes.agg(F.count("*").alias("n"))
    out = None
    for k, edges in layers.items():
        head = edges.agg(F.count("*").alias("m")).crossJoin(n).select(F.lit(k).alias("layer"), F.lit("").alias("ord"), F.concat(F.lit(f"layer:{k} nodes="), "n", F.lit(" edges="), "m").alias("line"))
        body = edges.select(F.lit(k).alias("layer"), F.concat(F.lpad(F.col("u").cast("string"), 20, "0"), F.lpad(F.col("v").cast("string"), 20, "0")).alias("ord"), F.concat_ws(" ", "u", "v").alias("line"))
        part = head.unionByName(body)
        out = part if out is None else out.unionByName(part)
    return out


def write(layers: dict[int, DataFrame], nodes: DataFrame, path: str) -> None:
    """One text file in the folder ``path``, lines in order."""
    lines_of(layers, nodes).orderBy("layer", "ord").coalesce(1).select("line").write.mode("overwrite").text(path)
