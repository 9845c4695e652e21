"""Registered queries of searches over all nodes, of the alignment of roles, and of kept features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import softmax
from ..operators import alias, attack, blocks, celf, centrality, generations, graph, influence, krylov, losses, powers, search, similarity, swaps, walks
from ..session import shared_dir, stored
from ..sources import features
from ..sources.layers import Layers
from . import sql
from .catalogue import _CORES, _both, _side_weights, pagerank_sql, register
from .catalogue import _sides as _vectors
from .extended import _TWO, _networks, _pop


@register()
def celf_labels(x: Layers) -> DataFrame:
    """What every node adds when its turn in the greedy order comes; tests hold it against one round a node."""
    return celf.labels(x.nodes, _both(x), 0.05, 20)


def _sides(x: Layers) -> list[swaps.Side]:
    """Both layers, worth potential times weight, each with its ten nodes of highest degree as seeds."""
    out = []
    for edges in (x.l1, x.l2):
        arcs = graph.symmetric(edges)
        worth = influence.potential(x.nodes, arcs).join(centrality.alpha(x.nodes, arcs), "node")
        values = worth.select("node", (F.col("potential") * F.col("w")).alias("value"))
        out.append(swaps.Side.of(search.zones(x.nodes, arcs), values, x.top_degree(edges)))
    return out


def _swaps_sql() -> str:
    """All exchanges on either layer: the performance of what stays, and what a candidate's zone adds to it."""
    parts = []
    for k, s in ((1, "sa"), (2, "sb")):
        parts += [
            f"pv{k} AS (SELECT d.node, (1 + 0.01::DOUBLE * d.deg + 0.0001::DOUBLE * coalesce((SELECT sum(m.deg) FROM e{k} e JOIN d{k} m ON m.node = e.dst WHERE e.src = d.node), 0)) * a.w AS value FROM d{k} d JOIN alpha{k} a USING (node))",
            f"zn{k} AS (SELECT DISTINCT a.src, b.dst FROM e{k} a JOIN e{k} b ON a.dst = b.src WHERE a.src <> b.dst UNION ALL SELECT node, node FROM nodes)",
            f"st{k} AS (SELECT DISTINCT o.node AS out_node, z.dst AS m FROM {s} o JOIN {s} i ON i.node <> o.node JOIN zn{k} z ON z.src = i.node)",
            f"ps{k} AS (SELECT out_node, sum(value) AS base FROM st{k} JOIN pv{k} ON node = m GROUP BY out_node)",
            f"nw{k} AS (SELECT o.node AS out_node, z.src AS in_node, sum(CASE WHEN c.m IS NULL THEN value ELSE 0 END) AS fresh FROM {s} o CROSS JOIN zn{k} z JOIN pv{k} p ON p.node = z.dst LEFT JOIN st{k} c ON c.out_node = o.node AND c.m = z.dst WHERE z.src NOT IN (SELECT node FROM {s}) GROUP BY ALL)",
            f"bx{k} AS (SELECT out_node, in_node, base + fresh AS p FROM nw{k} JOIN ps{k} USING (out_node) ORDER BY round(base + fresh, 9) DESC, out_node, in_node LIMIT 1)",
        ]
    return ", ".join(parts)


@register(sql.query("SELECT a.out_node AS out_l1, a.in_node AS in_l1, b.out_node AS out_l2, b.in_node AS in_l2, round(a.p + b.p - 0.5::DOUBLE * abs(a.p - b.p), 8) AS fitness FROM bx1 a, bx2 b", _swaps_sql()))
def two_swap_across(x: Layers) -> DataFrame:
    return swaps.two_swap_across(*_sides(x)).withColumn("fitness", F.round("fitness", 8))


_VALUE = "vl AS (SELECT p.node, p.potential * a.w AS value FROM pot1 p JOIN alpha1 a USING (node))"


@register(sql.query("SELECT node, round(value, 9) AS value FROM (SELECT node, value FROM vl ORDER BY value DESC, node LIMIT 20) WHERE node NOT IN (SELECT node FROM sa)", _VALUE))
def swap_candidates(x: Layers) -> DataFrame:
    """The twenty nodes worth most, without the seeds."""
    arcs = graph.symmetric(x.l1)
    worth = influence.potential(x.nodes, arcs).join(centrality.alpha(x.nodes, arcs), "node")
    values = worth.select("node", (F.col("potential") * F.col("w")).alias("value"))
    return search.top_candidates(values, x.top_degree(x.l1)).withColumn("value", F.round("value", 9))


_LOGITS = "lg AS (SELECT e.src, e.dst, ln(1 + a.deg) - ln(1 + b.deg) AS x FROM e1 e JOIN d1 a ON a.node = e.src JOIN d1 b ON b.node = e.dst)"


def _logits(x: Layers) -> DataFrame:
    """What an arc's two degrees make of it, as attention would score it."""
    arcs = graph.symmetric(x.l1)
    deg = graph.degree(x.nodes, arcs)
    rows = arcs.join(deg.toDF("src", "ds"), "src").join(deg.toDF("dst", "dd"), "dst")
    return rows.select("src", "dst", (F.log(1.0 + F.col("ds")) - F.log(1.0 + F.col("dd"))).alias("x"))


@register(sql.query("SELECT src, dst, round(exp(x / 0.5::DOUBLE) / sum(exp(x / 0.5::DOUBLE)) OVER (PARTITION BY dst), 9) AS share FROM lg", _LOGITS))
def softmax_by_destination(x: Layers) -> DataFrame:
    return softmax(_logits(x), "x", ["dst"], 0.5).select("src", "dst", F.round("share", 9).alias("share"))


@register(sql.query("SELECT src, dst, round(x - ln(sum(exp(x)) OVER ()), 8) AS share FROM lg", _LOGITS))
def log_softmax_all(x: Layers) -> DataFrame:
    return softmax(_logits(x), "x", [], log=True).select("src", "dst", F.round("share", 8).alias("share"))


@register()
def gap_filling(x: Layers) -> DataFrame:
    """Exchanges until none helps; tests hold it against a search that recomputes everything."""
    return swaps.fill_gaps(*_sides(x))


@register()
def two_swap_within(x: Layers) -> DataFrame:
    """The best exchange of two seeds for two nodes; tests hold it against all pairs."""
    return swaps.two_swap_within(_sides(x)[0])


def _roles_sql() -> str:
    """Ranks, unit vectors, hubs and thirds of both sides; all pairs with their target."""
    parts = []
    for k in "ab":
        parts += [
            f"rk{k} AS (SELECT idx, w, row_number() OVER (ORDER BY w DESC, idx) - 1 AS spot, count(*) OVER () AS n FROM w_{k})",
            f"un{k} AS (SELECT r.idx, r.w, r.spot, r.spot / greatest(r.n - 1, 1)::DOUBLE AS r, least(r.spot // (r.n // 3), 2) AS bin, list_transform(e.z, lambda x: x / sqrt(list_dot_product(e.z, e.z))) AS u FROM rk{k} r JOIN emb_{k} e USING (idx))",
            f"hb{k} AS (SELECT idx, u FROM un{k} WHERE spot < (SELECT greatest(5, least(50, floor(count(*) * 0.1::DOUBLE))) FROM w_{k}))",
            f"hc{k} AS (SELECT pos, avg(v) AS v FROM (SELECT unnest(u) AS v, unnest(range(0, 64)) AS pos FROM hb{k}) GROUP BY pos)",
            f"pc{k} AS (SELECT bin, pos, sum(w * v) / sum(w) AS v FROM (SELECT bin, w, unnest(u) AS v, unnest(range(0, 64)) AS pos FROM un{k}) GROUP BY bin, pos)",
        ]
    return ", ".join(parts) + (
        ", hl AS (SELECT avg(ln(e) - m) AS spread FROM (SELECT a.idx, sum(exp(list_dot_product(a.u, b.u) / 0.1::DOUBLE)) AS e, avg(list_dot_product(a.u, b.u) / 0.1::DOUBLE) AS m FROM hba a, hbb b GROUP BY a.idx))"
        ", tg AS (SELECT a.idx AS a, b.idx AS b, list_dot_product(a.u, b.u) AS sim, abs(a.r - b.r) AS gap, exp(-abs(a.r - b.r) / 0.15::DOUBLE) AS t FROM una a, unb b)"
        ", tz AS (SELECT a, sum(t) AS z, ln(sum(exp(sim / 0.1::DOUBLE))) AS lse FROM tg GROUP BY a)"
        ", kl AS (SELECT avg(k) AS kl FROM (SELECT a, sum(t / z * (ln(t / z) - sim / 0.1::DOUBLE + lse)) AS k FROM tg JOIN tz USING (a) GROUP BY a))"
        ", dm AS (SELECT 1 - avg(sim) AS direct FROM (SELECT a, arg_min(sim, (gap, b)) AS sim FROM tg GROUP BY a))"
        ", cd AS (SELECT 1 - sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)) AS centre FROM hca a JOIN hcb b USING (pos))"
        ", pd AS (SELECT avg(d) AS proto FROM (SELECT 1 - sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)) AS d FROM pca a JOIN pcb b USING (bin, pos) GROUP BY bin))"
    )


@register(
    sql.query(
        "SELECT round(centre + 0.5::DOUBLE * spread, 6) AS loss_hub, round(kl + 0.5::DOUBLE * direct, 6) AS loss_match, round(proto, 6) AS loss_prototype,"
        " round(centre + 0.5::DOUBLE * spread + kl + 0.5::DOUBLE * direct + 0.5::DOUBLE * proto, 6) AS loss_role FROM cd, hl, kl, dm, pd",
        _roles_sql(),
    )
)
def role_losses(x: Layers) -> DataFrame:
    a, b = _vectors(x)
    rows = losses.role_alignment(a, _side_weights(a), b, _side_weights(b))
    return rows.select(*[F.round(c, 6).alias(c) for c in rows.columns])


@register()
def alias_walks(x: Layers) -> DataFrame:
    """Second-order walks over arcs weighted by their end; tests hold tables and steps against exact frequencies."""
    arcs = graph.symmetric(x.l1)
    weighted = arcs.join(centrality.alpha(x.nodes, arcs).select(F.col("node").alias("dst"), "w"), "dst").select("src", "dst", "w")
    return alias.walks(x.nodes, alias.Tables(weighted), 2, 5, 0.5, 2.0).select("start", "walk", F.array_join("path", ",").alias("path"))


@register()
def biased_walk_embedding(x: Layers) -> DataFrame:
    """Skip-gram vectors over second-order walks."""
    return walks.node_vectors(alias.walks(x.nodes, alias.Tables(graph.symmetric(x.l1)), 2, 5, 0.5, 2.0))


@register()
def eigenvector_converged(x: Layers) -> DataFrame:
    """Centrality by the leading eigenvector, to its residual; tests hold it against a dense solver."""
    vector, _, _ = krylov.leading(x.nodes, graph.symmetric(x.l1))
    return vector.select("node", F.round("x", 6).alias("eigenvector"))


def _scores_sql(p: str = "0.01::DOUBLE") -> str:
    """Both sides of every candidate on their layers: genes, arcs out of them, and who else is there."""
    return (
        "gn AS (SELECT id, 0 AS side, unnest(seeds) AS node FROM sm UNION ALL SELECT id, 1, unnest(seeds) FROM sm2)"
        ", ar AS (SELECT 0 AS side, src, dst FROM e1 UNION ALL SELECT 1, src, dst FROM e2)"
        ", dg AS (SELECT side, src AS node, count(*) AS deg FROM ar GROUP BY ALL)"
        ", hp AS (SELECT g.id, g.side, g.node AS s, a.dst AS node FROM gn g JOIN ar a ON a.side = g.side AND a.src = g.node)"
        ", mt AS (SELECT g.id, a.side, a.dst AS node, count(*) AS m FROM gn g JOIN ar a ON a.side = 1 - g.side AND a.src = g.node GROUP BY ALL)"
        f", fr AS (SELECT h.id, h.side, sum(CASE WHEN r.node IS NULL THEN {p} * (1 + {p} * (d.deg - coalesce(t.m, 0))) - CASE WHEN o.node IS NULL THEN 0 ELSE {p} * (1 + {p} * floor(d.deg / pow(2, coalesce(t.m, 0)))) END ELSE 0 END) AS met, sum(CASE WHEN o.node IS NULL THEN {p} * (1 + {p} * d.deg) ELSE 0 END) AS alone"
        " FROM hp h JOIN dg d ON d.side = h.side AND d.node = h.node LEFT JOIN mt t ON t.id = h.id AND t.side = h.side AND t.node = h.node LEFT JOIN gn r ON r.id = h.id AND r.side = 1 - h.side AND r.node = h.node LEFT JOIN gn o ON o.id = h.id AND o.side = h.side AND o.node = h.node GROUP BY ALL)"
        ", ts AS (SELECT g.id, g.side, count(*) + coalesce(max(f.met), 0) AS t, count(*) + coalesce(max(f.alone), 0) AS alone FROM gn g LEFT JOIN fr f ON f.id = g.id AND f.side = g.side GROUP BY g.id, g.side)"
        f", pt AS (SELECT id, side, node, {p} AS x FROM hp UNION ALL SELECT h.id, h.side, a.dst, {p} * {p} FROM hp h JOIN ar a ON a.side = h.side AND a.src = h.node AND a.dst <> h.s UNION ALL SELECT id, side, node, 1.0::DOUBLE FROM gn)"
        ", pb AS (SELECT id, side, node, least(1.0::DOUBLE, sum(x)) AS pr FROM pt GROUP BY ALL)"
        ", jn AS (SELECT id, sum(q) AS joint FROM (SELECT id, node, 1 - (1 - coalesce(max(pr) FILTER (side = 0), 0)) * (1 - coalesce(max(pr) FILTER (side = 1), 0)) AS q FROM pb GROUP BY id, node) GROUP BY id)"
        ", tt AS (SELECT id, max(t) FILTER (side = 0) AS t1, max(t) FILTER (side = 1) AS t2, sum(alone) AS alone FROM ts GROUP BY id)"
    )


@register(sql.query("SELECT id, round(t1, 9) AS t1, round(t2, 9) AS t2, round(joint / (alone + 1e-12::DOUBLE) * 2 * t1 * t2 / (t1 + t2 + 1e-12::DOUBLE), 9) AS t3 FROM tt JOIN jn USING (id)", _TWO + ", " + _scores_sql()))
def population_scores(x: Layers) -> DataFrame:
    """Influence of both sides of every candidate and their synergy, all candidates in one join a layer."""
    return generations.scores(_pop(x), graph.symmetric(x.l1), graph.symmetric(x.l2)).select("id", "t1", "t2", "t3")


def _guide(x: Layers) -> tuple[generations.Guide, DataFrame]:
    """Weights of both layers, counterparts and neighbours by the embeddings, and the best aligned pairs."""
    a, b = (s.select("idx", "z") for s in _vectors(x))
    weights = tuple(centrality.alpha(x.nodes, graph.symmetric(e)) for e in (x.l1, x.l2))
    guide = generations.Guide(weights, (similarity.translation(a, b), similarity.translation(b, a)), tuple(similarity.knn(s, 5).select("a", "b") for s in (a, b)))
    return guide, blocks.best_pairs(a, b, 150)


@register()
def guided_search(x: Layers) -> DataFrame:
    """Three generations of a hundred candidates with fifteen seeds a side; tests hold each step against a plain twin."""
    guide, pairs = _guide(x)
    one, two = graph.symmetric(x.l1), graph.symmetric(x.l2)
    begin = generations.start(guide, 100, (15, 15), pairs, 30)
    history, _ = generations.search(guide, lambda pop: generations.scores(pop, one, two), begin, 100, (15, 15), 3)
    return history


FEATURES = [
    features.Feature("clustering", graph.clustering),
    features.Feature("h_index", lambda nodes, edges: centrality.h_index(nodes, graph.symmetric(edges))),
    features.Feature("around", lambda nodes, edges: centrality.average_neighbour_degree(nodes, graph.symmetric(edges))),
]

_KEPT = (
    "nw AS (SELECT g, l, u, v FROM l2, (SELECT unnest(['a', 'b', 'c']) AS g, unnest([2, 2, 4]) AS l) UNION ALL SELECT g, l, u, v FROM l1, (SELECT unnest(['b', 'b', 'c']) AS g, unnest([1, 3, 1]) AS l))"
    ", aw AS (SELECT g, l, u AS src, v AS dst FROM nw UNION ALL SELECT g, l, v, u FROM nw)"
    ", dw AS (SELECT g, l, src AS node, count(*) AS deg FROM aw GROUP BY ALL)"
    ", nb AS (SELECT a.g, a.l, a.src AS node, d.deg, row_number() OVER (PARTITION BY a.g, a.l, a.src ORDER BY d.deg DESC) AS rn FROM aw a JOIN dw d ON d.g = a.g AND d.l = a.l AND d.node = a.dst)"
    ", hw AS (SELECT g, l, node, max(CASE WHEN deg >= rn THEN rn ELSE 0 END) AS h, avg(deg) AS around FROM nb GROUP BY ALL)"
    ", tw AS (SELECT a.g, a.l, a.src AS node, count(*) AS t FROM aw a JOIN aw b ON b.g = a.g AND b.l = a.l AND b.src = a.dst JOIN aw c ON c.g = a.g AND c.l = a.l AND c.src = b.dst AND c.dst = a.src GROUP BY ALL)"
)


@register(
    sql.query(
        "SELECT g AS graph, l::BIGINT AS layer, node, deg, round(CASE WHEN deg < 2 THEN 0 ELSE coalesce(t, 0) / (deg * (deg - 1))::DOUBLE END, 6) AS cc, h AS h_index, round(around, 6) AS around FROM dw JOIN hw USING (g, l, node) LEFT JOIN tw USING (g, l, node)",
        _KEPT,
    )
)
def kept_features(x: Layers) -> DataFrame:
    """Features of six layers made in one pass each and read from their store."""
    store = features.Store(x.spark, shared_dir(x.spark))
    got, _ = store.get(_networks(x), FEATURES)
    rows = got["clustering"].join(got["h_index"], ["graph", "layer", "node"]).join(got["around"], ["graph", "layer", "node"])
    return rows.select("graph", "layer", "node", "deg", F.round("cc", 6).alias("cc"), "h_index", F.round("avg_nbr_deg", 6).alias("around"))


@register()
def attack_trajectory_ratio(x: Layers) -> DataFrame:
    """A tenth of all nodes removed in turn; tests hold the order against one removal at a time."""
    return attack.removals(*x.stars(), x.nodes, _l1(x), influence.steps_of(x.nodes.count(), ratio=0.1))


@register()
def r_cs_ratio(x: Layers) -> DataFrame:
    """Robustness of both sides while a tenth of all nodes goes, plain and weighted; tests hold it against the kernel's loop."""
    arcs, steps = _l1(x), influence.steps_of(x.nodes.count(), ratio=0.1)
    a, b = x.stars()
    gone = stored(attack.removals(a, b, x.nodes, arcs, steps))
    weights = centrality.alpha(x.nodes, arcs)
    sides = [attack.mean_influence(p, q, x.nodes, arcs, gone, steps, weights=w, name=n) for p, q, w, n in ((a, b, None, "a"), (b, a, None, "b"), (a, b, weights, "a_weighted"), (b, a, weights, "b_weighted"))]
    rows = sides[0]
    for more in sides[1:]:
        rows = rows.crossJoin(more)  # a row each
    return rows.select(*[F.round(c, 6).alias(c) for c in rows.columns])


@register()
def r_cr_ratio(x: Layers) -> DataFrame:
    """Joint robustness of both layers while a tenth of all nodes goes from each."""
    a, b = x.stars()
    rows = attack.synergy(a, b, x.nodes, _l1(x), stored(graph.symmetric(x.l2)), steps=influence.steps_of(x.nodes.count(), ratio=0.1))
    return rows.select(*[F.round(c, 6).alias(c) for c in rows.columns])


def _l1(x: Layers) -> DataFrame:
    return stored(graph.symmetric(x.l1))


def _powers_sql(k: int) -> str:
    """CTEs st1..stk (src, dst, p): powers of the step matrix."""
    out = ["st1 AS (SELECT e.src, e.dst, 1.0::DOUBLE / d.deg AS p FROM e1 e JOIN d1 d ON d.node = e.src)"]
    out += [f"st{i} AS (SELECT a.src, b.dst, sum(a.p * b.p) AS p FROM st{i - 1} a JOIN st1 b ON a.dst = b.src GROUP BY ALL)" for i in range(2, k + 1)]
    return ", ".join(out)


#: Probabilities are sums of products of 1 / degree: many lie on a tie of the last digit, unless moved a little.
_OFF = 1e-13


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("src", "dst", *[F.round(F.col(c) + _OFF, 9).alias(c) for c in df.columns[2:]])


@register(sql.query("SELECT src, dst, " + ", ".join(f"round(coalesce(sum(p) FILTER (i = {i}), 0) + {_OFF}::DOUBLE, 9) AS p{i}" for i in range(1, 4)) + " FROM (" + " UNION ALL ".join(f"SELECT {i} AS i, src, dst, p FROM st{i}" for i in range(1, 4)) + ") GROUP BY src, dst", _powers_sql(3)))
def walk_powers_k3(x: Layers) -> DataFrame:
    """Walk probabilities of all pairs."""
    return _rounded(powers.all_pairs(_l1(x), 3))


@register(sql.query(f"SELECT src, dst, round(a.p + {_OFF}::DOUBLE, 9) AS p1, " + ", ".join(f"round(coalesce({t}.p, 0) + {_OFF}::DOUBLE, 9) AS p{i}" for i, t in enumerate("bcde", 2)) + " FROM st1 a " + " ".join(f"LEFT JOIN st{i} {t} USING (src, dst)" for i, t in enumerate("bcde", 2)), _powers_sql(5)))
def rrwp_k5(x: Layers) -> DataFrame:
    """Five steps for the pairs with an arc, from two-step rows."""
    return _rounded(powers.of_arcs(_l1(x), 5))


def _graphs_sql(most: int) -> str:
    kernel = " + ".join(f"exp(-d2 / {2 * s * s}::DOUBLE)" for s in losses.SIGMAS)
    sides = []
    for t in "ab":
        share = f"SELECT label AS graph, idx, z, greatest(z[1], 0) AS w, sum(greatest(z[1], 0)) OVER (PARTITION BY label) AS t, count(*) OVER (PARTITION BY label) AS n FROM emb_{t} WHERE label IS NOT NULL"
        cut = f" QUALIFY row_number() OVER (PARTITION BY graph ORDER BY w DESC, idx) <= {most}" if most else ""
        sides.append(f"g{t} AS (SELECT graph, idx, z, w FROM (SELECT graph, idx, z, CASE WHEN t > 0 THEN w / t ELSE 1.0::DOUBLE / n END AS w FROM ({share})){cut})")
    pairs = [f"SELECT graph, {s}::DOUBLE * sum(u * v * ({kernel}) / 5) AS part FROM (SELECT x.graph, x.w AS u, y.w AS v, pow(list_distance(x.z, y.z), 2) AS d2 FROM g{p} x JOIN g{q} y USING (graph)) GROUP BY graph" for p, q, s in (("a", "a", 1), ("b", "b", 1), ("a", "b", -2))]
    both = "SELECT graph FROM ga INTERSECT SELECT graph FROM gb"
    return sql.query("SELECT round(coalesce(avg(d), 0), 6) AS ammd, count(*) AS graphs FROM (SELECT graph, sum(part) AS d FROM (" + " UNION ALL ".join(pairs) + f") WHERE graph IN ({both}) GROUP BY graph)", ", ".join(sides))


def _graph_sides(x: Layers) -> list[DataFrame]:
    """Vectors of both sides by label, weighted by their first component (negative ones by 0)."""
    return [s.select(F.col("label").alias("graph"), "idx", "z", F.element_at("z", 1).alias("w")) for s in _vectors(x)]


@register(_graphs_sql(0))
def ammd_graphs(x: Layers) -> DataFrame:
    return losses.mean_discrepancy(*_graph_sides(x)).withColumn("ammd", F.round("ammd", 6))


@register(_graphs_sql(8))
def ammd_graphs_top8(x: Layers) -> DataFrame:
    """Each side of a graph cut to its 8 heaviest vectors: the sampling of the loss."""
    return losses.mean_discrepancy(*_graph_sides(x), most=8).withColumn("ammd", F.round("ammd", 6))


_COLUMNS_SQL = (
    "SELECT d.node, d.deg::DOUBLE AS deg, coalesce(h.h, 0)::DOUBLE AS h_index, core.core::DOUBLE AS core, round(pr.rank, 9) AS pagerank, round(CASE WHEN d.deg = 0 THEN 0 ELSE d.deg + 2.0::DOUBLE / (d.cc + 1) * s.x END, 6) AS nip, round(coalesce(s.si, 0), 6) AS si, 0.0::DOUBLE AS pad_1, 0.0::DOUBLE AS pad_2"
    " FROM cc1 d JOIN core USING (node) JOIN pr USING (node) LEFT JOIN hx h USING (node) LEFT JOIN sx s USING (node) WHERE pr.i = (SELECT max(i) FROM pr)"
)
_COLUMNS_MORE = (
    _CORES + ", " + pagerank_sql("pr", "d1", "e1") + ","
    " hx AS (SELECT node, max(CASE WHEN nbr_deg >= rn THEN rn ELSE 0 END) AS h FROM (SELECT node, nbr_deg, row_number() OVER (PARTITION BY node ORDER BY nbr_deg DESC) AS rn FROM nd1) GROUP BY node),"
    " sx AS (SELECT e.src AS node, avg(sqrt(a.deg::DOUBLE * a.deg + b.deg::DOUBLE * b.deg)) AS si, sum(b.deg / (b.cc + 1)) AS x FROM e1 e JOIN cc1 a ON a.node = e.src JOIN cc1 b ON b.node = e.dst GROUP BY e.src)"
)


@register(sql.query(_COLUMNS_SQL, _COLUMNS_MORE, recursive=True))
def centrality_columns_8(x: Layers) -> DataFrame:
    """Six features and two columns of zeros, as eight asked for give."""
    rows = centrality.columns(x.nodes, x.l1, 8)
    return rows.withColumn("pagerank", F.round("pagerank", 9)).withColumns({c: F.round(c, 6) for c in ("nip", "si")})


@register()
def centrality_columns_12(x: Layers) -> DataFrame:
    """All twelve features; tests hold them against dense matrices."""
    return centrality.columns(x.nodes, x.l1, 12)
