"""Registered queries: each applies one operator to the fixtures, beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import r6
from ..operators import attack, blocks, centrality, evolve, graph, influence, losses, powers, ranking, search, similarity, spectral, walks
from ..session import stored
from ..sources import edgelist, generators
from ..sources.layers import Layers
from . import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _tuned(spark: SparkSession) -> None:
    """A local session with the stock number of shuffle partitions gets one for each core; clusters keep theirs."""
    if spark.sparkContext.master.startswith("local[") and spark.conf.get("spark.sql.shuffle.partitions") == "200":
        spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))


def register(oracle: str | None = None):
    """Register a function of the fixtures (Layers) as a query under its name."""

    def add(f: Callable[[Layers], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            _tuned(spark)
            return f(Layers(spark, sf_dir))

        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in columns})


def _arcs(x: Layers) -> DataFrame:
    return graph.symmetric(x.l1)


# --- layers and structure -------------------------------------------------


@register(sql.query("SELECT 1 AS layer, u, v FROM l1 UNION ALL SELECT 2, u, v FROM l2"))
def layer_edges(x: Layers) -> DataFrame:
    return x.l1.select(F.lit(1).alias("layer"), "u", "v").unionByName(x.l2.select(F.lit(2).alias("layer"), "u", "v"))


@register(sql.query("SELECT src, dst FROM e1"))
def edge_index_symmetric(x: Layers) -> DataFrame:
    return _arcs(x)


@register(sql.query("SELECT u, v FROM l1 INTERSECT SELECT u, v FROM l2"))
def layer_overlap(x: Layers) -> DataFrame:
    return x.l1.intersect(x.l2)


@register(sql.query("SELECT 'g' AS graph, 1 AS layer, u, v FROM l1 UNION ALL SELECT 'g', 2, u, v FROM l2"))
def edgelist_roundtrip(x: Layers) -> DataFrame:
    lines = edgelist.lines_of({1: x.l1, 2: x.l2}, x.nodes)
    lines = lines.select(F.lit("g").alias("graph"), F.concat("layer", F.lit(":"), "ord").alias("line_no"), "line")
    return edgelist.parse(lines)


@register(
    sql.query(
        "SELECT 1 AS layer, (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM l1) AS n_edges, (SELECT count(*) FROM d1 WHERE deg = 0) AS n_isolated, (SELECT count(*) FROM l1) > 0 AS ok"
        " UNION ALL SELECT 2, (SELECT count(*) FROM nodes), (SELECT count(*) FROM l2), (SELECT count(*) FROM d2 WHERE deg = 0), (SELECT count(*) FROM l2) > 0"
    )
)
def layer_quality_check(x: Layers) -> DataFrame:
    return graph.quality({1: x.l1, 2: x.l2}, x.nodes)


@register(sql.query("SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM (SELECT u AS node FROM l1 UNION SELECT v FROM l1)"))
def relabel_dense(x: Layers) -> DataFrame:
    return graph.dense_ids(x.l1)


@register(sql.query("SELECT n.node, coalesce(t.t, 0)::DOUBLE AS t FROM nodes n LEFT JOIN t1 t USING (node)"))
def pad_rows(x: Layers) -> DataFrame:
    return graph.padded(graph.triangles(x.l1).withColumnRenamed("triangles", "t"), x.nodes, ["t"])


@register(sql.query("SELECT u, v FROM l1 WHERE u IN (SELECT node FROM d2 WHERE deg > 2) AND v IN (SELECT node FROM d2 WHERE deg > 2)"))
def induced_subgraph(x: Layers) -> DataFrame:
    return graph.induced(x.l1, graph.degree(x.nodes, graph.symmetric(x.l2)).filter("deg > 2"))


@register(sql.query("SELECT node, deg FROM d1"))
def degree(x: Layers) -> DataFrame:
    return graph.degree(x.nodes, _arcs(x))


def _removed(x: Layers) -> DataFrame:
    best = x.top_degree(x.l1, 6)
    first = x.top_degree(x.l1, 1).select("node")
    return best.join(first, "node", "left_anti").orderBy("pos").limit(5).select("node")


@register(sql.query("SELECT n.node, count(e.dst) AS deg FROM nodes n LEFT JOIN live1 e ON e.src = n.node GROUP BY n.node"))
def degree_active(x: Layers) -> DataFrame:
    return graph.degree(x.nodes, graph.active(_arcs(x), _removed(x)))


@register(sql.query("SELECT node, round(deg / ((SELECT count(*) FROM nodes) - 1)::DOUBLE, 6) AS degree_centrality FROM d1"))
def degree_centrality(x: Layers) -> DataFrame:
    return _r6(centrality.degree_centrality(x.nodes, _arcs(x)), "degree_centrality")


@register(sql.query("SELECT node, a.deg + b.deg AS deg, row_number() OVER (ORDER BY a.deg + b.deg DESC, node) AS rank FROM d1 a JOIN d2 b USING (node)"))
def multilayer_degree_rank(x: Layers) -> DataFrame:
    both = graph.symmetric(x.l1).unionByName(graph.symmetric(x.l2))
    return ranking.ordinal(graph.degree(x.nodes, both).withColumnRenamed("node", "id"), "deg").withColumnRenamed("id", "node")


@register(sql.query("SELECT node, round(cc, 6) AS cc FROM cc1"))
def clustering(x: Layers) -> DataFrame:
    return _r6(graph.clustering(x.nodes, x.l1).select("node", "cc"), "cc")


@register(sql.query("SELECT node, coverage FROM cov1"))
def two_hop_coverage(x: Layers) -> DataFrame:
    return graph.coverage(x.nodes, _arcs(x))


@register(sql.query("SELECT n.node, coalesce(h.h, 0) AS h_index FROM nodes n LEFT JOIN (SELECT node, max(CASE WHEN nbr_deg >= rn THEN rn ELSE 0 END) AS h FROM (SELECT node, nbr_deg, row_number() OVER (PARTITION BY node ORDER BY nbr_deg DESC) AS rn FROM nd1) GROUP BY node) h USING (node)"))
def h_index(x: Layers) -> DataFrame:
    return centrality.h_index(x.nodes, _arcs(x))


@register(sql.query("SELECT n.node, round(coalesce((SELECT avg(nbr_deg) FROM nd1 WHERE nd1.node = n.node), 0), 6) AS avg_nbr_deg FROM nodes n"))
def avg_neighbor_degree(x: Layers) -> DataFrame:
    return _r6(centrality.average_neighbour_degree(x.nodes, _arcs(x)), "avg_nbr_deg")


@register(sql.query("SELECT n.node, round(coalesce((SELECT avg(sqrt(deg::DOUBLE * deg + nbr_deg::DOUBLE * nbr_deg)) FROM nd1 WHERE nd1.node = n.node), 0), 6) AS si FROM nodes n"))
def si_index(x: Layers) -> DataFrame:
    return _r6(centrality.spreading_index(x.nodes, _arcs(x)), "si")


@register(sql.query("SELECT c.node, round(CASE WHEN c.deg = 0 THEN 0 ELSE c.deg + 2.0::DOUBLE / (c.cc + 1) * (SELECT sum(m.deg / (m.cc + 1)) FROM e1 e JOIN cc1 m ON m.node = e.dst WHERE e.src = c.node) END, 6) AS nip FROM cc1 c"))
def nip(x: Layers) -> DataFrame:
    return _r6(centrality.influence_power(x.nodes, x.l1), "nip")


_ROBUST = "rb AS (SELECT c.node, CASE WHEN c.deg = 0 THEN 0 ELSE 0.5::DOUBLE * v.coverage / n + 0.3::DOUBLE * c.cc + 0.2::DOUBLE * c.deg / n END AS raw FROM cc1 c JOIN cov1 v USING (node), (SELECT count(*) AS n FROM nodes))"


@register(sql.query("SELECT node, round(raw / (SELECT sum(raw) FROM rb), 8) AS score FROM rb", _ROBUST))
def robustness_score(x: Layers) -> DataFrame:
    return centrality.robustness(x.nodes, x.l1).select("node", F.round("score", 8).alias("score"))


@register(
    sql.query(
        "SELECT node, round(c.deg / m.a, 6) AS deg, round(c.cc / m.b, 6) AS cc, round(v.coverage / m.c, 6) AS coverage FROM cc1 c JOIN cov1 v USING (node), m",
        "m AS (SELECT max(c.deg)::DOUBLE AS a, CASE WHEN max(c.cc) > 0 THEN max(c.cc) ELSE 1 END AS b, max(v.coverage)::DOUBLE AS c FROM cc1 c JOIN cov1 v USING (node))",
    )
)
def centrality_max_normalised(x: Layers) -> DataFrame:
    rows = graph.clustering(x.nodes, x.l1).join(graph.coverage(x.nodes, _arcs(x)), "node")
    return _r6(centrality.max_normalised(rows, ["deg", "cc", "coverage"]), "deg", "cc", "coverage")


@register(
    sql.query(
        "SELECT c.node, c.deg, round(c.cc, 6) AS cc, round(coalesce((SELECT avg(nbr_deg) FROM nd1 WHERE nd1.node = c.node), 0), 6) AS avg_nbr_deg, round(coalesce((SELECT avg(sqrt(deg::DOUBLE * deg + nbr_deg::DOUBLE * nbr_deg)) FROM nd1 WHERE nd1.node = c.node), 0), 6) AS si FROM cc1 c"
    )
)
def centrality_bundle(x: Layers) -> DataFrame:
    return _r6(centrality.bundle(x.nodes, x.l1).select("node", "deg", "cc", "avg_nbr_deg", "si"), "cc", "avg_nbr_deg", "si")


def pagerank_sql(name: str, deg: str, arcs: str) -> str:
    """Ranks by round (i), until they move less than a millionth a node."""
    return (
        f"{name} AS (SELECT node, deg, 0 AS i, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank, 1e300::DOUBLE AS moved FROM {deg}"
        f" UNION ALL SELECT node, deg, i + 1, next, sum(abs(next - rank)) OVER () FROM (SELECT p.node, p.deg, p.i, p.rank, 0.15::DOUBLE / n.n + 0.85::DOUBLE * (coalesce(g.got, 0) + (SELECT coalesce(sum(rank), 0) FROM {name} WHERE deg = 0) / n.n) AS next"
        f" FROM {name} p LEFT JOIN (SELECT e.dst AS node, sum(q.rank / q.deg) AS got FROM {arcs} e JOIN {name} q ON q.node = e.src GROUP BY e.dst) g USING (node), (SELECT count(*) AS n FROM nodes) n WHERE p.i < 100 AND p.moved >= n.n * 1e-6::DOUBLE))"
    )


@register(sql.query("SELECT node, round(rank, 9) AS rank FROM pr WHERE i = (SELECT max(i) FROM pr)", pagerank_sql("pr", "d1", "e1"), recursive=True))
def pagerank(x: Layers) -> DataFrame:
    return centrality.pagerank(x.nodes, _arcs(x)).select("node", F.round("rank", 9).alias("rank"))


@register(
    sql.query(
        "SELECT node, rank, row_number() OVER (ORDER BY rank DESC, node) AS pos FROM (SELECT node, round(a.rank + b.rank, 9) AS rank FROM pr a JOIN ps b USING (node) WHERE a.i = (SELECT max(i) FROM pr) AND b.i = (SELECT max(i) FROM ps))",
        pagerank_sql("pr", "d1", "e1") + ", " + pagerank_sql("ps", "d2", "e2"),
        recursive=True,
    )
)
def multilayer_pagerank(x: Layers) -> DataFrame:
    return centrality.multilayer_rank(x.nodes, [_arcs(x), graph.symmetric(x.l2)])


def _eigen_sql(rounds: int) -> str:
    out = ["ev0 AS (SELECT node, 1.0::DOUBLE AS x FROM nodes)"]
    for i in range(1, rounds + 1):
        out.append(f"eg{i} AS (SELECT n.node, coalesce((SELECT sum(q.x) FROM e1 e JOIN ev{i - 1} q ON q.node = e.dst WHERE e.src = n.node), 0) AS x FROM nodes n)")
        out.append(f"ev{i} AS (SELECT node, x / (SELECT sqrt(sum(x * x)) FROM eg{i}) AS x FROM eg{i})")
    return ", ".join(out)


@register(sql.query("SELECT node, round(x, 6) AS eigen FROM ev8", _eigen_sql(8)))
def eigenvector_k(x: Layers) -> DataFrame:
    return _r6(centrality.eigenvector(x.nodes, _arcs(x), 8), "eigen")


_CORES = """core USING KEY (node) AS (
    SELECT node, deg AS core FROM (SELECT n.node, coalesce(d.deg, 0)::BIGINT AS deg FROM nodes n LEFT JOIN d1 d USING (node))
    UNION
    SELECT h.node, h.h FROM (
        SELECT node, max(least(core, rn)) AS h FROM (
            SELECT e.src AS node, q.core, row_number() OVER (PARTITION BY e.src ORDER BY q.core DESC) AS rn FROM e1 e JOIN recurring.core q ON q.node = e.dst
        ) GROUP BY node
    ) h JOIN recurring.core o ON o.node = h.node WHERE h.h < o.core AND EXISTS (SELECT 1 FROM core)
)"""


@register(sql.query("SELECT node, core FROM core", _CORES, recursive=True))
def kcore(x: Layers) -> DataFrame:
    return centrality.core_numbers(x.nodes, _arcs(x))


_BFS = """best USING KEY (src, node) AS (
    SELECT node AS src, node, 0 AS dist FROM nodes
    UNION
    SELECT b.src, e.dst, min(b.dist) + 1 FROM best b JOIN e1 e ON e.src = b.node
    WHERE NOT EXISTS (SELECT 1 FROM recurring.best r WHERE r.src = b.src AND r.node = e.dst) GROUP BY b.src, e.dst
)"""


@register(sql.query("SELECT src AS node, coalesce(round(count(*) FILTER (dist > 0) / nullif(sum(dist), 0)::DOUBLE * count(*) FILTER (dist > 0) / ((SELECT count(*) FROM nodes) - 1)::DOUBLE, 6), 0) AS closeness, coalesce(round(sum(1.0::DOUBLE / dist) FILTER (dist > 0), 6), 0) AS harmonic FROM best GROUP BY src", _BFS, recursive=True))
def closeness_harmonic(x: Layers) -> DataFrame:
    return _r6(centrality.whole_closeness(x.nodes, _arcs(x)), "closeness", "harmonic")


@register(
    sql.query(
        "SELECT p.src, p.dst, round(p.p, 9) AS p1, round(coalesce(q.p, 0), 9) AS p2, round(coalesce(r.p, 0), 9) AS p3 FROM st p LEFT JOIN p2 q USING (src, dst) LEFT JOIN p3 r USING (src, dst)",
        "st AS (SELECT e.src, e.dst, 1.0::DOUBLE / d.deg AS p FROM e1 e JOIN d1 d ON d.node = e.src), p2 AS (SELECT a.src, b.dst, sum(a.p * b.p) AS p FROM st a JOIN st b ON a.dst = b.src GROUP BY ALL), p3 AS (SELECT a.src, b.dst, sum(a.p * b.p) AS p FROM p2 a JOIN st b ON a.dst = b.src GROUP BY ALL)",
    )
)
def rrwp_k3(x: Layers) -> DataFrame:
    arcs = stored(_arcs(x))
    return powers.of_pairs(arcs, arcs, 3).withColumns({c: F.round(c, 9) for c in ("p1", "p2", "p3")})


@register(sql.query("SELECT e.src AS row, e.dst AS col, round(-1.0::DOUBLE / sqrt(a.deg * b.deg), 6) AS value FROM e1 e JOIN d1 a ON a.node = e.src JOIN d1 b ON b.node = e.dst UNION ALL SELECT node, node, 1.0::DOUBLE FROM nodes"))
def norm_laplacian(x: Layers) -> DataFrame:
    return _r6(centrality.normalized_laplacian(x.nodes, _arcs(x)), "value")


@register()
def lap_pe(x: Layers) -> DataFrame:
    return spectral.positions(x.nodes, _arcs(x), 4)


@register(
    sql.query(
        'SELECT \'deg\' AS "column", 0::BIGINT AS n_missing, 0::BIGINT AS n_infinite, max(deg)::DOUBLE AS max_value, true AS ok FROM d1 UNION ALL SELECT \'cc\', 0, 0, round(max(cc), 6), max(cc) > 0 FROM cc1'
    )
)
def feature_quality(x: Layers) -> DataFrame:
    return _r6(graph.feature_quality(graph.clustering(x.nodes, x.l1), ["deg", "cc"]), "max_value")


# --- influence and attacks -------------------------------------------------


@register(sql.query(f"SELECT round({sql.side('star_a', 'none', 'e1', 'ones')}, 6) AS influence"))
def influence_2hop(x: Layers) -> DataFrame:
    return _r6(influence.two_hop(x.stars()[0], x.nodes, _arcs(x)), "influence")


@register(sql.query(f"SELECT round({sql.side('star_a', 'none', 'e1', 'alpha1')}, 8) AS influence"))
def influence_2hop_alpha(x: Layers) -> DataFrame:
    a = _arcs(x)
    return influence.two_hop(x.stars()[0], x.nodes, a, weights=centrality.alpha(x.nodes, a)).select(F.round("influence", 8).alias("influence"))


def _pair(wa: str, wb: str, arcs: str = "e1") -> str:
    a, b = sql.side("star_a", "star_b", arcs, wa), sql.side("star_b", "star_a", arcs, wb)
    return sql.query(f"SELECT round({a} + {b}, 6) AS total, round({a}, 6) AS a, round({b}, 6) AS b")


@register(_pair("ones", "ones"))
def competitive_influence(x: Layers) -> DataFrame:
    return _r6(influence.competitive(*x.stars(), x.nodes, _arcs(x)), "total", "a", "b")


@register(_pair("mean1", "mean1"))
def competitive_influence_alpha(x: Layers) -> DataFrame:
    a = _arcs(x)
    w = centrality.alpha(x.nodes, a)
    return _r6(influence.competitive(*x.stars(), x.nodes, a, weights_a=w, weights_b=w), "total", "a", "b")


@register(_pair("ones", "ones", "live1"))
def competitive_influence_masked(x: Layers) -> DataFrame:
    return _r6(influence.competitive(*x.stars(), x.nodes, _arcs(x), removed=_removed(x)), "total", "a", "b")


@register(sql.query("SELECT node, round(potential, 6) AS potential FROM pot1"))
def influence_potential(x: Layers) -> DataFrame:
    return _r6(influence.potential(x.nodes, _arcs(x)), "potential")


_ACT = "pth AS (SELECT a.dst AS node, 0.01::DOUBLE AS x FROM sa s JOIN e1 a ON a.src = s.node UNION ALL SELECT b.dst, 0.0001::DOUBLE FROM sa s JOIN e1 a ON a.src = s.node JOIN e1 b ON b.src = a.dst WHERE b.dst <> s.node)"


@register(sql.query("SELECT n.node, round(CASE WHEN n.node IN (SELECT node FROM sa) THEN 1 ELSE least(1, coalesce((SELECT sum(x) FROM pth WHERE pth.node = n.node), 0)) END, 6) AS prob FROM nodes n", _ACT))
def activation_probability(x: Layers) -> DataFrame:
    return _r6(influence.activation(x.top_degree(x.l1), x.nodes, _arcs(x)), "prob")


@register(sql.query("SELECT n.node, coalesce((SELECT sum(1 + d.deg) FROM e1 e JOIN d1 d ON d.node = e.dst WHERE e.src = n.node AND NOT (CASE WHEN n.node IN (SELECT node FROM star_a) THEN e.dst IN (SELECT node FROM star_b) WHEN n.node IN (SELECT node FROM star_b) THEN e.dst IN (SELECT node FROM star_a) ELSE e.dst IN (SELECT node FROM star_a) OR e.dst IN (SELECT node FROM star_b) END)), 0)::DOUBLE AS score FROM nodes n"))
def node_attack_scores(x: Layers) -> DataFrame:
    return influence.attack_scores(*x.stars(), x.nodes, _arcs(x))


@register(sql.query("SELECT step, node FROM gone5", sql.attacks("star_a", "star_b", "e1", 5)))
def attack_trajectory_k5(x: Layers) -> DataFrame:
    return influence.attacked(*x.stars(), x.nodes, _arcs(x).cache(), 5)


@register(sql.query(f"SELECT round({sql.robust('star_a', 'star_b', 'ones', 3)}, 6) AS a, round({sql.robust('star_b', 'star_a', 'ones', 3)}, 6) AS b", sql.attacks("star_a", "star_b", "e1", 3)))
def r_cs_k3(x: Layers) -> DataFrame:
    return _r6(attack.robust(*x.stars(), x.nodes, _arcs(x).cache(), steps=3).select("a", "b"), "a", "b")


@register(sql.query(f"SELECT round({sql.robust('star_a', 'star_b', 'mean1', 3)}, 6) AS a", sql.attacks("star_a", "star_b", "e1", 3)))
def r_cs_attn_k3(x: Layers) -> DataFrame:
    a = _arcs(x).cache()
    return _r6(attack.robust(*x.stars(), x.nodes, a, steps=3, weights_a=centrality.alpha(x.nodes, a)).select("a"), "a")


_RCR = sql.attacks("star_a", "star_b", "e1", 2) + ", " + sql.attacks("star_b", "star_a", "e2", 2, "z") + (
    f", rr AS (SELECT {sql.robust('star_a', 'star_b', 'ones', 2)} AS r1, {sql.robust('star_b', 'star_a', 'ones', 2, 'z')} AS r2, {sql.side('star_a', 'none', 'e1', 'ones')} AS s1, {sql.side('star_b', 'none', 'e2', 'ones')} AS s2)"
    ", pa AS (SELECT a.dst AS node, 0.01::DOUBLE AS x FROM star_a s JOIN e1 a ON a.src = s.node UNION ALL SELECT b.dst, 0.0001::DOUBLE FROM star_a s JOIN e1 a ON a.src = s.node JOIN e1 b ON b.src = a.dst WHERE b.dst <> s.node)"
    ", pb AS (SELECT a.dst AS node, 0.01::DOUBLE AS x FROM star_b s JOIN e2 a ON a.src = s.node UNION ALL SELECT b.dst, 0.0001::DOUBLE FROM star_b s JOIN e2 a ON a.src = s.node JOIN e2 b ON b.src = a.dst WHERE b.dst <> s.node)"
    ", jp AS (SELECT n.node, CASE WHEN n.node IN (SELECT node FROM star_a) THEN 1 ELSE least(1, coalesce((SELECT sum(x) FROM pa WHERE pa.node = n.node), 0)) END AS p1, CASE WHEN n.node IN (SELECT node FROM star_b) THEN 1 ELSE least(1, coalesce((SELECT sum(x) FROM pb WHERE pb.node = n.node), 0)) END AS p2 FROM nodes n)"
)


@register(sql.query("SELECT round(r1, 6) AS r1, round(r2, 6) AS r2, round((SELECT sum(1 - (1 - p1) * (1 - p2)) FROM jp) / (s1 + s2 + 1e-12) * 2 * r1 * r2 / (r1 + r2 + 1e-12), 6) AS r_cr FROM rr", _RCR))
def r_cr_k2(x: Layers) -> DataFrame:
    a, b = x.stars()
    rows = attack.synergy(a, b, x.nodes, stored(_arcs(x)), stored(graph.symmetric(x.l2)), steps=2)
    return _r6(rows, "r1", "r2", "r_cr")


@register(sql.query("SELECT node, round(w, 9) AS w FROM alpha1"))
def alpha_weights(x: Layers) -> DataFrame:
    return centrality.alpha(x.nodes, _arcs(x)).select("node", F.round("w", 9).alias("w"))


def _ranks(source: str, value: str, name: str) -> str:
    return f"{name} AS (SELECT id, rank() OVER (ORDER BY {value}) + (count(*) OVER (PARTITION BY {value}) - 1) / 2.0::DOUBLE AS r FROM {source})"


@register(sql.query("SELECT round(corr(a.r, b.r), 6) AS rho FROM ra a JOIN rb2 b USING (id)", "dd AS (SELECT d.node AS id, d.deg::DOUBLE AS deg, round(a.w, 12) AS w FROM d1 d JOIN alpha1 a USING (node)), " + _ranks("dd", "deg", "ra") + ", " + _ranks("dd", "w", "rb2")))
def alpha_degree_spearman(x: Layers) -> DataFrame:
    a = _arcs(x)
    rows = graph.degree(x.nodes, a).join(centrality.alpha(x.nodes, a), "node").select(F.col("node").alias("id"), "deg", F.round("w", 12).alias("w"))
    return _r6(ranking.spearman(rows, "deg", "w"), "rho")


# --- similarity and losses -------------------------------------------------


def _sides(x: Layers) -> tuple[DataFrame, DataFrame]:
    e = x.table("embeddings").select(F.floor(F.col("vec_id") / 2).alias("idx"), F.col("embedding").alias("z"), "label", (F.col("vec_id") % 2).alias("side"))
    return e.filter("side = 0").drop("side"), e.filter("side = 1").drop("side")


@register(sql.query("SELECT a, b, round(sim, 6) AS sim, rank FROM (SELECT *, (row_number() OVER (PARTITION BY a ORDER BY sim DESC, b))::INT AS rank FROM sims) WHERE rank <= 3"))
def s_align_topk(x: Layers) -> DataFrame:
    return _r6(blocks.best_of_each(*_sides(x), 3), "sim")


@register(sql.query("SELECT a, b, round(sim, 6) AS sim, rank FROM (SELECT *, (row_number() OVER (PARTITION BY a ORDER BY sim DESC, b))::INT AS rank FROM sims) WHERE rank <= 2"))
def s_align_topk_blocks(x: Layers) -> DataFrame:
    return _r6(blocks.best_of_each(*_sides(x), 2), "sim")


@register(sql.query("SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS r FROM sims) WHERE r = 1"))
def gene_translation(x: Layers) -> DataFrame:
    return similarity.translation(*_sides(x))


@register(sql.query("SELECT a, b, round(sim, 6) AS sim, rank FROM (SELECT a.idx AS a, b.idx AS b, list_cosine_similarity(a.z, b.z) AS sim, (row_number() OVER (PARTITION BY a.idx ORDER BY list_cosine_similarity(a.z, b.z) DESC, b.idx))::INT AS rank FROM emb_a a JOIN emb_a b ON a.idx <> b.idx) WHERE rank <= 5"))
def knn_cosine(x: Layers) -> DataFrame:
    return _r6(similarity.knn(_sides(x)[0], 5), "sim")


_TOPS = "ta AS (SELECT a, b, sim, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS r FROM sims), tb AS (SELECT a, b, sim, row_number() OVER (PARTITION BY b ORDER BY sim DESC, a) AS r FROM sims)"


@register(sql.query("SELECT round((SELECT avg(CASE WHEN tb.r <= 5 THEN 1.0::DOUBLE ELSE 0 END) FROM ta JOIN tb USING (a, b) WHERE ta.r = 1), 6) AS mutual_rate, round((SELECT avg(sim) FROM ta WHERE r = 1), 6) AS mean_top1, round((SELECT avg(sim) FROM ta WHERE r <= 5), 6) AS mean_topk", _TOPS))
def mutual_knn(x: Layers) -> DataFrame:
    return _r6(similarity.mutual(*_sides(x), 5), "mutual_rate", "mean_top1", "mean_topk")


@register(sql.query("SELECT round((SELECT count(*) FROM ta WHERE a = b AND r <= 10) / (SELECT count(DISTINCT a) FROM ta)::DOUBLE, 6) AS recall", _TOPS))
def topk_recall(x: Layers) -> DataFrame:
    return _r6(similarity.recall(*_sides(x), 10), "recall")


def _side_weights(side: DataFrame) -> DataFrame:
    total = side.agg(F.sum(F.col("label") + 1).cast("double").alias("t"))
    return side.crossJoin(total).select("idx", ((F.col("label") + 1) / F.col("t")).alias("w"))


def _mmd(a: str, wa: str, b: str, wb: str) -> str:
    k = " + ".join(f"exp(-d2 / {2 * s * s}::DOUBLE)" for s in losses.SIGMAS)
    return f"(SELECT sum(u * v * ({k}) / 5) FROM (SELECT p.w AS u, q.w AS v, pow(list_distance(x.z, y.z), 2) AS d2 FROM {a} x JOIN {wa} p ON p.idx = x.idx, {b} y JOIN {wb} q ON q.idx = y.idx))"


@register(sql.query(f"SELECT round({_mmd('emb_a', 'w_a', 'emb_a', 'w_a')} + {_mmd('emb_b', 'w_b', 'emb_b', 'w_b')} - 2 * {_mmd('emb_a', 'w_a', 'emb_b', 'w_b')}, 6) AS ammd"))
def ammd(x: Layers) -> DataFrame:
    a, b = _sides(x)
    return _r6(losses.weighted_discrepancy(a.drop("label"), _side_weights(a), b.drop("label"), _side_weights(b)), "ammd")


@register(sql.query("SELECT round(((SELECT avg(l - p) FROM (SELECT ln(sum(exp(sim / 0.1::DOUBLE))) AS l, max(CASE WHEN a = b THEN sim / 0.1::DOUBLE END) AS p FROM sims GROUP BY a)) + (SELECT avg(l - p) FROM (SELECT ln(sum(exp(sim / 0.1::DOUBLE))) AS l, max(CASE WHEN a = b THEN sim / 0.1::DOUBLE END) AS p FROM sims GROUP BY b))) / 2, 6) AS loss"))
def infonce_id(x: Layers) -> DataFrame:
    return _r6(losses.info_nce(*(s.drop("label") for s in _sides(x))), "loss")


_REC = (
    "pr AS (SELECT u, v, 1 AS y FROM l1 WHERE u IN (SELECT idx FROM emb_a) AND v IN (SELECT idx FROM emb_a) UNION ALL SELECT a.idx, b.idx, 0 FROM emb_a a JOIN emb_a b ON b.idx = (a.idx * 7 + 3) % (SELECT count(*) FROM emb_a) WHERE a.idx <> b.idx)"
    ", dg AS (SELECT y, u AS node, count(*) AS d FROM pr GROUP BY y, u)"
    ", lg AS (SELECT pr.y, 5 * list_cosine_similarity(p.z, q.z) AS x, 1 / sqrt((coalesce(du.d, 0) + 1.0::DOUBLE) * (coalesce(dv.d, 0) + 1)) AS w FROM pr JOIN emb_a p ON p.idx = pr.u JOIN emb_a q ON q.idx = pr.v LEFT JOIN dg du ON du.node = pr.u AND du.y = pr.y LEFT JOIN dg dv ON dv.node = pr.v AND dv.y = pr.y)"
)


@register(sql.query("SELECT round(sum(l), 6) AS loss FROM (SELECT avg(w * (greatest(x, 0) - x * y + ln(1 + exp(-abs(x))))) AS l FROM lg GROUP BY y)", _REC))
def recon_bce(x: Layers) -> DataFrame:
    """Every edge whose two ends have a vector, against as many pairs as there are vectors."""
    a = _sides(x)[0].drop("label")
    ids = a.select("idx")
    near = x.l1.join(ids.withColumnRenamed("idx", "u"), "u", "left_semi").join(ids.withColumnRenamed("idx", "v"), "v", "left_semi").select("u", "v", F.lit(1).alias("y"))
    far = a.crossJoin(a.agg(F.count("*").alias("n"))).select(F.col("idx").alias("u"), ((F.col("idx") * 7 + 3) % F.col("n")).alias("v"), F.lit(0).alias("y")).filter("u <> v")
    return _r6(losses.reconstruction(near.unionByName(far), a), "loss")


@register(sql.query("SELECT round(greatest((SELECT avg(sim) FROM hs WHERE n = 1) - (SELECT avg(sim) FROM hs WHERE n = 2) + 0.2::DOUBLE, 0), 6) AS loss", "hs AS (SELECT s.sim, (a.label >= 7)::INT + (b.label >= 7)::INT AS n FROM sims s JOIN emb_a a ON a.idx = s.a JOIN emb_b b ON b.idx = s.b)"))
def hub_preserving(x: Layers) -> DataFrame:
    a, b = _sides(x)
    return _r6(losses.hub_margin(a, b, a.filter("label >= 7"), b.filter("label >= 7")), "loss")


@register(
    sql.query(
        "SELECT round(sum(p.m * q.m) / sqrt(sum(p.m * p.m) * sum(q.m * q.m)), 6) AS sim FROM (SELECT k, avg(v) AS m FROM (SELECT unnest(z) AS v, unnest(range(0, 64)) AS k FROM emb_a WHERE label >= 7) GROUP BY k) p JOIN (SELECT k, avg(v) AS m FROM (SELECT unnest(z) AS v, unnest(range(0, 64)) AS k FROM emb_b WHERE label >= 7) GROUP BY k) q USING (k)"
    )
)
def hub_centroid_similarity(x: Layers) -> DataFrame:
    a, b = _sides(x)
    return _r6(losses.centroid_similarity(a, b, a.filter("label >= 7"), b.filter("label >= 7")), "sim")


_NR = "na AS (SELECT idx AS a, (row_number() OVER (ORDER BY w DESC, idx) - 1) / (count(*) OVER () - 1)::DOUBLE AS r FROM w_a), nb AS (SELECT idx AS b, (row_number() OVER (ORDER BY w DESC, idx) - 1) / (count(*) OVER () - 1)::DOUBLE AS r FROM w_b)"


@register(sql.query("SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY abs(na.r - nb.r), b) AS k FROM na, nb) WHERE k = 1", _NR))
def role_alpha_match(x: Layers) -> DataFrame:
    a, b = _sides(x)
    return losses.rank_matches(_side_weights(a), _side_weights(b))


@register(
    sql.query(
        "SELECT bin, pos, round(sum(w * v) / sum(w), 6) AS value FROM (SELECT b.bin, b.w, unnest(e.z) AS v, (unnest(range(0, 64)))::INT AS pos FROM bn b JOIN emb_a e USING (idx)) GROUP BY bin, pos",
        "bn AS (SELECT idx, w, least((row_number() OVER (ORDER BY w DESC, idx) - 1) // ((SELECT count(*) FROM w_a) // 4), 3) AS bin FROM w_a)",
    )
)
def role_prototype(x: Layers) -> DataFrame:
    a = _sides(x)[0]
    return _r6(losses.prototypes(a.drop("label"), _side_weights(a), 4), "value")


# --- ranking, normalisation, metrics ---------------------------------------


def _scored(x: Layers) -> DataFrame:
    docs = x.table("documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return docs.join(x.table("labels").select("doc_id", F.col("quality").alias("y")), "doc_id").withColumnRenamed("doc_id", "id")


def _values(x: Layers) -> DataFrame:
    return x.table("events").select(F.col("event_id").alias("id"), F.col("value").alias("x"))


@register(sql.query("SELECT round((sum(CASE WHEN y = 1 THEN r END) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM scored JOIN sr USING (id)", _ranks("scored", "score", "sr")))
def auc(x: Layers) -> DataFrame:
    return _r6(ranking.auc(_scored(x)), "auc")


@register(sql.query("SELECT round(sum(CASE WHEN y = 1 THEN hits / pos::DOUBLE ELSE 0 END) / sum(y), 6) AS ap FROM (SELECT y, sum(y) OVER w AS hits, row_number() OVER w AS pos FROM scored WINDOW w AS (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING))"))
def average_precision(x: Layers) -> DataFrame:
    return _r6(ranking.average_precision(_scored(x)), "ap")


@register(sql.query("SELECT round(avg(y), 6) AS precision FROM (SELECT y FROM scored ORDER BY score DESC, id LIMIT 50)"))
def precision_at_k(x: Layers) -> DataFrame:
    return _r6(ranking.precision_at(_scored(x), 50), "precision")


@register(sql.query("SELECT round(corr(a.r, b.r), 6) AS rho FROM qa a JOIN qb b USING (id)", "pt AS (SELECT p_partkey AS id, p_size, p_retailprice FROM part), " + _ranks("pt", "p_size", "qa") + ", " + _ranks("pt", "p_retailprice", "qb")))
def spearman(x: Layers) -> DataFrame:
    return _r6(ranking.spearman(x.table("part").select(F.col("p_partkey").alias("id"), "p_size", "p_retailprice"), "p_size", "p_retailprice"), "rho")


@register(sql.query("SELECT id, round((x - (SELECT min(x) FROM vals)) / (SELECT max(x) - min(x) FROM vals), 6) AS y FROM vals"))
def minmax_norm(x: Layers) -> DataFrame:
    return _r6(ranking.minmax(_values(x)), "y").select("id", "y")


@register(sql.query("SELECT id, round((x - (SELECT avg(x) FROM vals)) / ((SELECT stddev_pop(x) FROM vals) + 1e-8::DOUBLE), 6) AS y FROM vals"))
def zscore_norm(x: Layers) -> DataFrame:
    return _r6(ranking.zscore(_values(x)), "y").select("id", "y")


@register(sql.query("SELECT id, round((x - m) / ((SELECT median(abs(x - m)) FROM vals, md) + 1e-8::DOUBLE), 6) AS y FROM vals, md", "md AS (SELECT median(x) AS m FROM vals)"))
def robust_norm(x: Layers) -> DataFrame:
    return _r6(ranking.robust_score(_values(x)), "y").select("id", "y")


@register(sql.query("SELECT id, round((q - (SELECT min(q) FROM qs)) / (SELECT max(q) - min(q) FROM qs), 6) AS y FROM qs", "qs AS (SELECT id, pow(row_number() OVER (ORDER BY x DESC, id), -0.1::DOUBLE) AS q FROM vals)"))
def quantile_rank_norm(x: Layers) -> DataFrame:
    return _r6(ranking.quantile_scores(_values(x)), "y").select("id", "y")


@register(sql.query("SELECT round(avg(x), 5) AS mean, round(stddev_pop(x), 5) AS std, round(min(x), 5) AS min, round(max(x), 5) AS max, round(median(x), 5) AS median, round(avg((x = 0)::INT), 5) AS zero_ratio FROM vals"))
def tensor_stats(x: Layers) -> DataFrame:
    return ranking.statistics(_values(x))


@register(sql.query("SELECT id, least((row_number() OVER (ORDER BY x DESC, id) - 1) // ((SELECT count(*) FROM vals) // 7), 6) AS bin FROM vals"))
def equal_frequency_bins(x: Layers) -> DataFrame:
    return ranking.equal_bins(_values(x), "x", 7).select("id", "bin")


_POP = "cand AS (SELECT p_partkey AS id, p_size::DOUBLE AS t1, p_retailprice AS t2, (p_partkey * 37 % 101)::DOUBLE AS t3 FROM part), rk AS (SELECT *, row_number() OVER (ORDER BY t1 DESC, id) AS r1, row_number() OVER (ORDER BY t2 DESC, id) AS r2, row_number() OVER (ORDER BY t3 DESC, id) AS r3 FROM cand), sk AS (SELECT id, t1, t2, t3, r1, r2, r3, (CASE WHEN r1 <= r2 AND r1 <= r3 THEN 1 WHEN r2 <= r3 THEN 2 ELSE 3 END)::INT AS skill, 1.0::DOUBLE / least(r1, r2, r3) AS fitness, CASE WHEN r1 <= r2 AND r1 <= r3 THEN t1 WHEN r2 <= r3 THEN t2 ELSE t3 END AS cost FROM rk)"


def _candidates(x: Layers) -> DataFrame:
    """Parts as candidates."""
    p = x.table("part")
    rows = p.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("t1"), F.col("p_retailprice").alias("t2"), (F.col("p_partkey") * 37 % 101).cast("double").alias("t3"))
    rows = ranking.skill_factors(rows, evolve.TASKS)
    cost = F.when(F.col("skill") == 1, F.col("t1")).when(F.col("skill") == 2, F.col("t2")).otherwise(F.col("t3"))
    return rows.withColumn("cost", cost)


@register(sql.query("SELECT id, r1 AS rank_t1, r2 AS rank_t2, r3 AS rank_t3 FROM sk", _POP))
def factorial_ranks(x: Layers) -> DataFrame:
    return _candidates(x).select("id", "rank_t1", "rank_t2", "rank_t3")


@register(sql.query("SELECT id, skill, round(fitness, 6) AS fitness FROM sk", _POP))
def skill_factor(x: Layers) -> DataFrame:
    return _r6(_candidates(x).select("id", "skill", "fitness"), "fitness")


@register(sql.query("SELECT skill, count(*) AS n, round(avg(fitness), 6) AS mean_fitness, round(max(fitness), 6) AS max_fitness FROM sk GROUP BY skill", _POP))
def population_stats(x: Layers) -> DataFrame:
    rows = _candidates(x).groupBy("skill").agg(F.count("*").alias("n"), F.avg("fitness").alias("mean_fitness"), F.max("fitness").alias("max_fitness"))
    return _r6(rows, "mean_fitness", "max_fitness")


@register(
    sql.query(
        "SELECT id, tier, pos FROM (SELECT id, tier, row_number() OVER (ORDER BY tier, fitness DESC, id) AS pos FROM ti) WHERE pos <= 30",
        _POP + ", el AS (SELECT *, (row_number() OVER (PARTITION BY skill ORDER BY cost DESC, id) <= 1)::INT AS el FROM sk), ti AS (SELECT *, CASE WHEN el = 1 THEN 0 WHEN row_number() OVER (PARTITION BY skill ORDER BY el DESC, fitness DESC, id) <= 5 THEN 1 ELSE 2 END AS tier FROM el)",
    )
)
def survival_selection(x: Layers) -> DataFrame:
    return ranking.survival(_candidates(x), 30).select("id", "tier", "pos")


@register(sql.query("SELECT id, skill FROM (SELECT id, skill, row_number() OVER (PARTITION BY skill ORDER BY cost DESC, id) AS r FROM sk) WHERE r <= 2", _POP))
def elite_per_task(x: Layers) -> DataFrame:
    return search.elite(_candidates(x), 2).select("id", "skill")


# --- populations and search ------------------------------------------------


def _sample_sql(weights: str, purpose: str, n: int, k: int, name: str) -> str:
    u = sql.uniform(f"'{purpose}'", "i.id", "w.node")
    return f"{name} AS (SELECT id, list(node ORDER BY rn) AS seeds FROM (SELECT i.id, w.node, row_number() OVER (PARTITION BY i.id ORDER BY ln(greatest({u}, 1e-12::DOUBLE)) / w.w DESC, w.node) AS rn FROM range(0, {n}) i(id), {weights} w WHERE w.w > 0) WHERE rn <= {k} GROUP BY id)"


def _sampled(weights: str, purpose: str) -> str:
    return sql.query("SELECT id, array_to_string(seeds, ',') AS seeds FROM sm", _sample_sql(weights, purpose, 8, 5, "sm"))


def _joined(df: DataFrame) -> DataFrame:
    return df.select("id", F.array_join("seeds", ",").alias("seeds"))


@register(_sampled("alpha1", "elite"))
def init_elite(x: Layers) -> DataFrame:
    return _joined(evolve.sample(x.spark, 8, centrality.alpha(x.nodes, _arcs(x)), 5, "elite"))


@register(sql.query("SELECT id, array_to_string(seeds, ',') AS seeds FROM sm", _ROBUST + ", rw AS (SELECT node, raw / (SELECT sum(raw) FROM rb) AS w FROM rb), " + _sample_sql("rw", "robust", 8, 5, "sm")))
def init_robust(x: Layers) -> DataFrame:
    return _joined(evolve.sample(x.spark, 8, centrality.robustness(x.nodes, x.l1).withColumnRenamed("score", "w"), 5, "robust"))


@register(_sampled("ones", "random"))
def init_random(x: Layers) -> DataFrame:
    return _joined(evolve.sample(x.spark, 8, x.nodes.select("node", F.lit(1.0).alias("w")), 5, "random"))


@register(sql.query("SELECT a, b, round(sim, 6) AS sim FROM sims ORDER BY sims.sim DESC, a, b LIMIT 150"))
def aligned_pairs(x: Layers) -> DataFrame:
    return _r6(blocks.best_pairs(*_sides(x), 150), "sim")


@register(
    sql.query(
        "SELECT c.id AS pair_id, array_to_string(list_concat(c.seeds[1:ct], d.seeds[ct + 1:]), ',') AS raw1, array_to_string(list_concat(d.seeds[1:ct], c.seeds[ct + 1:]), ',') AS raw2 FROM (SELECT id, (floor(" + sql.uniform("'cut:l1'", "id") + " * 4) + 1)::INT AS ct, seeds FROM sm) c JOIN sm2 d USING (id)",
        _sample_sql("alpha1", "x", 16, 5, "sm") + ", " + _sample_sql("ones", "y", 16, 5, "sm2"),
    )
)
def crossover_single_point(x: Layers) -> DataFrame:
    a = evolve.sample(x.spark, 16, centrality.alpha(x.nodes, _arcs(x)), 5, "x").select(F.col("id").alias("pair_id"), F.col("seeds").alias("x"))
    b = evolve.sample(x.spark, 16, x.nodes.select("node", F.lit(1.0).alias("w")), 5, "y").select(F.col("id").alias("pair_id"), F.col("seeds").alias("y"))
    kids = evolve.single_point(a.join(b, "pair_id"), "l1", 1 << 40, 5)
    return kids.select("pair_id", F.array_join("c1", ",").alias("raw1"), F.array_join("c2", ",").alias("raw2"))


_ROUNDS = (
    "tn AS (SELECT id, fitness, row_number() OVER (ORDER BY id) - 1 AS slot FROM sk), dr AS (SELECT round, n, floor(" + sql.uniform("'t'", "'0'", "round") + " * n)::BIGINT AS one, floor(" + sql.uniform("'t'", "'1'", "round") + " * greatest(n - 1, 1))::BIGINT AS more FROM range(0, 20) r(round), (SELECT count(*) AS n FROM sk))"
)


@register(sql.query("SELECT round, CASE WHEN b.fitness > a.fitness THEN b.id ELSE a.id END AS id FROM dr JOIN tn a ON a.slot = one JOIN tn b ON b.slot = (one + 1 + more) % n", _POP + ", " + _ROUNDS))
def tournament(x: Layers) -> DataFrame:
    return evolve.tournament(_candidates(x), 20, "t")


_GENES = _sample_sql("alpha1", "x", 8, 5, "sm") + ", ge AS (SELECT id, unnest(range(0, 5)) AS pos, unnest(seeds) AS node FROM sm)"
_INJECTED = (
    _GENES + ", " + _sample_sql("alpha1", "y", 8, 5, "sm2") + ", dn AS (SELECT id, unnest(range(0, 5)) AS pos, unnest(seeds) AS node FROM sm2)"
    ", bd AS (SELECT d.id, d.node FROM dn d JOIN alpha1 a USING (node) QUALIFY row_number() OVER (PARTITION BY d.id ORDER BY a.w DESC, d.pos) <= 2)"
    ", ow AS (SELECT g.id, g.node FROM ge g JOIN alpha1 a USING (node) WHERE NOT EXISTS (SELECT 1 FROM bd b WHERE b.id = g.id AND b.node = g.node) QUALIFY row_number() OVER (PARTITION BY g.id ORDER BY a.w DESC, g.pos) <= 3)"
)


@register(sql.query("SELECT id, string_agg(node, ',' ORDER BY node) AS seeds FROM (SELECT * FROM bd UNION ALL SELECT * FROM ow) GROUP BY id", _INJECTED))
def gene_injection(x: Layers) -> DataFrame:
    w = centrality.alpha(x.nodes, _arcs(x))
    a = evolve.sample(x.spark, 8, w, 5, "x").withColumnRenamed("seeds", "genes")
    b = evolve.sample(x.spark, 8, w, 5, "y").withColumnRenamed("seeds", "donors")
    return _joined(evolve.inject(a.join(b, "id"), w, 2))


_MUTATED = (
    _GENES + ", ld AS (SELECT node, w, sum(w) OVER (ORDER BY node ROWS UNBOUNDED PRECEDING) AS hi FROM alpha1), ht AS (SELECT *, " + sql.uniform("'m:node'", "id", "pos") + " * (SELECT sum(w) FROM alpha1) AS x FROM ge WHERE " + sql.uniform("'m:hit'", "id", "pos") + " < 0.3::DOUBLE)"
    ", nw AS (SELECT h.id, l.node AS new, min(h.pos) AS pos FROM ht h JOIN ld l ON h.x >= l.hi - l.w AND h.x < l.hi WHERE NOT EXISTS (SELECT 1 FROM ge g WHERE g.id = h.id AND g.node = l.node) GROUP BY ALL)"
)


@register(sql.query("SELECT g.id, string_agg(coalesce(n.new, g.node), ',' ORDER BY g.pos) AS seeds FROM ge g LEFT JOIN nw n ON n.id = g.id AND n.pos = g.pos GROUP BY g.id", _MUTATED))
def mutation(x: Layers) -> DataFrame:
    w = centrality.alpha(x.nodes, _arcs(x))
    return _joined(evolve.mutate(evolve.sample(x.spark, 8, w, 5, "x").withColumnRenamed("seeds", "genes"), w, 0.3, "m"))


_GAIN = "zn AS (SELECT src, dst FROM h2 UNION ALL SELECT node, node FROM nodes), zo AS (SELECT DISTINCT dst FROM zn WHERE src IN (SELECT node FROM star_b)), zm AS (SELECT DISTINCT dst FROM zn WHERE src IN (SELECT node FROM star_a)), gn AS (SELECT z.src AS node, max(p.potential) * max(a.w) * (1 - 0.5::DOUBLE * count(o.dst) / count(*) - 0.3::DOUBLE * count(m.dst) / count(*)) AS gain FROM zn z LEFT JOIN zo o ON o.dst = z.dst LEFT JOIN zm m ON m.dst = z.dst JOIN pot1 p ON p.node = z.src JOIN alpha1 a ON a.node = z.src WHERE z.src NOT IN (SELECT node FROM star_a) GROUP BY z.src)"


def _gain(x: Layers) -> DataFrame:
    a = _arcs(x)
    return search.marginal_gain(x.nodes, a, influence.potential(x.nodes, a), centrality.alpha(x.nodes, a), *x.stars())


@register(sql.query("SELECT node, round(gain, 9) AS gain FROM gn", _GAIN))
def marginal_gain_competition(x: Layers) -> DataFrame:
    return _gain(x).select("node", F.round("gain", 9).alias("gain"))


@register(sql.query("SELECT round(sum(p.potential * a.w), 9) AS performance FROM zm JOIN pot1 p ON p.node = zm.dst JOIN alpha1 a ON a.node = zm.dst", _GAIN))
def layer_performance(x: Layers) -> DataFrame:
    a = _arcs(x)
    out = search.layer_performance(x.nodes, a, influence.potential(x.nodes, a), centrality.alpha(x.nodes, a), x.stars()[0])
    return out.select(F.round("performance", 9).alias("performance"))


@register(sql.query("SELECT o.node AS out_node, i.node AS in_node, round(i.gain - o.value, 9) AS delta FROM (SELECT s.node, p.potential * a.w AS value FROM star_a s JOIN pot1 p USING (node) JOIN alpha1 a USING (node) ORDER BY value, s.node LIMIT 1) o, (SELECT node, gain FROM gn ORDER BY gain DESC, node LIMIT 1) i", _GAIN))
def best_swap(x: Layers) -> DataFrame:
    a = _arcs(x)
    values = influence.potential(x.nodes, a).join(centrality.alpha(x.nodes, a), "node").select("node", (F.col("potential") * F.col("w")).alias("value"))
    return search.best_swap(x.stars()[0], _gain(x), values).select("out_node", "in_node", F.round("delta", 9).alias("delta"))


def _greedy_sql(k: int) -> str:
    out = ["zw AS (SELECT z.src, z.dst, a.w FROM (SELECT src, dst FROM h2 UNION ALL SELECT node, node FROM nodes) z JOIN alpha1 a ON a.node = z.dst), ch0 AS (SELECT 0 AS pos, node, 0.0::DOUBLE AS gain FROM none)"]
    for i in range(1, k + 1):
        out.append(f"cv{i} AS (SELECT DISTINCT dst FROM zw WHERE src IN (SELECT node FROM ch{i - 1}))")
        out.append(f"bs{i} AS (SELECT src AS node, sum(w) AS gain FROM zw WHERE dst NOT IN (SELECT dst FROM cv{i}) AND src NOT IN (SELECT node FROM ch{i - 1}) GROUP BY src ORDER BY gain DESC, src LIMIT 1)")
        out.append(f"ch{i} AS (SELECT * FROM ch{i - 1} UNION ALL SELECT {i}, node, gain FROM bs{i})")
    return ", ".join(out)


@register(sql.query("SELECT pos, node, round(gain, 8) AS gain FROM ch3", _greedy_sql(3)))
def greedy_construction_k3(x: Layers) -> DataFrame:
    a = _arcs(x).cache()
    return search.greedy(x.nodes, a, centrality.alpha(x.nodes, a), 3).select("pos", "node", F.round("gain", 8).alias("gain"))


def _least(x: Layers) -> int:
    return x.nodes.agg(F.min("node")).collect()[0][0]


@register()
def task_scores_population_k3(x: Layers) -> DataFrame:
    w = x.nodes.select("node", F.lit(1.0).alias("w"))
    pop = evolve.population(x.spark, 8, w, w, 5, 5)
    return evolve.evaluate(pop, _arcs(x), graph.symmetric(x.l2), _least(x), 0.01, 3)


@register()
def evolve_3gen(x: Layers) -> DataFrame:
    a, b = _arcs(x), graph.symmetric(x.l2)
    return evolve.search(x.spark, x.nodes.count(), a, b, centrality.alpha(x.nodes, a), centrality.alpha(x.nodes, b))


# --- walks, cascades, generators -------------------------------------------


def _walk_sql(length: int) -> str:
    out = ["nb AS (SELECT src, list(dst ORDER BY dst) AS n FROM e1 GROUP BY src), wk0 AS (SELECT node AS start, w::INT AS walk, [node] AS path, node AS at FROM nodes, range(0, 2) t(w))"]
    for i in range(1, length):
        u = sql.uniform("'walk'", "k.start", "k.walk", f"{i}")
        nxt = f"coalesce(nb.n[floor({u} * len(nb.n))::INT + 1], k.at)"
        out.append(f"wk{i} AS (SELECT k.start, k.walk, list_append(k.path, {nxt}) AS path, {nxt} AS at FROM wk{i - 1} k LEFT JOIN nb ON nb.src = k.at)")
    return ", ".join(out)


@register(sql.query("SELECT start, walk, array_to_string(path, ',') AS path FROM wk4", _walk_sql(5)))
def hash_walks(x: Layers) -> DataFrame:
    return walks.walks(x.nodes, _arcs(x), 2, 5).select("start", "walk", F.array_join("path", ",").alias("path"))


@register(sql.query("SELECT start, node, round(n / (max(n) OVER (PARTITION BY start))::DOUBLE, 6) AS freq FROM (SELECT start, node, count(*) AS n FROM (SELECT start, unnest(path) AS node FROM wk4) GROUP BY ALL)", _walk_sql(5)))
def visit_frequency(x: Layers) -> DataFrame:
    return _r6(walks.visits(walks.walks(x.nodes, _arcs(x), 2, 5)), "freq")


@register()
def walk_embedding(x: Layers) -> DataFrame:
    return walks.node_vectors(walks.walks(x.nodes, _arcs(x), 2, 5))


def _cascade_sql(sims: int) -> str:
    parts = []
    for k in (1, 2):
        u = sql.uniform("'ic'", str(k), "c.sim", "e.src", "e.dst")
        parts.append(f"c{k} AS (SELECT s.node, i.sim FROM sa s, range(0, {sims}) i(sim) UNION SELECT e.dst, c.sim FROM c{k} c JOIN e{k} e ON e.src = c.node WHERE {u} < 0.1::DOUBLE)")
    return ", ".join(parts)


@register(sql.query("SELECT round(count(*) / 20.0::DOUBLE, 6) AS spread FROM (SELECT sim, node FROM c1 UNION SELECT sim, node FROM c2)", _cascade_sql(20), recursive=True))
def ic_spread_hash(x: Layers) -> DataFrame:
    return _r6(walks.cascade(x.top_degree(x.l1), {1: _arcs(x), 2: graph.symmetric(x.l2)}, 0.1, 20), "spread")


def _greedy_sql(candidates: str, sims: int, k: int, ties: str) -> str:
    """Every candidate's cascades (rr), then k rounds of the one that adds most (g1 .. gk)."""
    out = []
    for layer in (1, 2):
        u = sql.uniform("'ic'", str(layer), "c.sim", "e.src", "e.dst")
        out.append(f"rc{layer} AS (SELECT s.node AS origin, s.node, i.sim FROM {candidates} s, range(0, {sims}) i(sim) UNION SELECT c.origin, e.dst, c.sim FROM rc{layer} c JOIN e{layer} e ON e.src = c.node WHERE {u} < 0.1::DOUBLE)")
    out.append("rr AS (SELECT sim, origin, node FROM rc1 UNION SELECT sim, origin, node FROM rc2)")
    for i in range(1, k + 1):
        known = " UNION ALL ".join(f"SELECT node FROM g{j}" for j in range(1, i)) or "SELECT node FROM none"
        out.append(f"ch{i} AS ({known}), cv{i} AS (SELECT DISTINCT sim, node FROM rr WHERE origin IN (SELECT node FROM ch{i}))")
        out.append(f"g{i} AS (SELECT origin AS node, count(*) AS n FROM rr ANTI JOIN cv{i} USING (sim, node) WHERE origin NOT IN (SELECT node FROM ch{i}) GROUP BY origin ORDER BY n DESC, origin {ties} LIMIT 1)")
    return ", ".join(out)


def _greedy(candidates: str, sims: int, k: int, ties: str = "ASC") -> str:
    rows = " UNION ALL ".join(f"SELECT {i} AS pos, node, n FROM g{i}" for i in range(1, k + 1))
    return sql.query(f"SELECT pos, node, n / {sims}.0::DOUBLE AS gain, sum(n) OVER (ORDER BY pos) / {sims}.0::DOUBLE AS spread FROM ({rows})", _greedy_sql(candidates, sims, k, ties), recursive=True)


def _both(x: Layers) -> dict[int, DataFrame]:
    return {1: _arcs(x), 2: graph.symmetric(x.l2)}


@register(_greedy("nodes", 10, 2, "DESC"))
def greedy_ic_k2(x: Layers) -> DataFrame:
    return walks.greedy_cascade(x.nodes, _both(x), 0.1, 10, 2, last=True)


@register(_greedy("nodes", 10, 3))
def celf_k3(x: Layers) -> DataFrame:
    """Labels of the first nodes taken: what each adds when it is taken."""
    return walks.greedy_cascade(x.nodes, _both(x), 0.1, 10, 3)


@register(_greedy("sa", 20, 4))
def celf_seed_order_k4(x: Layers) -> DataFrame:
    return walks.greedy_cascade(x.top_degree(x.l1), _both(x), 0.1, 20, 4)


@register()
def one_swap_search(x: Layers) -> DataFrame:
    a, b = ([r["node"] for r in s.orderBy("pos").limit(4).collect()] for s in x.stars())
    few = [r["node"] for r in x.top_degree(x.l2, 6).collect()]
    return search.one_swap(a, b, few, _arcs(x), graph.symmetric(x.l2), _least(x), 0.01, 3)


@register(
    "WITH dr AS (SELECT id, floor(" + sql.uniform("'er:x'", "id") + " * 300)::BIGINT AS x, floor(" + sql.uniform("'er:y'", "id") + " * 300)::BIGINT AS y FROM range(0, 2016) t(id))"
    " SELECT u, v FROM (SELECT least(x, y) AS u, greatest(x, y) AS v, min(id) AS id FROM dr WHERE x <> y GROUP BY ALL ORDER BY id LIMIT 500)"
)
def generate_er(x: Layers) -> DataFrame:
    return generators.random_edges(x.spark, 300, 500)


def _generator(kind: str):
    def f(x: Layers) -> DataFrame:
        return generators.grown(x.spark, kind, 300, 500, 2)

    f.__name__ = {"small_world": "generate_sw", "scale_free": "generate_ba"}.get(kind, f"generate_{kind}")
    register()(f)


for _kind in ("small_world", "scale_free", "hybrid", "community"):
    _generator(_kind)


@register(
    "WITH tk AS (SELECT k::INT AS layer, n AS node FROM range(0, 3) a(k), range(0, 400) b(n) WHERE " + sql.uniform("'cover'", "k", "n") + " < 0.4::DOUBLE)"
    " SELECT layer, node FROM tk UNION ALL SELECT floor(" + sql.uniform("'cover:rest'", "n") + " * 3)::INT, n FROM range(0, 400) b(n) WHERE n NOT IN (SELECT node FROM tk)"
)
def generate_layer_nodes(x: Layers) -> DataFrame:
    return generators.layer_nodes(x.spark, 400, 3, 0.4)
