"""More registered queries: seeds and weights as they come in, samples, evaluation of embeddings, populations, grids and results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocks, centrality, evaluation, evolve, graph, influence, losses, ranking, sampling, search, seeds, similarity, walks
from ..sources import tables
from ..sources.layers import Layers
from . import sql
from .catalogue import _arcs, _candidates, _mmd, _POP, _r6, _REC, _sample_sql, _side_weights, _sides, recon_bce, register

# --- seeds and weights ----------------------------------------------------------

_LISTS = "ls AS (SELECT l_orderkey AS o, list(l_partkey - 20 ORDER BY l_linenumber, l_partkey) AS s FROM lineitem GROUP BY l_orderkey), nn AS (SELECT count(*) - 40 AS n FROM nodes)"


def _lists(x: Layers) -> DataFrame:
    """An order's parts, moved by 20, as a list with ids out of range and repeats."""
    rows = x.table("lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("s"))
    return rows.select("o", F.transform("s", lambda r: r["l_partkey"] - 20).alias("s"))


@register(sql.query("SELECT o, array_to_string(list_filter(s, lambda p: p >= 0 AND p < nn.n), ',') AS seeds FROM ls, nn", _LISTS))
def seed_range_filter(x: Layers) -> DataFrame:
    n = x.nodes.agg((F.count("*") - 40).alias("n"))
    return _lists(x).crossJoin(n).select("o", F.array_join(seeds.in_range(F.col("s"), F.col("n")), ",").alias("seeds"))


@register(sql.query("SELECT o, array_to_string(s[1:2], ',') AS seeds_l1, array_to_string(s[3:4], ',') AS seeds_l2 FROM ls", _LISTS))
def seed_pair_split(x: Layers) -> DataFrame:
    one, two = seeds.split_pair(F.col("s"), 2, 2)
    return _lists(x).select("o", F.array_join(one, ",").alias("seeds_l1"), F.array_join(two, ",").alias("seeds_l2"))


def _pop(x: Layers) -> DataFrame:
    w = centrality.alpha(x.nodes, _arcs(x))
    return evolve.population(x.spark, 8, w, w, 5, 5, "pop")


_TWO = _sample_sql("alpha1", "pop:1", 8, 5, "sm") + ", " + _sample_sql("alpha1", "pop:2", 8, 5, "sm2")


@register(sql.query("SELECT a.id, array_to_string(list_concat(a.seeds, b.seeds), ',') AS genes FROM sm a JOIN sm2 b USING (id)", _TWO))
def flat_genes(x: Layers) -> DataFrame:
    return _pop(x).select("id", F.array_join(seeds.flat(F.col("seeds_l1"), F.col("seeds_l2")), ",").alias("genes"))


@register(sql.query("SELECT 'whole' AS given, node, round(w, 9) AS w FROM alpha1 UNION ALL SELECT 'short', node, 1.0::DOUBLE FROM nodes"))
def alpha_guard(x: Layers) -> DataFrame:
    w = centrality.alpha(x.nodes, _arcs(x))
    rows = seeds.guarded(x.nodes, w).withColumn("given", F.lit("whole")).unionByName(seeds.guarded(x.nodes, w.filter("node > 0")).withColumn("given", F.lit("short")))
    return rows.select("given", "node", F.round("w", 9).alias("w"))


@register(
    sql.query(
        "SELECT node, round(w / (SELECT sum(w) FROM pd), 9) AS w FROM pd",
        "gv AS (SELECT node, deg - 3.0::DOUBLE AS w FROM d1 WHERE node % 3 <> 0), pd AS (SELECT n.node, greatest(coalesce(g.w, (SELECT avg(w) FROM gv)), 0) AS w FROM nodes n LEFT JOIN gv g USING (node))",
    )
)
def alpha_normalised(x: Layers) -> DataFrame:
    given = graph.degree(x.nodes, _arcs(x)).filter("node % 3 <> 0").select("node", (F.col("deg") - 3.0).alias("w"))
    return seeds.normalised(x.nodes, given).select("node", F.round("w", 9).alias("w"))


@register(
    sql.query(
        "SELECT node, (pos - 1)::INT AS pos, round(x[pos], 6) AS value FROM (SELECT node, x, unnest(range(1, 67)) AS pos FROM fr)",
        "fr AS (SELECT c.node, list_concat([CASE WHEN c.deg = 0 THEN 0 ELSE c.deg::DOUBLE END, c.cc], coalesce(e.z, list_transform(range(0, 64), lambda i: 0.0::DOUBLE))) AS x FROM cc1 c LEFT JOIN emb_a e ON e.idx = c.node)",
    )
)
def feature_rows(x: Layers) -> DataFrame:
    first = graph.clustering(x.nodes, x.l1).select("node", F.array(F.when(F.col("deg") == 0, float("nan")).otherwise(F.col("deg").cast("double")), "cc").alias("x"))
    second = _sides(x)[0].select(F.col("idx").alias("node"), F.col("z").alias("x"))
    return _r6(seeds.feature_rows(x.nodes, [(first, 2), (second, 64)]).select("node", F.posexplode("x").alias("pos", "value")), "value")


# --- attacks and scores -----------------------------------------------------------


@register(sql.query("SELECT node, deg::DOUBLE AS score FROM d1"))
def node_attack_scores_degree(x: Layers) -> DataFrame:
    return influence.attack_scores(*x.stars(), x.nodes, _arcs(x), "degree")


@register(sql.query("SELECT node, floor(" + sql.uniform("'attack'", "node") + " * (SELECT count(*) FROM nodes))::DOUBLE AS score FROM nodes"))
def node_attack_scores_random(x: Layers) -> DataFrame:
    return influence.attack_scores(*x.stars(), x.nodes, _arcs(x), "random")


def _degree_attacks_sql(steps: int) -> str:
    out = ["dg0 AS (SELECT node FROM none)"]
    for i in range(1, steps + 1):
        before = f"dg{i - 1}"
        out.append(f"dv{i} AS (SELECT n.node, count(e.dst) AS deg FROM nodes n LEFT JOIN (SELECT * FROM e1 WHERE dst NOT IN (SELECT node FROM {before})) e ON e.src = n.node WHERE n.node NOT IN (SELECT node FROM {before}) GROUP BY n.node)")
        out.append(f"dg{i} AS (SELECT node FROM {before} UNION ALL (SELECT node FROM dv{i} ORDER BY deg DESC, node LIMIT 1))")
        out.append(f"dm{i} AS (SELECT node FROM sb UNION SELECT dst FROM e1 WHERE src IN (SELECT node FROM sb) AND src NOT IN (SELECT node FROM dg{i}) AND dst NOT IN (SELECT node FROM dg{i}))")
    return ", ".join(out)


@register(sql.query("SELECT (" + " + ".join(f"(SELECT count(*) FROM dm{i})" for i in range(1, 5)) + ") / 4.0::DOUBLE AS influence", _degree_attacks_sql(4)))
def degree_attacks_k4(x: Layers) -> DataFrame:
    return influence.degree_attacks(x.top_degree(x.l2), x.nodes, _arcs(x), 4)


@register(
    sql.query(
        "SELECT node, round(raw / (SELECT sum(raw) FROM wr), 9) AS score FROM wr",
        "wr AS (SELECT c.node, (0.5::DOUBLE * v.coverage / (SELECT count(*) FROM nodes) + 0.3::DOUBLE * c.cc + 0.2::DOUBLE * c.deg / ((SELECT count(*) FROM nodes) - 1)) * a.w AS raw FROM cc1 c JOIN cov1 v USING (node) JOIN alpha1 a USING (node))",
    )
)
def robustness_weighted(x: Layers) -> DataFrame:
    rows = centrality.weighted_robustness(x.nodes, x.l1, centrality.alpha(x.nodes, _arcs(x)))
    return rows.select("node", F.round("score", 9).alias("score"))


# --- walks ----------------------------------------------------------------------------


def _biased_sql(length: int, back: float, out: float) -> str:
    parts = ["bw0 AS (SELECT node AS start, w::INT AS walk, [node] AS path, NULL::BIGINT AS before, node AS at FROM nodes, range(0, 2) t(w))"]
    for i in range(1, length):
        u = sql.uniform("'biased'", "k.start", "k.walk", f"{i}", "e.dst")
        weight = f"CASE WHEN k.before IS NULL THEN 1.0::DOUBLE WHEN e.dst = k.before THEN {1 / back}::DOUBLE WHEN c.src IS NOT NULL THEN 1.0::DOUBLE ELSE {1 / out}::DOUBLE END"
        parts.append(f"bs{i} AS (SELECT k.start, k.walk, e.dst FROM bw{i - 1} k JOIN e1 e ON e.src = k.at LEFT JOIN e1 c ON c.src = e.dst AND c.dst = k.before QUALIFY row_number() OVER (PARTITION BY k.start, k.walk ORDER BY ln(greatest({u}, 1e-12::DOUBLE)) / {weight} DESC, e.dst) = 1)")
        parts.append(f"bw{i} AS (SELECT k.start, k.walk, list_append(k.path, coalesce(s.dst, k.at)) AS path, k.at AS before, coalesce(s.dst, k.at) AS at FROM bw{i - 1} k LEFT JOIN bs{i} s USING (start, walk))")
    return ", ".join(parts)


@register(sql.query("SELECT start, walk, array_to_string(path, ',') AS path FROM bw4", _biased_sql(5, 0.5, 2.0)))
def biased_walks(x: Layers) -> DataFrame:
    return walks.biased_walks(x.nodes, _arcs(x), 2, 5, 0.5, 2.0).select("start", "walk", F.array_join("path", ",").alias("path"))


# --- samples ------------------------------------------------------------------------------


def _drawn_sql(name: str, purpose: str, n: str, m: str, without: str | None = None, draws: str | None = None) -> str:
    u = [f"floor({sql.uniform(repr(f'{purpose}:{c}'), 'i.id')} * {n})::BIGINT" for c in "xy"]
    skip = f" ANTI JOIN {without} w ON w.u = least(x, y) AND w.v = greatest(x, y)" if without else ""
    return f"{name} AS (SELECT least(x, y) AS u, greatest(x, y) AS v FROM (SELECT id, {u[0]} AS x, {u[1]} AS y FROM range(0, {draws or f'4 * ({m}) + 16'}) i(id)){skip} WHERE x <> y GROUP BY ALL ORDER BY min(id) LIMIT {m})"


@register(sql.query("SELECT u, v FROM np", _drawn_sql("np", "negative", "(SELECT count(*) FROM nodes)", "500", "l1")))
def negative_pairs(x: Layers) -> DataFrame:
    return sampling.drawn_pairs(x.spark, x.nodes.count(), 500, "negative", x.l1)


@register(
    sql.query(
        "SELECT d.id, a.src AS u, b.dst AS w FROM dr d JOIN ra a ON a.slot = d.slot JOIN fs f ON f.v = a.dst JOIN ra b ON b.slot = f.lo + floor(" + sql.uniform("'two:end'", "d.id") + " * f.deg)::BIGINT WHERE b.dst <> a.src",
        "ra AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) AS slot FROM e1), fs AS (SELECT src AS v, min(slot) AS lo, count(*) AS deg FROM ra GROUP BY src), dr AS (SELECT id, floor(" + sql.uniform("'two:arc'", "id") + " * (SELECT count(*) FROM e1))::BIGINT + 1 AS slot FROM range(0, 400) i(id))",
    )
)
def two_arc_pairs(x: Layers) -> DataFrame:
    return sampling.two_arc_pairs(_arcs(x), 400, "two")


@register(sql.query("SELECT idx, round(w, 9) AS w FROM w_a ORDER BY w_a.w DESC, idx LIMIT 100"))
def sample_cap_topk(x: Layers) -> DataFrame:
    return sampling.capped(_side_weights(_sides(x)[0]), 100).select("idx", F.round("w", 9).alias("w"))


@register(sql.query("SELECT idx, round(w, 9) AS w FROM w_a ORDER BY ln(greatest(" + sql.uniform("'cap'", "idx") + ", 1e-12::DOUBLE)) / w_a.w DESC, idx LIMIT 100"))
def sample_cap_weighted(x: Layers) -> DataFrame:
    return sampling.capped(_side_weights(_sides(x)[0]), 100, "weighted").select("idx", F.round("w", 9).alias("w"))


def _ends_sql(ratio: float, least: int, most: int | None = None) -> str:
    k = f"greatest({least}, floor((SELECT count(*) FROM w_a) * {ratio}::DOUBLE)::BIGINT)"
    k = f"least({most}, {k})" if most else k
    each = lambda s: (
        f"hub_{s} AS (SELECT idx FROM w_{s} QUALIFY row_number() OVER (ORDER BY w DESC, idx) <= {k}), per_{s} AS (SELECT idx FROM w_{s} QUALIFY row_number() OVER (ORDER BY w, idx) <= {k})"
    )
    return each("a") + ", " + each("b")


@register(sql.query("SELECT idx, 'hub' AS role FROM hub_a UNION ALL SELECT idx, 'periphery' FROM per_a", _ends_sql(0.1, 5, 50)))
def hub_periphery(x: Layers) -> DataFrame:
    return sampling.ends(_side_weights(_sides(x)[0]), 0.1, 5, 50)


@register(
    sql.query(
        "SELECT round(greatest((SELECT avg(sim / 0.1::DOUBLE) FROM hs WHERE n = 1) - (SELECT avg(sim / 0.1::DOUBLE) FROM hs WHERE n = 2) + 0.2::DOUBLE, 0), 6) AS loss",
        "hs AS (SELECT s.sim, (a.w >= (SELECT quantile_cont(w, 0.8) FROM w_a))::INT + (b.w >= (SELECT quantile_cont(w, 0.8) FROM w_b))::INT AS n FROM sims s JOIN w_a a ON a.idx = s.a JOIN w_b b ON b.idx = s.b)",
    )
)
def hub_preserving_quantile(x: Layers) -> DataFrame:
    a, b = _sides(x)
    hubs = [sampling.quantile_hubs(_side_weights(s), 0.8) for s in (a, b)]
    return _r6(losses.hub_margin(*_sides(x), *hubs, temperature=0.1), "loss")


# --- evaluation -----------------------------------------------------------------------------

_NEAR = "nr AS (SELECT u, v FROM l1 WHERE u IN (SELECT idx FROM emb_a) AND v IN (SELECT idx FROM emb_a)), ne AS (SELECT count(*) AS m FROM nr), na AS (SELECT count(*) AS n FROM emb_a)"


def _pair_scores(far: str, score: str) -> str:
    ends = "JOIN emb_a p ON p.idx = q.u JOIN emb_a r ON r.idx = q.v"
    return f"ps AS (SELECT concat_ws(':', y, u, v) AS id, y, round(coalesce({score}, 0), 9) AS score FROM (SELECT u, v, 1 AS y FROM nr UNION ALL SELECT u, v, 0 FROM {far}) q {ends})"


_AUC = "(SELECT round(sum(CASE WHEN y = 1 THEN below + same / 2.0::DOUBLE ELSE 0 END) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) FROM (SELECT a.y, (SELECT count(*) FROM ps b WHERE b.y = 0 AND b.score < a.score) AS below, (SELECT count(*) FROM ps b WHERE b.y = 0 AND b.score = a.score) AS same FROM ps a)) AS auc"
_AP = "(SELECT round(sum(CASE WHEN y = 1 THEN hits / pos::DOUBLE ELSE 0 END) / sum(y), 6) FROM (SELECT y, sum(y) OVER w AS hits, row_number() OVER w AS pos FROM ps WINDOW w AS (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING))) AS ap"


@register(sql.query(f"SELECT {_AUC}, {_AP}", f"{_NEAR}, {_drawn_sql('fa', 'negative', '(SELECT n FROM na)', '(SELECT m FROM ne)', 'nr', '10000')}, {_pair_scores('fa', 'list_inner_product(p.z, r.z)')}"))
def edge_prediction(x: Layers) -> DataFrame:
    return _r6(evaluation.edge_prediction(x.l1, _sides(x)[0].drop("label")), "auc", "ap")


@register(
    sql.query(
        f"SELECT {_AUC}, (SELECT round(avg(y), 6) FROM (SELECT y FROM ps ORDER BY score DESC, id LIMIT (SELECT least(m, 100) FROM ne))) AS precision",
        f"{_NEAR}, {_drawn_sql('fa', 'rebuild', '(SELECT n FROM na)', '(SELECT least(m, 10 * n) FROM ne, na)', 'nr', '10000')}, {_pair_scores('fa', 'list_cosine_similarity(p.z, r.z)')}",
    )
)
def reconstruction_metrics(x: Layers) -> DataFrame:
    return _r6(evaluation.reconstruction(x.l1, _sides(x)[0].drop("label")), "auc", "precision")


_ANY = "fa AS (SELECT floor(" + sql.uniform("'any:u'", "id") + " * (SELECT n FROM na))::BIGINT AS u, floor(" + sql.uniform("'any:v'", "id") + " * (SELECT n FROM na))::BIGINT AS v FROM range(0, (SELECT least(3 * m, 10000) FROM ne)) i(id))"


@register(
    sql.query(
        f"SELECT {_AUC}, (SELECT round(avg(hit), 6) FROM (SELECT EXISTS (SELECT 1 FROM nr WHERE (u = t.a AND v = t.b) OR (u = t.b AND v = t.a))::INT AS hit FROM (SELECT p.idx AS a, q.idx AS b FROM emb_a p JOIN emb_a q ON p.idx <> q.idx ORDER BY round(list_cosine_similarity(p.z, q.z), 9) DESC, a, b LIMIT (SELECT least(m, 50) FROM ne)) t)) AS precision",
        f"{_NEAR}, {_ANY}, {_pair_scores('fa', 'list_cosine_similarity(p.z, r.z)')}",
    )
)
def reconstruction_metrics_all(x: Layers) -> DataFrame:
    return _r6(evaluation.reconstruction_all(x.l1, _sides(x)[0].drop("label")), "auc", "precision")


def _roles_sql() -> str:
    unit = lambda s: f"un_{s} AS (SELECT idx, unnest(list_transform(z, lambda v: v / sqrt(list_inner_product(z, z)))) AS v, unnest(range(0, 64)) AS k FROM emb_{s})"
    mid = lambda s, r: f"c{r[0]}_{s} AS (SELECT k, avg(v) AS m FROM un_{s} WHERE idx IN (SELECT idx FROM {r}_{s}) GROUP BY k)"
    return ", ".join([_ends_sql(0.2, 3), unit("a"), unit("b"), *[mid(s, r) for s in "ab" for r in ("hub", "per")]])


def _cos_sql(p: str, q: str) -> str:
    return f"(SELECT sum(x.m * y.m) / sqrt(sum(x.m * x.m) * sum(y.m * y.m)) FROM {p} x JOIN {q} y USING (k))"


@register(
    sql.query(
        f"SELECT round({_cos_sql('ch_a', 'ch_b')}, 6) AS hub_center_sim, round((SELECT avg(s) FROM (SELECT max(sim) AS s FROM sims WHERE a IN (SELECT idx FROM hub_a) AND b IN (SELECT idx FROM hub_b) GROUP BY a)), 6) AS hub_max_sim,"
        f" round({_cos_sql('cp_a', 'cp_b')}, 6) AS periph_center_sim, round(1 - ({_cos_sql('ch_a', 'cp_a')} + {_cos_sql('ch_b', 'cp_b')}) / 2, 6) AS separation, round({_cos_sql('ch_a', 'ch_b')} - {_cos_sql('ch_a', 'cp_a')}, 6) AS hub_separation",
        _roles_sql(),
    )
)
def role_alignment(x: Layers) -> DataFrame:
    a, b = _sides(x)
    rows = evaluation.roles(a.drop("label"), _side_weights(a), b.drop("label"), _side_weights(b), 0.2, 3)
    return _r6(rows, *rows.columns)


@register(
    sql.query(
        "SELECT round(greatest(-1, least(1, 1 - 6 * sum(pow(ra - rb, 2)) / (count(*)::DOUBLE * (count(*)::DOUBLE * count(*) - 1)))), 6) AS rank_correlation, round(coalesce(corr(qa, qb), 0), 6) AS alpha_rank_corr FROM pq",
        "mt AS (SELECT a, b FROM sims QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC, b) = 1), oa AS (SELECT idx AS a, w AS wa, row_number() OVER (ORDER BY w DESC, idx) AS ra FROM w_a), ob AS (SELECT idx AS b, w AS wb, row_number() OVER (ORDER BY w DESC, idx) AS rb FROM w_b),"
        " mr AS (SELECT * FROM mt JOIN oa USING (a) JOIN ob USING (b)), pq AS (SELECT ra, rb, rank() OVER (ORDER BY wa) + (count(*) OVER (PARTITION BY wa) - 1) / 2.0::DOUBLE AS qa, rank() OVER (ORDER BY wb) + (count(*) OVER (PARTITION BY wb) - 1) / 2.0::DOUBLE AS qb FROM mr)",
    )
)
def rank_agreement(x: Layers) -> DataFrame:
    a, b = _sides(x)
    rows = evaluation.rank_agreement(a.drop("label"), _side_weights(a), b.drop("label"), _side_weights(b))
    return _r6(rows, *rows.columns)


@register(sql.query("SELECT event_type, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS std, round(min(value), 5) AS min, round(max(value), 5) AS max, round(median(value), 5) AS median, round(avg((value = 0)::INT), 5) AS zero_ratio FROM events GROUP BY event_type"))
def tensor_stats_by_axis(x: Layers) -> DataFrame:
    return ranking.statistics(x.table("events").select("event_type", F.col("value").alias("x")), by=("event_type",))


@register(sql.query("SELECT round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, count(*) AS n FROM vals WHERE id % 7 <> 0 AND id % 11 <> 0"))
def finite_summary(x: Layers) -> DataFrame:
    odd = F.when(F.col("event_id") % 7 == 0, float("nan")).when(F.col("event_id") % 11 == 0, float("inf")).otherwise(F.col("value"))
    return _r6(ranking.finite_summary(x.table("events").select(odd.alias("x"))), "mean", "std")


@register(sql.query("SELECT id, round((x - m) / ((SELECT median(abs(x - m)) FROM vals, md) + 1e-8::DOUBLE), 6) AS y FROM vals, md", "md AS (SELECT median(x) AS m FROM vals)"))
def normalised_standard(x: Layers) -> DataFrame:
    rows = x.table("events").select(F.col("event_id").alias("id"), F.col("value").alias("x"))
    return _r6(ranking.normalised(rows, "standard"), "y").select("id", "y")


_NCE = " + ".join(f"(SELECT avg(l - p) FROM (SELECT ln(sum(exp(sim / 0.1::DOUBLE))) AS l, max(CASE WHEN a = b THEN sim / 0.1::DOUBLE END) AS p FROM sims GROUP BY {c}))" for c in "ab")


@register(
    sql.query(
        "SELECT round(al, 6) AS loss_align, round(re, 6) AS loss_recon, round(nc, 6) AS loss_contrastive, 0.0::DOUBLE AS loss_role, round(al + 0.5::DOUBLE * re + 0.1::DOUBLE * nc, 6) AS loss_total FROM ("
        f"SELECT {_mmd('emb_a', 'w_a', 'emb_a', 'w_a')} + {_mmd('emb_b', 'w_b', 'emb_b', 'w_b')} - 2 * {_mmd('emb_a', 'w_a', 'emb_b', 'w_b')} AS al,"
        f" (SELECT round(sum(l), 6) FROM (SELECT avg(w * (greatest(x, 0) - x * y + ln(1 + exp(-abs(x))))) AS l FROM lg GROUP BY y)) AS re, ({_NCE}) / 2 AS nc)",
        _REC,
    )
)
def total_loss(x: Layers) -> DataFrame:
    a, b = _sides(x)
    align = losses.weighted_discrepancy(a.drop("label"), _side_weights(a), b.drop("label"), _side_weights(b))
    rows = losses.total({"align": align, "recon": recon_bce(x), "contrastive": losses.info_nce(*(s.drop("label") for s in _sides(x))), "role": align}, {"align": 1.0, "recon": 0.5, "contrastive": 0.1, "role": 0.0})
    return _r6(rows, *rows.columns)


# --- populations ----------------------------------------------------------------------------


@register(sql.query("SELECT id, skill FROM sk WHERE skill = 2 ORDER BY cost DESC, id LIMIT 5", _POP))
def best_individuals(x: Layers) -> DataFrame:
    return _candidates(x).filter("skill = 2").orderBy(F.desc("cost"), "id").limit(5).select("id", "skill")


@register(
    sql.query(
        "SELECT id, array_to_string(seeds, ',') AS seeds FROM sm",
        "tw AS (SELECT node, pow(greatest(CASE WHEN node IN (SELECT node FROM sa) THEN 0 ELSE w END, 1e-10::DOUBLE), 2.0::DOUBLE) AS w FROM alpha1), " + _sample_sql("tw", "temper", 8, 5, "sm"),
    )
)
def init_tempered(x: Layers) -> DataFrame:
    w = evolve.tempered(centrality.alpha(x.nodes, _arcs(x)), 0.5, x.top_degree(x.l1))
    return evolve.sample(x.spark, 8, w, 5, "temper").select("id", F.array_join("seeds", ",").alias("seeds"))


@register(
    sql.query(
        "SELECT id, array_to_string(one, ',') AS seeds_l1, array_to_string(two, ',') AS seeds_l2 FROM gm WHERE step = 151",
        "tp AS (SELECT a, b FROM sims ORDER BY sims.sim DESC, a, b LIMIT 150), od AS (SELECT i.id, a, b, row_number() OVER (PARTITION BY i.id ORDER BY " + sql.uniform("'pair'", "i.id", "a", "b") + ", a, b) AS step FROM range(0, 6) i(id), tp),"
        " gm AS (SELECT id, 1 AS step, []::BIGINT[] AS one, []::BIGINT[] AS two FROM range(0, 6) i(id) UNION ALL SELECT g.id, g.step + 1, CASE WHEN len(one) < 5 AND NOT list_contains(one, o.a) AND NOT list_contains(two, o.b) THEN list_append(one, o.a) ELSE one END, CASE WHEN len(one) < 5 AND NOT list_contains(one, o.a) AND NOT list_contains(two, o.b) THEN list_append(two, o.b) ELSE two END FROM gm g JOIN od o ON o.id = g.id AND o.step = g.step)",
        recursive=True,
    )
)
def init_aligned(x: Layers) -> DataFrame:
    rows = evolve.matched(x.spark, 6, blocks.best_pairs(*_sides(x), 150), 5, "pair")
    return rows.select("id", F.array_join("seeds_l1", ",").alias("seeds_l1"), F.array_join("seeds_l2", ",").alias("seeds_l2"))


@register("SELECT id, CASE WHEN id < 12 THEN 'elite' WHEN id < 20 THEN 'robust' WHEN id < 32 THEN 'aligned' ELSE 'random' END AS \"group\", row_number() OVER (ORDER BY " + sql.uniform("'group'", "id") + ", id) AS pos FROM range(0, 41) i(id)")
def population_groups(x: Layers) -> DataFrame:
    return evolve.groups(x.spark, 41, {"elite": 0.3, "robust": 0.2, "aligned": 0.3}, "random")


@register(
    sql.query(
        "SELECT a.id AS pair_id, a.skill AS skill_x, b.skill AS skill_y, CASE WHEN " + sql.uniform("'mating:cross'", "a.id") + " >= 0.7::DOUBLE THEN 'copy' WHEN a.skill = b.skill THEN 'swap' WHEN " + sql.uniform("'mating:across'", "a.id") + " < 0.3::DOUBLE THEN 'guided' ELSE 'copy' END AS mode FROM sk a JOIN sk b ON b.id = a.id + 1",
        _POP,
    )
)
def mating_modes(x: Layers) -> DataFrame:
    rows = _candidates(x).select("id", "skill")
    pairs = rows.toDF("pair_id", "skill_x").join(rows.select((F.col("id") - 1).alias("pair_id"), F.col("skill").alias("skill_y")), "pair_id")
    return evolve.mating(pairs, 0.7, 0.3)


@register(
    sql.query(
        "SELECT g.id, g.pos, coalesce(n.new, g.node) AS node FROM ge g LEFT JOIN (SELECT id, new, min(pos) AS pos FROM bt GROUP BY id, new) n USING (id, pos)",
        "wi AS (SELECT idx AS node, w FROM w_a), " + _sample_sql("wi", "x", 12, 5, "sm") + ", ge AS (SELECT id, (unnest(range(0, 5)))::INT AS pos, unnest(seeds) AS node FROM sm),"
        " kn AS (SELECT a.idx AS a, b.idx AS b FROM emb_a a JOIN emb_a b ON a.idx <> b.idx QUALIFY row_number() OVER (PARTITION BY a.idx ORDER BY list_cosine_similarity(a.z, b.z) DESC, b.idx) <= 5),"
        " bt AS (SELECT g.id, g.pos, k.b AS new FROM ge g JOIN kn k ON k.a = g.node JOIN wi w ON w.node = k.b WHERE " + sql.uniform("'m:near'", "g.id", "g.pos") + " < 0.5::DOUBLE AND NOT EXISTS (SELECT 1 FROM ge h WHERE h.id = g.id AND h.node = k.b) QUALIFY row_number() OVER (PARTITION BY g.id, g.pos ORDER BY w.w DESC, k.b) = 1)",
    )
)
def neighbour_mutation(x: Layers) -> DataFrame:
    a = _sides(x)[0]
    w = _side_weights(a).withColumnRenamed("idx", "node")
    genes = evolve.sample(x.spark, 12, w, 5, "x").withColumnRenamed("seeds", "genes")
    return evolve.neighbour_mutation(genes, similarity.knn(a, 5), w, 0.5, "m")


def _reach_sql(tag: str, seeds_of: str, arcs: str, deg: str, alpha: str) -> str:
    """Influence times weight over all that lies two hops from the seeds, and the seeds."""
    return (
        f"zz{tag} AS (SELECT node FROM {seeds_of} UNION SELECT b.dst FROM {arcs} a JOIN {arcs} b ON a.dst = b.src WHERE a.src IN (SELECT node FROM {seeds_of}) AND a.src <> b.dst),"
        f" pf{tag} AS (SELECT sum((1 + 0.01::DOUBLE * d.deg + 0.0001::DOUBLE * coalesce((SELECT sum(m.deg) FROM {arcs} e JOIN {deg} m ON m.node = e.dst WHERE e.src = d.node), 0)) * a.w) AS p FROM zz{tag} z JOIN {deg} d ON d.node = z.node JOIN {alpha} a ON a.node = z.node)"
    )


@register(sql.query("SELECT round(a.p, 9) AS p1, round(b.p, 9) AS p2, round(a.p + b.p - 0.5::DOUBLE * abs(a.p - b.p), 9) AS fitness FROM pf1 a, pf2 b", _reach_sql("1", "sa", "e1", "d1", "alpha1") + ", " + _reach_sql("2", "sb", "e2", "d2", "alpha2")))
def balanced_fitness(x: Layers) -> DataFrame:
    """What gap filling raises: both layers' performance less half their difference."""
    sides = []
    for edges in (x.l1, x.l2):
        arcs = graph.symmetric(edges)
        sides.append(search.layer_performance(x.nodes, arcs, influence.potential(x.nodes, arcs), centrality.alpha(x.nodes, arcs), x.top_degree(edges)))
    rows = search.balanced(*sides)
    return rows.select(*[F.round(c, 9).alias(c) for c in rows.columns])


# --- grids, networks, results ----------------------------------------------------------------


@register("SELECT graph, kind, layers, coverage FROM range(0, 5) g(graph), (SELECT unnest(['small_world', 'scale_free', 'hybrid', 'er']) AS kind), (SELECT unnest([2, 3]) AS layers), (SELECT unnest([0.3::DOUBLE, 0.6::DOUBLE]) AS coverage)")
def parameter_grid(x: Layers) -> DataFrame:
    return tables.grid(x.spark, 5, kind=["small_world", "scale_free", "hybrid", "er"], layers=[2, 3], coverage=[0.3, 0.6])


def _networks(x: Layers) -> DataFrame:
    return tables.union({("a", 2): x.l2, ("b", 1): x.l1, ("b", 2): x.l2, ("b", 3): x.l1, ("c", 1): x.l1, ("c", 4): x.l2})


@register(sql.query("SELECT 1::INT AS side, u, v FROM l2 UNION ALL SELECT 2, u, v FROM l2"))
def first_network_pair(x: Layers) -> DataFrame:
    return tables.first_pair(_networks(x))


@register(sql.query("SELECT g AS graph, s::INT AS side, u, v FROM (SELECT unnest(['b', 'c']) AS g), (SELECT 1 AS s, u, v FROM l1 UNION ALL SELECT 2, u, v FROM l2)"))
def network_pairs(x: Layers) -> DataFrame:
    return tables.layer_pairs(_networks(x))


@register(sql.query("SELECT skill, to_json({'id': id, 'rank': r}) AS json FROM (SELECT skill, id, least(r1, r2, r3) AS r, row_number() OVER (PARTITION BY skill ORDER BY cost DESC, id) AS k FROM sk) WHERE k = 1", _POP))
def best_results_json(x: Layers) -> DataFrame:
    best = search.elite(_candidates(x), 1).select("skill", "id", F.least("rank_t1", "rank_t2", "rank_t3").alias("rank"))
    return tables.results(best, "skill")
