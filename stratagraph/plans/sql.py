"""DuckDB SQL of the fixtures, shared by the queries' oracles."""

from __future__ import annotations

BASE = """
nodes AS (SELECT p_partkey AS node FROM part),
s AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 25),
l1 AS (SELECT DISTINCT a.p AS u, b.p AS v FROM s a JOIN s b ON a.o = b.o AND a.p < b.p),
q AS (SELECT l_partkey AS p, lead(l_partkey) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS q
      FROM lineitem WHERE l_returnflag = 'A' AND l_discount >= 0.08::DOUBLE),
l2 AS (SELECT DISTINCT least(p, q) AS u, greatest(p, q) AS v FROM q WHERE q IS NOT NULL AND q <> p),
e1 AS (SELECT u AS src, v AS dst FROM l1 UNION ALL SELECT v, u FROM l1),
e2 AS (SELECT u AS src, v AS dst FROM l2 UNION ALL SELECT v, u FROM l2),
d1 AS (SELECT n.node, count(e.dst) AS deg FROM nodes n LEFT JOIN e1 e ON e.src = n.node GROUP BY n.node),
d2 AS (SELECT n.node, count(e.dst) AS deg FROM nodes n LEFT JOIN e2 e ON e.src = n.node GROUP BY n.node),
sa AS (SELECT node FROM d1 WHERE deg > 0 ORDER BY deg DESC, node LIMIT 10),
sb AS (SELECT node FROM d2 WHERE deg > 0 ORDER BY deg DESC, node LIMIT 10),
hub AS (SELECT node FROM d1 ORDER BY deg DESC, node LIMIT 1),
near AS (SELECT dst AS node, row_number() OVER (ORDER BY dst) AS pos FROM e1 WHERE src = (SELECT node FROM hub) QUALIFY pos <= 9),
star_a AS (SELECT 0 AS pos, node FROM hub UNION ALL SELECT pos, node FROM near),
far AS (SELECT DISTINCT dst AS node FROM e1 WHERE src IN (SELECT node FROM near) AND dst NOT IN (SELECT node FROM star_a) ORDER BY node LIMIT 9),
star_b AS (SELECT node FROM far UNION ALL SELECT node FROM near WHERE pos = 1),
ones AS (SELECT node, 1.0::DOUBLE AS w FROM nodes),
x1 AS (SELECT node, exp(CASE WHEN deg > 0 THEN 8.0::DOUBLE / deg ELSE 0 END) AS e FROM d1),
x2 AS (SELECT node, exp(CASE WHEN deg > 0 THEN 8.0::DOUBLE / deg ELSE 0 END) AS e FROM d2),
alpha1 AS (SELECT node, e / (SELECT sum(e) FROM x1) AS w FROM x1),
alpha2 AS (SELECT node, e / (SELECT sum(e) FROM x2) AS w FROM x2),
mean1 AS (SELECT node, w / (SELECT avg(w) FROM alpha1) AS w FROM alpha1),
mean2 AS (SELECT node, w / (SELECT avg(w) FROM alpha2) AS w FROM alpha2),
removed AS (SELECT node FROM d1 WHERE node <> (SELECT node FROM sa LIMIT 1) ORDER BY deg DESC, node LIMIT 5),
none AS (SELECT node FROM nodes WHERE false),
live1 AS (SELECT * FROM e1 WHERE src NOT IN (SELECT node FROM removed) AND dst NOT IN (SELECT node FROM removed)),
tri AS (SELECT a.u AS x, a.v AS y, b.v AS z FROM l1 a JOIN l1 b ON a.v = b.u JOIN l1 c ON c.u = a.u AND c.v = b.v),
t1 AS (SELECT node, count(*) AS t FROM (SELECT unnest([x, y, z]) AS node FROM tri) GROUP BY node),
cc1 AS (SELECT d.node, d.deg, CASE WHEN d.deg < 2 THEN 0 ELSE 2.0::DOUBLE * coalesce(t.t, 0) / (d.deg * (d.deg - 1)) END AS cc FROM d1 d LEFT JOIN t1 t USING (node)),
h2 AS (SELECT DISTINCT a.src, b.dst FROM e1 a JOIN e1 b ON a.dst = b.src WHERE a.src <> b.dst),
cov1 AS (SELECT n.node, count(h.dst) AS coverage FROM nodes n LEFT JOIN h2 h ON h.src = n.node GROUP BY n.node),
nd1 AS (SELECT e.src AS node, d.deg, m.deg AS nbr_deg FROM e1 e JOIN d1 d ON d.node = e.src JOIN d1 m ON m.node = e.dst),
pot1 AS (SELECT d.node, 1 + 0.01::DOUBLE * d.deg + 0.0001::DOUBLE * coalesce((SELECT sum(nbr_deg) FROM nd1 WHERE nd1.node = d.node), 0) AS potential FROM d1 d),
emb_a AS (SELECT vec_id // 2 AS idx, embedding::DOUBLE[] AS z, label FROM embeddings WHERE vec_id % 2 = 0),
emb_b AS (SELECT vec_id // 2 AS idx, embedding::DOUBLE[] AS z, label FROM embeddings WHERE vec_id % 2 = 1),
sims AS (SELECT a.idx AS a, b.idx AS b, list_cosine_similarity(a.z, b.z) AS sim FROM emb_a a, emb_b b),
w_a AS (SELECT idx, (label + 1) / (SELECT sum(label + 1) FROM emb_a)::DOUBLE AS w FROM emb_a),
w_b AS (SELECT idx, (label + 1) / (SELECT sum(label + 1) FROM emb_b)::DOUBLE AS w FROM emb_b),
scored AS (SELECT d.doc_id AS id, l.quality AS y, d.n_chars::DOUBLE AS score FROM documents d JOIN labels l USING (doc_id)),
vals AS (SELECT event_id AS id, value AS x FROM events)
"""


def uniform(*key: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(key)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def query(select: str, more: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{BASE}{',' + more if more else ''} {select}"


def side(own: str, other: str, arcs: str, weights: str, p: str = "0.01::DOUBLE") -> str:
    """Scalar SQL of one side's two-hop influence, by correlated sums."""
    beyond = f"(SELECT coalesce(sum(wk.w), 0) FROM {arcs} k JOIN {weights} wk ON wk.node = k.dst WHERE k.src = a.dst AND k.dst NOT IN (SELECT node FROM {other}))"
    met = f"(SELECT count(*) FROM {arcs} m WHERE m.src = a.dst AND m.dst IN (SELECT node FROM {other}))"
    deg = f"(SELECT count(*) FROM {arcs} g WHERE g.src = a.dst)"
    hop = f"FROM {own} o JOIN {arcs} a ON a.src = o.node JOIN {weights} wj ON wj.node = a.dst WHERE a.dst NOT IN (SELECT node FROM {other})"
    return (
        f"((SELECT coalesce(sum(w.w), 0) FROM {own} o JOIN {weights} w ON w.node = o.node)"
        f" + (SELECT coalesce(sum({p} * (wj.w + {p} * {beyond})), 0) {hop})"
        f" - (SELECT coalesce(sum({p} * wj.w * (1 + {p} * floor({deg} / pow(2, {met})))), 0) {hop} AND a.dst IN (SELECT node FROM {own})))"
    )


def attacks(a: str, b: str, arcs: str, steps: int, tag: str = "") -> str:
    """CTEs gone{tag}0..steps (node, step): nodes removed after so many two-hop attacks, and their live arcs."""
    out = [f"gone{tag}0 AS (SELECT node, 0 AS step FROM none)"]
    for i in range(1, steps + 1):
        live, deg, before = f"la{tag}{i}", f"ld{tag}{i}", f"gone{tag}{i - 1}"
        out.append(f"{live} AS (SELECT * FROM {arcs} WHERE src NOT IN (SELECT node FROM {before}) AND dst NOT IN (SELECT node FROM {before}))")
        out.append(f"{deg} AS (SELECT src AS node, count(*) AS deg FROM {live} GROUP BY src)")
        hidden = f"CASE WHEN e.src IN (SELECT node FROM {a}) THEN e.dst IN (SELECT node FROM {b}) WHEN e.src IN (SELECT node FROM {b}) THEN e.dst IN (SELECT node FROM {a}) ELSE e.dst IN (SELECT node FROM {a}) OR e.dst IN (SELECT node FROM {b}) END"
        out.append(f"top{tag}{i} AS (SELECT e.src AS node FROM {live} e JOIN {deg} d ON d.node = e.dst WHERE NOT ({hidden}) GROUP BY e.src ORDER BY sum(1 + d.deg) DESC, e.src LIMIT 1)")
        out.append(f"gone{tag}{i} AS (SELECT * FROM {before} UNION ALL SELECT node, {i} FROM top{tag}{i})")
        out.append(f"after{tag}{i} AS (SELECT * FROM {arcs} WHERE src NOT IN (SELECT node FROM gone{tag}{i}) AND dst NOT IN (SELECT node FROM gone{tag}{i}))")
    return ", ".join(out)


def robust(a: str, b: str, weights: str, steps: int, tag: str = "") -> str:
    return "((" + " + ".join(side(a, b, f"after{tag}{i}", weights) for i in range(1, steps + 1)) + f") / {steps}.0::DOUBLE)"
