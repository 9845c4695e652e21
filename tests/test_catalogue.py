"""Every registered query against its SQL, at the smallest scale."""

import os

import duckdb
import pytest

from stratagraph.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "part lineitem events documents embeddings labels".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([r[i] for i in order] for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    cursor = duck.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(cursor.fetchall(), columns)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_generators_make_exact_numbers_of_edges(spark):
    for name in ("generate_sw", "generate_ba", "generate_hybrid", "generate_community"):
        rows = catalogue.QUERIES[name](spark, SF).collect()
        assert len(rows) == 1000 and len({tuple(r) for r in rows}) == 1000
        assert all(r["u"] < r["v"] for r in rows)


@pytest.mark.parametrize("name", "kcore closeness_harmonic factorial_ranks skill_factor population_stats survival_selection elite_per_task recon_bce".split())
def test_sql_has_no_bounds_on_ids(name):
    """Both sides of the comparison above take every row."""
    text = catalogue.ORACLES[name]
    assert "p_partkey <" not in text and "idx <" not in text.replace("idx <>", "") and "u <" not in text and "dist <" not in text


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_tournament_draws_from_all(spark):
    assert max(r["id"] for r in catalogue.QUERIES["tournament"](spark, SF).collect()) >= 120
