"""The SQL that goes with the queries is text, and belongs to queries that exist."""

import __spark_entry__


def test_oracles_are_text():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries)
    assert all(isinstance(v, str) and v.strip() for v in oracles.values())


def test_all_ten_and_the_pipeline_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
