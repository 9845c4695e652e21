"""Walk powers of arcs from two-step rows alone."""

import numpy as np
import pytest

from stratagraph.operators import powers
from tests.test_powers import network


@pytest.mark.parametrize("gathered, light", [(1 << 20, 1 << 20), (500, 400)])
def test_powers_of_arcs(spark, monkeypatch, gathered, light):
    monkeypatch.setattr(powers, "GATHERED", gathered)
    monkeypatch.setattr(powers, "LIGHT", light)
    asked, keep = [], powers.of_pairs
    monkeypatch.setattr(powers, "of_pairs", lambda pairs, *a: asked.append(pairs.count()) or keep(pairs, *a))
    ids, arcs, p = network()
    place = {int(x): i for i, x in enumerate(ids)}
    got = powers.of_arcs(spark.createDataFrame(arcs, "src bigint, dst bigint"), 5).collect()
    assert sorted((r["src"], r["dst"]) for r in got) == sorted(arcs)
    dense = [np.linalg.matrix_power(p, i) for i in range(1, 6)]
    for r in got:
        assert [r[f"p{i}"] for i in range(1, 6)] == pytest.approx([m[place[r["src"]], place[r["dst"]]] for m in dense])
    # whole powers are formed for nodes with very many entries around them only
    assert not asked if light > 400 else 0 < asked[0] < len(arcs)


def test_no_arcs(spark):
    assert powers.of_arcs(spark.createDataFrame([], "src bigint, dst bigint"), 5).count() == 0
