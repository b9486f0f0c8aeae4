"""Forests by tables are the same as walked and explained leaf by leaf, and bags cost what they draw."""

import numpy as np
import pytest

from foldwise.operators import attribution, forests, treegrids


@pytest.fixture(scope="module")
def grown():
    rng = np.random.default_rng(3)
    a, q, t, d = rng.lognormal(10, 0.7, 3000), rng.integers(1, 51, 3000), rng.integers(0, 9, 3000) / 100, rng.integers(0, 11, 3000) / 100
    x = np.column_stack([a, q, t, a * (1 - d)])
    trees = [forests.grow(x, (d <= 0.02) * 1.0, rng.poisson(1, 3000) * 1.0, s) for s in range(3)]
    return x, [{k: np.array(v) for k, v in g.items()} | {"weight": 1 / 3} for g in trees]


def test_tables_of_trees_equal_walks_and_leaves(grown, monkeypatch):
    x, forest = grown
    x = np.vstack([x, np.full((1, 4), np.nan)])
    walked = forests.predict(x, forest)
    monkeypatch.setattr(forests, "ENOUGH", 1)
    assert np.array_equal(forests.predict(x, forest), walked)
    phi, left = treegrids.contributions(x, forest)
    assert not left and np.allclose(phi.sum(1), walked - sum(t["weight"] * t["value"][0] for t in forest), atol=1e-12)
    assert np.allclose(phi[-50:], attribution.contributions_by_leaves(x[-50:], forest), atol=1e-12)
    many = np.tile(x, (30, 1))  # some sets of columns have fewer cells than rows now
    assert np.allclose(treegrids.contributions(many, forest)[0][-len(x) :], phi, atol=1e-12)
    monkeypatch.setattr(treegrids, "CELLS", 10)
    assert len(treegrids.contributions(x, forest)[1]) == 3 and np.array_equal(forests.predict(x, forest), walked)
    assert np.allclose(attribution.tree_contributions_of(x[:20], forest), phi[:20], atol=1e-12)


def test_bags_cost_what_they_draw(monkeypatch):
    unit, asked, uniform = np.random.default_rng(0).integers(-(2**62), 2**62, 200_000), [], forests.poisson_uniform
    monkeypatch.setattr(forests, "poisson_uniform", lambda u, d: asked.append(len(u)) or uniform(u, d))
    row, tree, w = forests.drawn(unit, 0.002, 100)
    assert len(np.unique(row * 100 + tree)) == len(row) and sum(asked) == len(unit) + 2 * len(row)
    expected = 0.002 * (1 - np.exp(-1)) * len(unit)
    assert abs(np.bincount(tree, minlength=100) - expected).max() < 5 * expected**0.5 and abs(w.mean() - 1 / (1 - np.exp(-1))) < 0.03
    full = forests.drawn(unit[:50_000], 1.0, 4, 7)
    assert abs(np.bincount(full[1], full[2]) / 50_000 - 1).max() < 0.02
