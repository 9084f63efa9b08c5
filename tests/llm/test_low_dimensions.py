"""Recall of the embedding search, with its own settings, where links do not lie in random directions."""

import numpy as np
import pytest

from matloom.llm import multi_index


def unit(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


def one_axis(rng, n):
    """Pairs of cosine 0.905 that differ along the first axis only."""
    x = unit(rng.normal(size=(n // 2, 64)))
    axis = np.eye(64)[0][None]
    side = unit(axis - (x @ axis.T) * x)
    return np.concatenate([x, 0.905 * x + (1 - 0.905**2) ** 0.5 * side])


def rank_12(rng, n):
    """Vectors of a span of 12 dimensions, with partners in it."""
    x = unit(rng.normal(size=(n // 2, 12)))
    y = unit(x + rng.normal(size=x.shape) * 0.13)
    return np.concatenate([x, y]) @ np.linalg.qr(rng.normal(size=(64, 12)))[0].T


def clusters(rng, n):
    centres = unit(rng.normal(size=(40, 64)))
    return centres[rng.integers(0, 40, n)] + rng.normal(size=(n, 64)) * rng.choice([0.02, 0.04, 0.06], (n, 1))


def few_dimensions(rng, n, inner=6):
    return rng.normal(size=(n, inner)) @ rng.normal(size=(inner, 64)) + rng.normal(size=(n, 64)) * 0.05


def rare(rng, n):
    """Six links among vectors of no structure."""
    x = rng.normal(size=(n, 64))
    x[-6:] = x[:6] + rng.normal(size=(6, 64)) * 0.3
    return x


@pytest.mark.parametrize("made", [one_axis, rank_12, clusters, few_dimensions, rare])
def test_recall(spark, monkeypatch, made):
    words = []
    fit = multi_index.fit_index
    monkeypatch.setattr(multi_index, "fit_index", lambda *a, **k: words.append(fit(*a, **k)) or words[-1])
    x = made(np.random.default_rng(7), 6000).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<float>")
    found = sum(r["n_links"] for r in multi_index.embedding_links(df).collect())
    exact = int((unit(x.astype(float)) @ unit(x.astype(float)).T >= 0.9).sum()) - len(x)
    print(made.__name__, exact, found / exact, words[0].margin)
    assert len(words[0].first) > 1
    assert 0.95 * exact <= found <= exact and exact >= 8


def test_links_beyond_the_sample(spark):
    """So few links that no margin can be calibrated: the one that loses none is taken."""
    x = rare(np.random.default_rng(8), 3000)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    found = sum(r["n_links"] for r in multi_index.embedding_links(df, sample_rows=600, query_rows=100).collect())
    assert found == int((unit(x) @ unit(x).T >= 0.9).sum()) - len(x) > 0


def test_bound_is_never_above_the_distance():
    rng = np.random.default_rng(9)
    x = unit(rng.normal(size=(3000, 16)))
    index = multi_index.fit_index(x[:500], 500, 0.9, list_size=4)
    p, q = index.crossings(x[:300])
    home = index.homes(x)
    bound = p[:, home // len(index.second)] + q[:, home % len(index.second)]
    assert (bound <= ((x[:300, None] - x[None]) ** 2).sum(2) + 1e-9).all() and bound.max() > 0.5
