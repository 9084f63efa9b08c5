"""Queries without SQL, held against plain numpy on the same tables."""

import math

import duckdb
import numpy as np
import pytest

from matloom import queries as engine
from matloom.operators import kmeans

FOLDER = "/root/testdata/sf0.001"
GROUPS = [range(a, a + 16) for a in range(0, 64, 16)]


def table(sql):
    return duckdb.sql(sql.replace("@", f"{FOLDER}/")).df()


@pytest.fixture(scope="module")
def e():
    df = table("select vec_id, embedding from '@embeddings.parquet' order by vec_id")
    return df["vec_id"].to_numpy(), np.stack(df["embedding"].to_list()).astype(float)


def collected(spark, name, *by):
    return engine.queries()[name](spark, FOLDER).toPandas().sort_values(list(by)).reset_index(drop=True)


def replicate_factors(x, k):
    """W of the first k factors from replicate differences, all rows being controls."""
    y = x - x.mean(1, keepdims=True)
    s = np.hstack([y[:, list(g)] - y[:, list(g)].mean(1, keepdims=True) for g in GROUPS])
    values, vectors = np.linalg.eigh(s.T @ s)
    u = vectors[:, np.argsort(-values)[:k]]
    return y.T @ s @ u @ np.linalg.inv(u.T @ s.T @ s @ u) if k else np.zeros((64, 0))


def artifact(x, k):
    w, y = replicate_factors(x, k), x - x.mean(1, keepdims=True)
    if not k:
        return np.zeros_like(y)
    return np.linalg.lstsq(w, y.T, rcond=None)[0].T @ w.T  # a from the row alone, by least squares


def by_group(x):
    out = np.empty_like(x)
    for g in GROUPS:
        out[:, list(g)] = x[:, list(g)].mean(1, keepdims=True)
    return out


def test_signal_with_adjusted_artifacts(spark, e):
    ids, x = e
    y, w = x - x.mean(1, keepdims=True), replicate_factors(x, 2)
    design = np.zeros((64, 4))
    for i, g in enumerate(GROUPS):
        design[list(g), i] = 1
    both = np.linalg.lstsq(np.hstack([design, w]), y.T, rcond=None)[0]  # group means and a at once
    rest = y - both[4:].T @ w.T
    got = collected(spark, "factor_ruvs_project", "row_idx", "col")["value"].to_numpy().reshape(x.shape)
    assert np.abs(got - (by_group(rest) + x.mean(1, keepdims=True))).max() < 2e-6


def test_signal_where_the_sql_stops_short(spark):
    """On sf0.1 the third eigenvalue is 0.9937 of the second, and 0.9937 ** 1500 still 8e-5; 4000 steps suffice."""
    folder = "/root/testdata/sf0.1"
    x = np.stack(duckdb.sql(f"select embedding from '{folder}/embeddings.parquet' order by vec_id").df()["embedding"].to_list()).astype(float)
    mean, w, design = x.mean(1, keepdims=True), replicate_factors(x, 2), np.zeros((64, 4))
    for i, g in enumerate(GROUPS):
        design[list(g), i] = 1
    a = np.linalg.lstsq(np.hstack([design, w]), (x - mean).T, rcond=None)[0][4:]
    got = engine.queries()["factor_ruvs_project"](spark, folder).toPandas().sort_values(["row_idx", "col"])["value"].to_numpy().reshape(x.shape)
    assert np.abs(got - (by_group(x - mean - a.T @ w.T) + mean)).max() < 1e-6
    sql = engine.oracle_sql()["factor_ruvs_project"]
    with duckdb.connect() as con:
        con.sql(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
        longer = con.sql(sql.replace("1500", "4000")).df().sort_values(["row_idx", "col"])["value"].to_numpy().reshape(x.shape)
    assert np.abs(got - longer).max() < 1.5e-6


def test_artifacts_by_config(spark, e):
    ids, x = e
    got = collected(spark, "factor_components_by_config", "k", "row_idx", "col")
    for k in (0, 1, 3):
        assert np.abs(got[got["k"] == k]["value"].to_numpy().reshape(x.shape) - artifact(x, k)).max() < 2e-6


def test_variance_by_config(spark, e):
    ids, x = e
    got = collected(spark, "variance_by_config", "k").set_index("k")
    ss = lambda a: ((a - a.mean()) ** 2).sum()
    for k in (0, 1, 2, 5):
        art, mean = artifact(x, k), x.mean(1, keepdims=True)
        signal = by_group(x - mean - art) + mean
        row = signal.mean(1, keepdims=True)
        wanted = {"ss_t": ss(x), "ss_b": ss(signal), "ss_u": ss(art), "ss_bu": ss(signal + art), "ss_r": ss(x - signal - art), "b_ss_bl": 64 * ((row - signal.mean()) ** 2).sum(), "b_ss_wl": ((signal - row) ** 2).sum()}
        for c, v in wanted.items():
            assert got.loc[k, c] == pytest.approx(v, rel=1e-6, abs=1e-6)
        assert got.loc[k, "e"] == pytest.approx(1 - wanted["ss_bu"] / wanted["ss_t"], abs=1e-6)
        assert got.loc[k, "u"] == pytest.approx((wanted["ss_bu"] - wanted["ss_b"]) / wanted["ss_t"], abs=1e-6)


def test_anova_by_config(spark, e):
    ids, x = e
    got = collected(spark, "anova_by_config", "k", "row_idx")
    for k in (1, 3):
        c = x - artifact(x, k)
        within = sum(((c[:, list(g)] - c[:, list(g)].mean(1, keepdims=True)) ** 2).sum(1) for g in GROUPS) / 60
        between = sum(16 * (c[:, list(g)].mean(1) - c.mean(1)) ** 2 for g in GROUPS) / 3
        assert np.allclose(got[got["k"] == k]["f"].to_numpy(), between / within, rtol=1e-6)


def test_distance_by_config(spark, e):
    ids, x = e
    got = collected(spark, "distance_by_config", "k", "a", "b")
    a, b = np.triu_indices(64, 1)
    for k in (0, 2):
        c = x - artifact(x, k)
        assert np.allclose(got[got["k"] == k]["distance"].to_numpy(), np.sqrt(((c[:, a] - c[:, b]) ** 2).sum(0)), rtol=1e-6)


def test_eigenvalues_and_their_null(spark):
    u = table("select user_id, event_type, count(*) n from '@events.parquet' group by all").pivot(index="user_id", columns="event_type", values="n").fillna(0).to_numpy()
    size = u.sum(0)
    logs = np.log(u * (np.median(size) / size) + 1)
    y = logs - logs.mean(1, keepdims=True)
    values = np.sort(np.linalg.eigvalsh(y.T @ y))[::-1]
    got = collected(spark, "eigen_permutation_null", "i")
    assert np.allclose(got["eigenvalue"], np.maximum(values, 0), atol=1e-6)
    assert np.allclose(got["share"], np.where(values > 1e-6, values, 0) / values[values > 1e-6].sum(), atol=1e-9)
    null = np.stack(got["null_shares"].to_list())
    assert null.shape == (5, 3) and np.allclose(null.sum(0), 1) and len({tuple(c) for c in null.T.round(9)}) == 3


def test_column_clusters(spark, e):
    ids, x = e
    d = (1 - np.corrcoef(x.T)) / 2
    groups = [{i} for i in range(64)]
    while len(groups) > 4:
        far = [(max(d[i, j] for i in a for j in b), m, n) for m, a in enumerate(groups) for n, b in enumerate(groups) if m < n]
        _, m, n = min(far)
        groups[m] |= groups.pop(n)
    got = collected(spark, "column_clusters", "col")
    assert {frozenset(g) for g in groups} == {frozenset(g["col"]) for _, g in got.groupby("cluster")}


def test_likelihood_is_greatest(spark):
    sites = table("""select l_partkey % 8 as key, count(*) filter (l_returnflag <> 'R') as n, count(*) filter (l_returnflag = 'A') as k from '@lineitem.parquet' group by l_partkey""")

    def likelihood(s, mu, m):
        a, b, g = mu * m, (1 - mu) * m, math.lgamma
        return sum(g(k + a) - g(a) + g(n - k + b) - g(b) - g(n + m) + g(m) for n, k in zip(s["n"], s["k"]) if n)

    got = collected(spark, "beta_binomial_mle", "key")
    assert len(got) == 8
    for _, r in got.iterrows():
        s = sites[sites["key"] == r["key"]]
        best = likelihood(s, r["mu"], r["m"])
        around = [(r["mu"] + a, r["m"] * f) for a in (-0.02, -0.005, 0, 0.005, 0.02) for f in (0.5, 0.9, 1, 1.1, 2)]
        assert all(likelihood(s, mu, m) <= best + 1e-6 * abs(best) for mu, m in around)


def test_predicted_rows(spark, e):
    ids, x = e
    at = {i: r for i, r in zip(ids.tolist(), x)}
    got = collected(spark, "predicted_rows", "row_idx")
    for i, error, relative in got[["row_idx", "error", "relative"]].itertuples(index=False):
        y, p = at[i], at[i + 1]
        c = p[:32] - p[:32].mean()
        slope = (c * (y[:32] - y[:32].mean())).sum() / ((c * c).sum() + 1e-6)
        miss = y[32:] - y[:32].mean() - slope * (p[32:] - p[:32].mean())
        assert error == pytest.approx((miss**2).mean(), abs=1e-8) and relative == pytest.approx((miss**2).mean() / ((y[32:] - y[:32].mean()) ** 2).mean(), abs=1e-8)
    assert len(got) == len(x) - 1


def lloyd(x, centres, rounds):
    for _ in range(rounds):
        own = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.stack([x[own == c].mean(0) if (own == c).any() else centres[c] for c in range(len(centres))])
    return centres


def test_kmeans_assignments(spark, e):
    ids, x = e
    m = engine.matrix_e(spark, FOLDER)
    _, rows = kmeans.seeds(m, 10)
    r = kmeans.kmeans(m, kmeans.KMeansConfig(10, max_iterations=10))
    assert rows == r.seed_rows and len(set(rows)) == 10
    at = {i: k for k, i in enumerate(ids.tolist())}
    centres = lloyd(x, x[[at[i] for i in rows]], r.iterations if r.iterations == 10 else r.iterations - 1)
    got = collected(spark, "kmeans_fixed_iters", "row_idx")
    d = ((x[:, None] - centres[None]) ** 2).sum(2)
    assert (got["cluster"].to_numpy() == d.argmin(1)).all() and np.allclose(got["d2"], d.min(1))


def test_parallel_seeds(spark, e):
    ids, x = e
    m = engine.matrix_e(spark, FOLDER)
    centres, rows = kmeans.parallel_seeds(m, 20)
    at = {i: k for k, i in enumerate(ids.tolist())}
    assert len(set(rows)) == 20 and np.allclose(centres, x[[at[i] for i in rows]])
    cost = lambda c: ((x[:, None] - c[None]) ** 2).sum(2).min(1).sum()
    drawn = [cost(x[np.random.default_rng(s).choice(len(x), 20, replace=False)]) for s in range(20)]
    assert cost(centres) < np.median(drawn)
    got = collected(spark, "kmeans_parallel_seeds", "cluster")
    assert got["n"].sum() == len(x) and len(got) == 20
    few = m.with_df(spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(9)], "row_idx bigint, v array<double>"), m.cols[:2])
    assert len({tuple(c) for c in kmeans.parallel_seeds(few, 5)[0]}) == 3
