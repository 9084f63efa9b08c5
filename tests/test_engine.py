"""Operators against plain numpy on small matrices, and the invariants that they keep."""

import gzip
import math
import struct

import numpy as np
import pytest

from matloom.functions import curves, distributions
from matloom.matrix import BigMatrix
from matloom.operators import bins, factor, joins, kmeans, order, pairwise, rowops, select, stats, tests_stat
from matloom.plans.catalog import Catalog, Views
from matloom.plans.steps import run_steps
from matloom.sources import files, store
from matloom.streaming import running

SCHEMA = "row_idx bigint, v array<double>"


def of(spark, x, parts=3):
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(x)]
    return BigMatrix.of(spark.createDataFrame(rows, SCHEMA).repartition(parts), len(x[0]) if len(x) else 0)


def back(m):
    return np.array([r["v"] for r in m.df.orderBy("row_idx").collect()])


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(0).normal(size=(60, 8))


def test_row_adjustments(spark, x):
    y = x.copy()
    y[3] = 2.5
    for name, flat in (("zero_mean_unit_sd", 0), ("zero_mean_unit_length", 8**-0.5), ("zero_mean_unit_length_const0", 0)):
        got = back(rowops.adjust_rows(of(spark, y), name))
        assert np.allclose(got[3], flat)
        rest = np.delete(got, 3, 0)
        assert np.allclose(rest.mean(1), 0)
        assert np.allclose(rest.std(1) if name.endswith("sd") else np.linalg.norm(rest, axis=1), 1)


def test_column_sums_must_not_be_zero(spark):
    with pytest.raises(ValueError):
        rowops.divide_by_column_sum(of(spark, [[1, 0], [2, 0]]))
    assert np.allclose(back(rowops.common_library_size(of(spark, [[1.0, 2], [3, 2]]), 10.0)).sum(0), 10)


def test_column_stats_negative_and_nan(spark):
    m = of(spark, [[-1.0, math.nan], [-3.0, 2.0]])
    got = {r["col"]: r for r in stats.column_stats(m).collect()}
    assert (got[0]["max"], got[0]["min"], got[0]["cnt"]) == (-1, -3, 2) and math.isnan(got[1]["sum"])
    got = {r["col"]: r for r in stats.column_stats(m, skip_nan=True).collect()}
    assert (got[1]["cnt"], got[1]["sum"], got[1]["max"]) == (1, 2, 2)
    assert stats.column_stats(m.rows(5, 5)).count() == 0


def test_selection(spark, x):
    m = of(spark, x)
    assert np.allclose(back(m.rows(5, 9).columns([3, 1])), x[5:9][:, [2, 0]])
    assert [r["row_idx"] for r in select.take_rows(m, [4, 4, 99, 1]).orderBy("pos").collect()] == [4, 4, 1]
    assert select.rows_max_above(of(spark, [[math.nan, 1], [3, 0]]), 2).df.count() == 1
    assert select.rows_max_above(m, 0, statistic="sum").df.count() == 0
    assert select.rows_with_signal(m, 0.5, 3).df.count() == ((x > 0.5).sum(1) >= 3).sum()
    assert len(select.rows_with_signal(m, 0.0, 1, sample=5).df.collect()) == 5
    with pytest.raises(ValueError):
        select.gather_ranges(m, [(0, 5), (4, 6)])
    with pytest.raises(Exception, match="same rows"):
        a = m.df.selectExpr("row_idx", "v[0] as value")
        select.vectors_to_matrix([a, a.where("row_idx > 3")]).df.collect()
    assert select.parse_ids("1-3, 7") == [1, 2, 3, 7] and select.parse_groups("[1,2],[4-5]") == [[1, 2], [4, 5]]


def test_joins(spark, x):
    m = of(spark, x)
    assert joins.bind_columns(m, m).n_cols == 16
    with pytest.raises(Exception, match="domains differ"):
        joins.bind_columns(m, m.rows(0, 3)).df.collect()
    points = spark.createDataFrame([(p,) for p in range(0, 100, 7)], "p int")
    ranges = spark.createDataFrame([(1, 30, 60), (2, 0, 5), (3, 50, 50)], "id int, a int, z int")
    got = {(r["p"], r["id"]) for r in joins.in_ranges(points, ranges, "p", "a", "z", 16).collect()}
    assert got == {(p, i) for p in range(0, 100, 7) for i, a, z in ((1, 30, 60), (2, 0, 5)) if a <= p < z}


def test_pairwise(spark, x):
    m = of(spark, x + 1e6, parts=40)
    assert np.allclose(pairwise.pearson(m), np.corrcoef(x.T), atol=1e-7)
    assert np.allclose(pairwise.euclidean(of(spark, x)), np.sqrt(((x[:, :, None] - x[:, None, :]) ** 2).sum(0)))
    g = pairwise.gram(of(spark, x), centre_rows=True)
    assert np.allclose(g, g.T) and np.linalg.eigvalsh(g).min() > -1e-9


def test_anova_and_welch(spark, x):
    groups = [[0, 1, 2], [4, 5], [6, 7]]  # column 3 is not covered
    got = np.array([r["f"] for r in tests_stat.row_anova(of(spark, x), groups).orderBy("row_idx").collect()])
    for i, row in enumerate(x):
        cov = row[[j for g in groups for j in g]]
        ssb = sum(len(g) * (row[g].mean() - cov.mean()) ** 2 for g in groups)
        ssw = sum(((row[g] - row[g].mean()) ** 2).sum() for g in groups)
        assert got[i] == pytest.approx((ssb / 2) / (ssw / 4))
    assert np.isnan(tests_stat.anova(np.ones((1, 8)), groups))[0]
    r = tests_stat.row_welch(of(spark, [[1.0, 2, 3, 4, 10, 11, 12, 15], [1.0] * 4 + [2.0] * 4]), [(range(4), range(4, 8))]).orderBy("row_idx").collect()
    assert r[0]["t"] == pytest.approx(-9.5 / (5 / 12 + 14 / 12) ** 0.5)
    assert 0 < r[0]["p"] < 0.01 and math.isnan(r[1]["t"])


def test_distributions():
    assert distributions.critical_f(0.05, 3, 60) == pytest.approx(2.7581, abs=1e-3)
    assert distributions.critical_f(0.01, 5, 10) == pytest.approx(5.6363, abs=1e-3)
    assert distributions.t_two_sided(2.2281, 10) == pytest.approx(0.05, abs=1e-4)
    assert distributions.beta_inc(2, 3, 0.5) == pytest.approx(0.6875)
    assert distributions.sign_test(2, 10) == pytest.approx(0.109375)
    assert distributions.sign_test(5, 10) == 1.0


def test_curves():
    shares, null = curves.explained_fractions([3, 1, 1e-9], np.array([[2.0], [2.0], [5.0]]))
    assert np.allclose(shares, [0.75, 0.25, 0]) and np.allclose(null[:, 0], [0.5, 0.5, 0])
    f = curves.f_of_k([100, 40, 0, 0], 2)
    assert f[0] == 1 and f[1] == pytest.approx(40 / (100 * 0.625)) and f[3] == 1
    d = np.array([[0, 1, 9, 9], [1, 0, 9, 9], [9, 9, 0, 2], [9, 9, 2, 0.0]])
    merges = curves.complete_linkage(d)
    assert [m[2] for m in merges] == [1, 2, 9] and curves.cut_tree(merges, 4, 2) == [0, 0, 1, 1]
    assert curves.purity([0, 0, 1, 1], [0, 0, 1, 0]) == 0.75


def test_bins(spark):
    b = bins.bin_map(spark, [("chr1", 25), ("chr2", 10)], 10)
    assert [tuple(r) for r in b.orderBy("start_bin").collect()] == [("chr1", 25, 0, 3), ("chr2", 10, 3, 4)]
    reads = [("chr1", 0, 4, True), ("chr1", 24, 30, True), ("chr2", 8, 9, True), ("chr2", 0, 1, False), ("chrX", 0, 5, True), ("chr1", 18, 22, True)]
    df = spark.createDataFrame(reads, "ref string, start bigint, end bigint, is_mapped boolean")
    assert [r["count"] for r in bins.count_midpoints(df, b, 10).orderBy("bin").collect()] == [1, 0, 1, 1]
    got = {(r["bin"], r["offset"]): r["count"] for r in bins.coverage(df.where("is_mapped"), b, 10, spark.createDataFrame([(1,), (2,)], "bin bigint")).collect()}
    assert len(got) == 15 and got[(1, 8)] == 1 and got[(1, 7)] == 0 and got[(2, 1)] == 1 and got[(2, 4)] == 1
    flags = spark.createDataFrame([("c", 0, 10), ("c", 5, 20), ("c", 7, 8), ("c", 30, 40)], "ref string, start bigint, end bigint")
    assert bins.flagged_units(flags, "c", 3, 35).first()["n"] == 22
    rng = np.random.default_rng(4)
    pos = rng.integers(0, 5000, 300).tolist()
    sites = spark.createDataFrame([("r", p) for p in pos] + [("q", 3)], "ref string, pos bigint")
    got = sorted((r["pos"], r["n"]) for r in bins.centred_windows(sites, 6).where("ref = 'r'").collect())
    assert got == sorted((p, sum(p - 3 <= q <= p + 2 for q in pos)) for p in pos)
    got = sorted((r["pos"], r["n"]) for r in bins.centred_windows(sites, 5, by="sites").where("ref = 'r'").collect())
    assert got == sorted((p, min(k + 2, 299) - max(k - 2, 0) + 1) for k, p in enumerate(sorted(pos)))
    assert sorted(["chr10", "chr2", "chr1"], key=bins.natural_key) == ["chr1", "chr2", "chr10"]


def test_beta_binomial(spark):
    rng = np.random.default_rng(1)
    p = rng.beta(6, 4, 800)
    rows = [(0, 30, int(rng.binomial(30, q))) for q in p]
    counts = spark.createDataFrame(rows, "key int, total bigint, methylated bigint")
    got = bins.beta_binomial_moments(counts).first()
    assert got["mu"] == pytest.approx(0.6, abs=0.03) and got["m"] == pytest.approx(10, rel=0.3)
    mle = bins.beta_binomial_mle(counts, "key").first()
    assert mle["mu"] == pytest.approx(0.6, abs=0.03) and mle["m"] == pytest.approx(10, rel=0.25)
    assert bins.beta_binomial_moments(counts.limit(0)).first()["mu"] is None


def test_order(spark):
    df = spark.createDataFrame([(0, 2.0), (1, math.nan), (2, 5.0), (3, 2.0)], "row_idx bigint, value double")
    assert [r["row_idx"] for r in order.arg_sort(df, "value", descending=True).orderBy("rank").collect()] == [2, 0, 3, 1]
    assert [r["row_idx"] for r in order.arg_sort(df, "value").orderBy("rank").collect()] == [0, 3, 2, 1]
    ranks = {r["row_idx"]: r["rank"] for r in order.average_rank(df.where("not isnan(value)"), "value").collect()}
    assert ranks == {0: 1.5, 3: 1.5, 2: 3.0}


def test_kmeans(spark):
    rng = np.random.default_rng(3)
    centres = np.array([[0, 0, 0], [10, 0, 0], [0, 10, 0.0]])
    x = np.concatenate([c + rng.normal(size=(40, 3)) * 0.1 for c in centres])
    m = of(spark, x)
    r = kmeans.kmeans(m, kmeans.KMeansConfig(3))
    assert sorted(r.counts.tolist()) == [40, 40, 40] and all(a >= b - 1e-9 for a, b in zip(r.history, r.history[1:])) and r.explained > 0.99
    again = kmeans.kmeans(of(spark, x, parts=7), kmeans.KMeansConfig(3))
    assert again.seed_rows == r.seed_rows and np.allclose(again.centroids, r.centroids)
    table = kmeans.results_table(spark, kmeans.kmeans_batch(m, [1, 2, 3, 4], max_iterations=10), 3).collect()
    assert min(table, key=lambda t: t["fk"])["k"] == 3
    unit = kmeans.prepared(m, "correlation")
    assert np.allclose(np.linalg.norm(back(unit), axis=1), 1)
    with pytest.raises(ValueError):
        kmeans.prepared(BigMatrix(m.df, ()), "euclidean")


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(5)
    w = rng.normal(size=(8, 1))
    w -= w.mean()
    rows = 400
    b = np.zeros((rows, 8))
    b[200:, 4:] = rng.normal(size=(200, 1)) * 2  # two groups of four, the first half of the rows are controls
    a = rng.normal(size=(rows, 1)) * 3
    return w, b, a @ w.T, b + a @ w.T + rng.normal(size=(rows, 8)) * 0.05 + 7


def test_factor_model(spark, planted):
    w, b, wa, y = planted
    m = of(spark, y)
    groups = [[0, 1, 2, 3], [4, 5, 6, 7]]
    controls = spark.range(200).selectExpr("id as row_idx", "true as is_control")
    p = w @ np.linalg.pinv(w)
    for model in (factor.fit_ruvg(m, controls, permutations=2, groups=groups), factor.fit_ruvs(m, groups, controls)):
        assert np.allclose(model.projector(1), p, atol=0.05)
        assert model.choose_k(0.15)[0] == 1
        assert np.allclose(factor.FactorModel.from_json(model.to_json()).projector(1), model.projector(1))
    assert model.eigenvalues[0] > 10 * model.eigenvalues[1]
    parts = {c: back(factor.component(m, model, c, 1, artifact="adjusted")) for c in ("artifact", "signal", "random", "signal_random")}
    assert np.allclose(parts["artifact"] + parts["signal"] + parts["random"], y)
    assert np.allclose(parts["signal"] + parts["random"], parts["signal_random"])
    assert np.abs(parts["random"]).max() < 0.5
    v = factor.decompose_variance(m, model, [(0, 0), (1, 0)], artifact="adjusted").orderBy("k").collect()
    assert v[1]["e"] < 0.02 < v[0]["e"] and v[1]["ss_b"] == pytest.approx(v[1]["b_ss_bl"] + v[1]["b_ss_wl"])
    known = factor.fit_ruvs(m, groups, known=np.array([[0, 0, 1, 1, 0, 0, 1, 1]]))
    assert known.factors(1, 1).shape == (8, 2) and known.factors(0).shape == (8, 1)
    with pytest.raises(ValueError):
        model.projector(99)


def test_permutations_do_not_depend_on_the_split(spark, planted):
    y = planted[3]
    a = factor.fit_ruvg(of(spark, y, 2), permutations=1).permuted
    b = factor.fit_ruvg(of(spark, y, 5), permutations=1).permuted
    assert np.allclose(a, b)


def test_control_rows(spark):
    m = of(spark, [[1, 2], [5, 6], [40, 1], [math.nan, 5]])
    got = lambda **k: [r["is_control"] for r in factor.control_rows(m, **k).orderBy("row_idx").collect()]
    assert got(method="weak-signal") == [False, True, False, False]
    assert got(method="specified-rows", rows=spark.createDataFrame([(2,)], "row_idx bigint")) == [False, False, True, False]
    assert got(method="quantile", quantiles=[2, 7], fraction=1.0) == [True, False, False, False]


def test_many_small_binary_files_share_tasks(spark, tmp_path):
    x = np.arange(1507 * 3, dtype=float).reshape(-1, 3)  # 301 files of five rows and one of two
    m, prefix, sc = of(spark, x), str(tmp_path / "s"), spark.sparkContext
    sc.setJobGroup("small files", "")
    try:
        written = files.write_binary(m, prefix, len(x), limit=5 * 24)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(n for _, n in written) == [2] + [5] * 301 and len({p for p, _ in written}) == 302
    for i in (0, 150, 301):
        assert (np.fromfile(f"{prefix}_{i}.bfv").reshape(-1, 3) == x[5 * i : 5 * i + 5]).all()
    tracker = sc.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("small files") for s in tracker.getJobInfo(j).stageIds]
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert stages and max(s.numTasks for s in stages if s) <= max(few, m.df.rdd.getNumPartitions())
    read = files.binary_matrix(spark, prefix, len(x), 3, limit=5 * 24, chunk_bytes=2 * 24)
    assert read.df.rdd.getNumPartitions() <= few and (back(read) == x).all()


def test_text_and_binary(spark, tmp_path, x):
    text = "\n".join("\t".join(["id", *map(repr, map(float, r))]) for r in x)
    (tmp_path / "m.txt").write_text("h\t" + "\t".join(f"n{j}" for j in range(8)) + "\n" + text + "\n\n")
    m = files.text_matrix(spark, str(tmp_path / "m.txt"), n_rows=60, skip_cols=1, skip_rows=1, col_names=True)
    assert np.allclose(back(m), x) and m.cols[0] == (1, "n0")
    (tmp_path / "bad.txt").write_text("1 2\n3\n")
    with pytest.raises(Exception, match="not a row"):
        files.text_matrix(spark, str(tmp_path / "bad.txt")).df.collect()
    (tmp_path / "ids.txt").write_text("5\n1\n5\n")
    assert [r["row_idx"] for r in files.row_ids(spark, str(tmp_path / "ids.txt"), 1).orderBy("pos").collect()] == [4, 0, 4]
    for limit, n in ((1 << 30, 1), (64 * 20, 3), (64 * 7, 9)):  # 20 rows a file divide 60 evenly
        prefix = str(tmp_path / f"b{limit}")
        assert len(files.write_binary(m, prefix, 60, limit=limit)) == n
        assert np.allclose(back(files.binary_matrix(spark, prefix, 60, 8, limit=limit, chunk_bytes=300)), x)
    np.arange(5, dtype="<i4").tofile(tmp_path / "v.bfv")
    assert [r["value"] for r in files.binary_vector(spark, str(tmp_path / "v"), 5).orderBy("row_idx").collect()] == [0, 1, 2, 3, 4]
    with pytest.raises(Exception, match="ends before"):
        files.binary_matrix(spark, str(tmp_path / "v"), 9, 1, "<i4").df.collect()


def test_lines_over_splits(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l/a.txt").write_text("".join(f"a{i}\n" for i in range(5000)))
    (tmp_path / "l/b.txt").write_text("".join(f"b{i}\n" for i in range(9000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {r["value"]: r["line"] for r in files.numbered_lines(spark, str(tmp_path / "l")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert all(got[f"a{i}"] == i for i in range(5000)) and all(got[f"b{i}"] == 5000 + i for i in range(9000))


def test_alignments(spark, tmp_path):
    body = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 100)
    for pos, flag in ((10, 0), (20, 4)):
        rec = struct.pack("<iiBBHHHiiii", 0, pos, 2, 0, 0, 2, flag, 0, -1, -1, 0) + b"r\0" + struct.pack("<II", 5 << 4, 3 << 4 | 1)
        body += struct.pack("<i", len(rec)) + rec
    (tmp_path / "a.bam").write_bytes(gzip.compress(body[:40]) + gzip.compress(body[40:]))
    assert files.bam_references(str(tmp_path / "a.bam")) == [("chr1", 100)]
    got = files.read_bam(spark, [str(tmp_path / "a.bam")]).orderBy("start").collect()
    assert [(r["ref"], r["start"], r["end"], r["is_mapped"]) for r in got] == [("chr1", 10, 15, True), ("chr1", 20, 25, False)]


def test_sheets_and_specs():
    rows = files.sample_sheet("s1, /d, a.bam, g1, x\n# no\ns2, , b.bam, g2\n")
    assert rows[1]["dir"] == "/d" and rows[0]["tags"] == ["x"] and rows[1]["group"] == "g2"
    assert files.parse_spec("text-mat@/a@b/c") == ("text-mat@/a", "b/c")
    with pytest.raises(ValueError):
        files.parse_spec("nothing")


def test_store_steps_and_catalog(spark, tmp_path, x):
    m = of(spark, x)
    store.save_matrix(m, str(tmp_path / "s"))
    assert np.allclose(back(files.load(spark, f"matrix@{tmp_path}/s")), x)
    store.export_rows(m, str(tmp_path / "r"), 2, 5, [8])
    assert np.allclose(back(store.load_output(spark, str(tmp_path / "r")))[:, 0], x[2:5, 7])
    store.export_taken(select.take_rows(m, [9, 9]), m, str(tmp_path / "t"))
    assert np.allclose(back(store.load_output(spark, str(tmp_path / "t"))), x[[9, 9]])
    calls = []
    steps = [("mat", lambda _: calls.append(1) or m), ("log", lambda p: calls.append(2) or p.map(np.abs))]
    run_steps(spark, str(tmp_path / "run"), steps)
    out = run_steps(spark, str(tmp_path / "run"), steps, start_from="2-log")
    assert calls == [1, 2, 2] and np.allclose(back(out), np.abs(x))
    c = Catalog(spark, str(tmp_path / "cat"))
    i = c.create("domain", name="d", size=60)
    c.set("domain", i, size=61)
    assert i == 101 and Catalog(spark, str(tmp_path / "cat")).get("domain", i) == {"name": "d", "size": 61}
    with pytest.raises(KeyError):
        c.get("domain", 7)
    c.remove("domain", i)
    assert c.list("domain") == []
    assert Views().get("vv", lambda: m) is m and spark.table("vv").count() == 60


def test_stream_statistics(spark, tmp_path, x):
    of(spark, x[:30]).df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = running.keep_column_stats(stream, str(tmp_path / "out"), str(tmp_path / "cp"), 8)
    q.processAllAvailable()
    rest = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x[30:], 30)], SCHEMA)
    rest.write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    got = {r["col"]: r for r in running.current_stats(spark, str(tmp_path / "out")).collect()}
    assert got[2]["cnt"] == 60 and got[2]["sum"] == pytest.approx(x[:, 2].sum())


def test_stream_statistics_keep_nan(spark):
    kind = "col int, cnt bigint, min double, max double, sum double"
    parts = spark.createDataFrame([(0, 2, float("nan"), float("nan"), float("nan")), (0, 3, 1.0, 4.0, 6.0), (1, 1, 2.0, 2.0, 2.0)], kind)
    got = {r["col"]: r for r in running.merge_stats(parts).collect()}
    assert all(np.isnan(got[0][c]) for c in ("min", "max", "sum")) and got[0]["cnt"] == 5 and got[1]["min"] == 2.0


def test_quantiles_of_ties_and_nan(spark):
    rng = np.random.default_rng(5)
    columns = {0: rng.integers(0, 4, 501).astype(float), 1: rng.normal(size=200), 2: np.array([7.0])}
    rows = [(c, float(v)) for c, x in columns.items() for v in x] + [(1, float("nan")), (2, None)]
    at = [0.0, 0.1, 0.5, 0.503, 1.0]
    got = {(r["col"], r["fraction"]): r["value"] for r in stats.quantiles(spark.createDataFrame(rows, "col int, value double"), at).collect()}
    assert len(got) == 15 and all(got[c, f] == pytest.approx(np.quantile(x, f)) for c, x in columns.items() for f in at)


def test_hot_positions_in_windows(spark):
    rng = np.random.default_rng(6)
    pos = np.concatenate([np.full(500, 1000), rng.integers(0, 3000, 200)])
    got = sorted((r["pos"], r["n"]) for r in bins.centred_windows(spark.createDataFrame([("a", int(p)) for p in pos], "ref string, pos bigint"), 101).collect())
    assert got == sorted((int(p), int(((pos >= p - 50) & (pos <= p + 50)).sum())) for p in pos)


def test_models_are_checked_when_opened(spark, planted):
    m, groups = of(spark, np.random.default_rng(7).normal(size=(40, 6))), [[0, 1, 2], [3, 4, 5]]
    model = factor.fit_ruvs(m, groups, known=np.array([[1, 0, 1, 0, 1, 0]]))
    again = factor.FactorModel.from_json(model.to_json())
    assert np.allclose(back(factor.component(m, again, "artifact", 1, 1)), back(factor.component(m, model, "artifact", 1, 1)))
    import json

    for change in ({"kind": "other"}, {"groups": [[0, 9]]}, {"groups": [[0, 1], [1]]}, {"known": [[1.0]]}, {"b": None}, {"eigenvalues": [1.0, 2.0]}):
        with pytest.raises(ValueError):
            factor.FactorModel.from_json(json.dumps(json.loads(model.to_json()) | change))
    for bad in ({"which": "noise"}, {"scale": "cube"}, {"adjust": "none"}, {"columns": [9]}, {"k": 99}):
        with pytest.raises(ValueError):
            factor.component(m, model, **({"which": "artifact", "k": 1} | bad))
    with pytest.raises(ValueError):
        factor.component(m.columns([1, 2]), model, "artifact", 1)
    unit = factor.fit_ruvg(m, adjust="zero_mean_unit_length")
    assert unit.eigenvalues.sum() == pytest.approx(40)


def test_catalog_writers_do_not_lose_records(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "cat")
    with ThreadPoolExecutor(4) as pool:
        ids = list(pool.map(lambda k: Catalog(spark, path).create("stats", k=k), range(8)))
    c = Catalog(spark, path)
    assert sorted(ids) == [i for i, _ in c.list("stats")] == list(range(101, 109)) and {r["k"] for _, r in c.list("stats")} == set(range(8))
    c.vacuum("stats")
    assert len(c.list("stats")) == 8 and len(c._versions("stats")) == 2


def test_alignments_to_counts(spark, tmp_path):
    """A list of files to a matrix of counts, over the references that all have, in natural order."""
    import gzip
    import struct

    def bam(name, refs, reads):
        head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", len(refs))
        for r, n in refs:
            head += struct.pack("<i", len(r) + 1) + r.encode() + b"\0" + struct.pack("<i", n)
        body = b""
        for ref, pos, length, flag in reads:
            rec = struct.pack("<iiBBHHHiiii", ref, pos, 2, 30, 0, 1, flag, 0, -1, -1, 0) + b"r\0" + struct.pack("<I", length << 4)
            body += struct.pack("<i", len(rec)) + rec
        (tmp_path / name).write_bytes(gzip.compress(head + body))

    bam("a.bam", [("chr10", 250), ("chr2", 120), ("chrX", 50)], [(0, 0, 10, 0), (0, 90, 40, 0), (1, 119, 1, 0), (2, 5, 5, 0), (1, 10, 10, 4)])
    bam("b.bam", [("chr2", 120), ("chr10", 250)], [(0, 0, 10, 0), (0, 0, 10, 0), (1, 200, 40, 0), (-1, -1, 0, 4)])
    (tmp_path / "list.txt").write_text("# files\na.bam\n" + str(tmp_path / "b.bam") + "\n")
    m = files.load(spark, f"bams@{tmp_path}/list.txt", width=100)
    assert [n for _, n in m.cols] == ["a.bam", "b.bam"]
    # bins: chr2 has 0 and 1, chr10 has 2, 3 and 4
    assert back(m).tolist() == [[0, 2], [1, 0], [1, 0], [1, 0], [0, 1]]
    assert back(files.load(spark, f"bams@{tmp_path}/list.txt", width=100, refs=["chr10"])).tolist() == [[1, 0], [1, 0], [0, 1]]
    with pytest.raises(ValueError):
        files.load(spark, f"bams@{tmp_path}/list.txt", width=100, refs=["chrX"])
    with pytest.raises(ValueError):
        files.load(spark, "other@x")
    files.ALIASES["other"] = "bams"
    try:
        assert back(files.load(spark, f"other@{tmp_path}/list.txt", width=1000)).shape == (2, 2)
    finally:
        del files.ALIASES["other"]


def test_alignments_in_splits(spark, tmp_path):
    """However a file of blocks is split, every record is read once."""
    import zlib

    rng = np.random.default_rng(8)
    refs = [("chr1", 100_000), ("chr2", 50_000)]
    data, expected = b"BAM\1" + struct.pack("<i", 5) + b"@HD\n\0" + struct.pack("<i", 2), []
    for r, n in refs:
        data += struct.pack("<i", len(r) + 1) + r.encode() + b"\0" + struct.pack("<i", n)
    for k in range(3000):
        ref, pos, flag = int(rng.integers(-1, 2)), int(rng.integers(0, 40_000)), int(rng.choice([0, 4, 16]))
        ops = [(int(n), int(o)) for n, o in zip(rng.integers(1, 60, rng.integers(0, 4)), rng.integers(0, 9, 4))]
        name, l_seq = f"read{k}".encode() + b"\0", int(rng.integers(0, 120))
        rec = struct.pack("<iiBBHHHiiii", ref, pos, len(name), 30, 0, len(ops), flag, l_seq, -1, -1, 0) + name
        rec += b"".join(struct.pack("<I", n << 4 | o) for n, o in ops) + rng.integers(0, 256, (l_seq + 1) // 2 + l_seq, dtype=np.uint8).tobytes()
        data += struct.pack("<i", len(rec)) + rec
        expected.append((refs[ref][0] if ref >= 0 else None, pos, pos + sum(n for n, o in ops if o in (0, 2, 3, 7, 8)), not flag & 4))
    out, at = b"", 0
    while at <= len(data):
        part = data[at : at + int(rng.integers(300, 3000))]
        at += len(part) or 1
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    (tmp_path / "x.bam").write_bytes(out)
    key = lambda r: (r[0] or "", *r[1:])
    for step in (64 << 20, 50_000, 7_000, 1_000):
        got = [(r["ref"], r["start"], r["end"], r["is_mapped"]) for r in files.read_bam(spark, [str(tmp_path / "x.bam")], step).collect()]
        assert sorted(got, key=key) == sorted(expected, key=key), step


def test_batches_records_and_conditions(spark, tmp_path, x):
    got = list(store.read_batches(of(spark, x), 25))
    assert [len(i) for i, _ in got] == [25, 25, 10] and np.allclose(np.concatenate([v for _, v in got]), x)
    assert list(store.read_batches(of(spark, x).rows(70, 80))) == []
    lines = [f"{kind}{k}" for k in range(10) for kind in "@A+I"]
    (tmp_path / "r.fastq").write_text("\n".join(lines) + "\n")
    assert files.split_records(spark, str(tmp_path / "r.fastq"), str(tmp_path / "parts"), 4) == 3
    for k, n in enumerate((16, 16, 8)):
        assert [r["value"] for r in files.numbered_lines(spark, str(tmp_path / "parts" / f"part={k}")).orderBy("line").collect()] == lines[16 * k : 16 * k + n]
    (tmp_path / "cut.fastq").write_text("@\nA\n+\n")
    with pytest.raises(ValueError):
        files.split_records(spark, str(tmp_path / "cut.fastq"), str(tmp_path / "no"), 4)
    model = factor.fit_ruvs(of(spark, x), [[0, 1], [2, 3, 4]])
    assert [c["columns"] for c in model.conditions()] == [[0, 1], [2, 3, 4], [5], [6], [7]] and model.conditions("abcdefgh")[1]["samples"] == ["c", "d", "e"]
    assert np.allclose(model.wt(2), model.factors(2).T)
