"""Queries over the driver's tables, each with the SQL that says the same where SQL can.

Matrices (FIXTURES.md): E embeddings; U users by event types, counts; P parts by ship years, sums
of quantities; G events as positions on one reference per type.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .matrix import BigMatrix
from .operators import bins as B
from .operators import factor, joins, kmeans, order, pairwise, rowops, select, stats, tests_stat
from .scratch import materialize, scratch_path
from .sources import files, store

YEARS = range(1995, 2002)
BIN = 3600
MONTH = 31 * 86400
GROUPS = [list(range(a, a + 16)) for a in range(0, 64, 16)]
CONTROL_P = 0.05


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def matrix_e(spark: SparkSession, d: str) -> BigMatrix:
    e = _table(spark, d, "embeddings")
    return BigMatrix.of(e.select(F.col("vec_id").alias("row_idx"), F.col("embedding").cast("array<double>").alias("v")), 64)


def matrix_u(spark: SparkSession, d: str) -> BigMatrix:
    events = _table(spark, d, "events")
    types = sorted(r[0] for r in events.select("event_type").distinct().collect())  # the columns
    place = F.create_map(*(x for j, t in enumerate(types) for x in (F.lit(t), F.lit(j))))
    return BigMatrix.from_long(events.select(F.col("user_id").alias("row_idx"), place[F.col("event_type")].alias("col"), F.lit(1.0).alias("value")), len(types), names=types)


def matrix_p(spark: SparkSession, d: str) -> BigMatrix:
    sold = _table(spark, d, "lineitem").select(F.col("l_partkey").alias("row_idx"), (F.year("l_shipdate") - YEARS[0]).alias("col"), F.col("l_quantity").alias("value"))
    every = _table(spark, d, "part").select(F.col("p_partkey").alias("row_idx"), F.lit(0).alias("col"), F.lit(0.0).alias("value"))
    return BigMatrix.from_long(sold.unionByName(every), len(YEARS), names=[str(y) for y in YEARS])


def points_g(spark: SparkSession, d: str) -> DataFrame:
    pos = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))
    return _table(spark, d, "events").select(F.col("event_type").alias("ref"), pos.alias("start"), (pos + 1 + F.col("event_id") % 100).alias("end"), F.lit(True).alias("is_mapped"), "event_id", "user_id")


def bins_g(spark: SparkSession, d: str) -> DataFrame:
    refs = sorted((r[0] for r in _table(spark, d, "events").select("event_type").distinct().collect()), key=B.natural_key)
    return B.bin_map(spark, [(r, MONTH) for r in refs], BIN)


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def _long(m: BigMatrix) -> DataFrame:
    return m.long().select("row_idx", F.col("col").cast("bigint").alias("col"), _r("value").alias("value"))


E = "e AS (SELECT vec_id AS row_idx, unnest(range(len(embedding))) AS col, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"
U = """ty AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS col FROM (SELECT DISTINCT event_type FROM events)),
u AS (SELECT us.row_idx, ty.col, CAST(count(ev.event_id) AS DOUBLE) AS value
      FROM (SELECT DISTINCT user_id AS row_idx FROM events) AS us CROSS JOIN ty
      LEFT JOIN events AS ev ON ev.user_id = us.row_idx AND ev.event_type = ty.event_type GROUP BY ALL)"""
P = """p AS (SELECT part.p_partkey AS row_idx, y.col, coalesce(sum(l_quantity), 0) AS value
      FROM part CROSS JOIN (SELECT unnest(range(7)) AS col) AS y
      LEFT JOIN lineitem ON l_partkey = p_partkey AND year(l_shipdate) - 1995 = y.col GROUP BY ALL)"""
G = """g AS (SELECT event_type AS ref, CAST(floor(epoch(ts) - epoch(TIMESTAMP '2024-01-01')) AS BIGINT) AS s, event_id, user_id FROM events),
refs AS (SELECT ref, (row_number() OVER (ORDER BY ref) - 1) * 744 AS start_bin FROM (SELECT DISTINCT ref FROM g))"""
LONG = "SELECT row_idx, CAST(col AS BIGINT) AS col, round({}, 6) + 0.0 AS value FROM {}"


def _rows(what: str, of: str) -> str:
    return LONG.format(what, of)


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


STATS = "CAST(col AS BIGINT) AS col, count(*) AS cnt, round(min(value), 6) AS min, round(max(value), 6) AS max, round(sum(value), 6) + 0.0 AS sum"


def _stats(df: DataFrame) -> DataFrame:
    return df.select(F.col("col").cast("bigint").alias("col"), "cnt", _r("min").alias("min"), _r("max").alias("max"), _r("sum").alias("sum"))


@query(f"WITH {E} SELECT {STATS} FROM e GROUP BY col")
def column_stats(spark, d):
    return _stats(stats.column_stats(matrix_e(spark, d)))


@query(f"WITH {E} SELECT {STATS} FROM e WHERE value <= 0.1 GROUP BY col")
def column_stats_nan(spark, d):
    e = matrix_e(spark, d).map(lambda x: np.where(x > 0.1, np.nan, x))
    return _stats(stats.column_stats(e, skip_nan=True))


@query(f"WITH {E} SELECT row_idx, CASE col WHEN 2 THEN 0 ELSE 1 END AS col, round(value, 6) + 0.0 AS value FROM e WHERE row_idx >= 10 AND row_idx < 60 AND col IN (0, 2)")
def row_range_cols(spark, d):
    return _long(select.read_block(matrix_e(spark, d), 10, 60, [3, 1])).withColumn("col", F.col("col").cast("int"))


IDS = [5, 3, 3, 42, 0, 17]


@query(f"WITH {E}, ids AS (SELECT unnest(range({len(IDS)})) AS pos, unnest({IDS}) AS row_idx) SELECT pos, row_idx, CAST(col AS BIGINT) AS col, round(value, 6) + 0.0 AS value FROM ids JOIN e USING (row_idx)")
def take_rows_in_order(spark, d):
    got = select.take_rows(matrix_e(spark, d), IDS)
    return got.select("pos", "row_idx", F.posexplode("v").alias("col", "value")).select("pos", "row_idx", F.col("col").cast("bigint").alias("col"), _r("value").alias("value"))


@query(f"WITH {E} " + _rows("value", "e WHERE row_idx < 5 OR row_idx >= 20 AND row_idx < 30 OR row_idx >= 400 AND row_idx < 410"))
def multi_range_gather(spark, d):
    return _long(select.gather_ranges(matrix_e(spark, d), [(20, 30), (0, 5), (400, 410)]))


@query(f"WITH {E}, w AS (SELECT unnest(range(4)) AS col, unnest([7, -1, 0, 7]) AS old, unnest(range(4)) AS k) SELECT r.row_idx, CAST(w.col AS BIGINT) AS col, CASE WHEN old < 0 THEN CAST('NaN' AS DOUBLE) ELSE round(e.value, 6) + 0.0 END AS value FROM (SELECT DISTINCT row_idx FROM e) AS r CROSS JOIN w LEFT JOIN e ON e.row_idx = r.row_idx AND e.col = w.old")
def rearrange_cols_nan(spark, d):
    return _long(select.rearrange_columns(matrix_e(spark, d), [7, -1, 0, 7]))


@query(f"WITH {U} " + _rows("value", "u WHERE col IN (0, 1)"))
def vectors_to_matrix(spark, d):
    u = matrix_u(spark, d)
    cols = [u.columns([j]).df.select("row_idx", F.get("v", F.lit(0)).alias("value")) for j in (1, 2)]
    return _long(select.vectors_to_matrix(cols))


@query(f"WITH {U} SELECT a.row_idx, CAST(a.col AS BIGINT) AS col, round(a.value, 6) AS value FROM (SELECT row_idx, col, value FROM u UNION ALL SELECT row_idx, col + (SELECT count(*) FROM ty), value FROM u) AS a")
def bind_columns(spark, d):
    u = matrix_u(spark, d)
    return _long(joins.bind_columns(u, u))


def _adjusted(flat: str, size: str) -> str:
    return f"""WITH {U}, w AS (SELECT row_idx, col, value - avg(value) OVER r AS c, stddev_pop(value) OVER r AS sd, count(*) OVER r AS n FROM u WINDOW r AS (PARTITION BY row_idx))
SELECT row_idx, CAST(col AS BIGINT) AS col, round(CASE WHEN sd < 2.2e-16 THEN {flat} ELSE c / {size} END, 6) + 0.0 AS value FROM w"""


@query(_adjusted("0", "sd"))
def row_adjust_unit_sd(spark, d):
    return _long(rowops.adjust_rows(matrix_u(spark, d), "zero_mean_unit_sd"))


@query(_adjusted("1 / sqrt(n)", "(sd * sqrt(n))"))
def row_adjust_unit_length(spark, d):
    return _long(rowops.adjust_rows(matrix_u(spark, d), "zero_mean_unit_length"))


@query(_adjusted("0", "(sd * sqrt(n))"))
def row_adjust_unit_length_const0(spark, d):
    return _long(rowops.adjust_rows(matrix_u(spark, d), "zero_mean_unit_length_const0"))


@query(f"WITH {U} " + _rows("value * (1 / sum(value) OVER (PARTITION BY col))", "u"))
def divide_by_column_sum(spark, d):
    return _long(rowops.divide_by_column_sum(matrix_u(spark, d)))


@query(f"WITH {U}, s AS (SELECT col, sum(value) AS s FROM u GROUP BY col) SELECT row_idx, CAST(col AS BIGINT) AS col, round(value * ((SELECT median(s) FROM s) / s.s), 6) AS value FROM u JOIN s USING (col)")
def common_library_size_median(spark, d):
    return _long(rowops.common_library_size(matrix_u(spark, d), "median"))


@query(f"WITH {U} SELECT row_idx, CAST(col AS BIGINT) AS col, round(ln(value + 1), 6) AS mlog, round(exp(ln(value + 1)) - 1, 6) + 0.0 AS back, round(pow(2, ln(value + 1)) - 1, 6) + 0.0 AS back2 FROM u")
def mlog_and_inverse(spark, d):
    logs = rowops.log_counts(matrix_u(spark, d))
    three = [m.long().withColumnRenamed("value", n) for m, n in ((logs, "mlog"), (rowops.counts_of_log(logs), "back"), (rowops.counts_of_log2(logs), "back2"))]
    met = three[0].join(three[1], ["row_idx", "col"]).join(three[2], ["row_idx", "col"])
    return met.select("row_idx", F.col("col").cast("bigint").alias("col"), *(_r(n).alias(n) for n in ("mlog", "back", "back2")))


@query(f"WITH {U}, m AS (SELECT row_idx, avg(value) AS mean FROM u GROUP BY row_idx) SELECT row_idx, CAST(col AS BIGINT) AS col, round(value + mean, 6) AS value FROM u JOIN m USING (row_idx)")
def add_row_means(spark, d):
    from .matrix import map_scalars

    u = matrix_u(spark, d)
    return _long(rowops.add_row_means(u, map_scalars(u.df, lambda x: {"mean": x.mean(1)}, "mean double")))


@query(f"WITH {U} SELECT row_idx FROM u GROUP BY row_idx HAVING max(value) > 18")
def rows_max_over_threshold(spark, d):
    return select.rows_max_above(matrix_u(spark, d), 18.0).df.select("row_idx")


@query(f"WITH {U} SELECT row_idx FROM u GROUP BY row_idx HAVING count(*) FILTER (value > 12) >= 3")
def rows_with_signal(spark, d):
    return select.rows_with_signal(matrix_u(spark, d), 12.0, 3).df.select("row_idx")


@query(f"WITH {U} SELECT row_idx FROM u GROUP BY row_idx HAVING max(value) BETWEEN 12 AND 18")
def weak_signal_rows(spark, d):
    return select.weak_signal_rows(matrix_u(spark, d), 12.0, 18.0).df.select("row_idx")


@query(f"WITH {U} SELECT row_idx FROM u GROUP BY row_idx HAVING max(value) >= 16")
def low_count_filter(spark, d):
    return select.low_count_filter(matrix_u(spark, d), 16.0).df.select("row_idx")


@query(f"WITH {U} " + _rows("CASE WHEN value < 10 THEN 0 ELSE value END", "u"))
def zero_background(spark, d):
    return _long(select.zero_background(matrix_u(spark, d), 10.0))


@query(f"WITH {P} SELECT row_idx, round(var_pop(value), 6) AS variance FROM p GROUP BY row_idx ORDER BY var_pop(value) DESC, row_idx LIMIT 25")
def high_variability_topk(spark, d):
    return select.high_variability_rows(matrix_p(spark, d), 25).select("row_idx", _r("variance").alias("variance"))


@query(f"WITH {P}, q AS (SELECT col, unnest([0.1, 0.5, 0.9]) AS fraction, unnest(quantile_cont(value, [0.1, 0.5, 0.9])) AS value FROM p GROUP BY col) SELECT CAST(col AS BIGINT) AS col, CAST(fraction AS DOUBLE) AS fraction, round(value, 6) AS value FROM q")
def column_quantiles(spark, d):
    return stats.column_quantiles(matrix_p(spark, d), [0.1, 0.5, 0.9]).select(F.col("col").cast("bigint").alias("col"), "fraction", _r("value").alias("value"))


@query(f"WITH {U} SELECT CAST(col AS BIGINT) AS col, CAST(floor(value / 4) AS BIGINT) AS bucket, count(*) AS n FROM u GROUP BY ALL")
def degree_histogram(spark, d):
    return stats.degree_histogram(matrix_u(spark, d), 4.0).select(F.col("col").cast("bigint").alias("col"), "bucket", "n")


@query(f"WITH {P}, f AS (SELECT least(1.0, count(*) FILTER (value < 60) / greatest(count(*) - 1, 1)) AS f FROM p WHERE col = 2), s AS (SELECT col, list(value ORDER BY value) AS x FROM p GROUP BY col), k AS (SELECT col, x, f * (len(x) - 1) AS h FROM s, f) SELECT CAST(col AS BIGINT) AS col, round(x[CAST(floor(h) AS INT) + 1] + (h - floor(h)) * (x[least(CAST(floor(h) AS INT) + 2, len(x))] - x[CAST(floor(h) AS INT) + 1]), 6) AS value FROM k")
def sample_val_by_ref_val(spark, d):
    return stats.values_at_rank_of(matrix_p(spark, d), 2, 60.0).select(F.col("col").cast("bigint").alias("col"), _r("value").alias("value"))


@query("SELECT CAST(p_size AS BIGINT) AS value, p_partkey AS row_idx FROM part WHERE p_size IN (7, 11, 45)")
def value_index_lookup(spark, d):
    return select.lookup_values(select.value_index(_table(spark, d, "part"), "p_partkey", "p_size"), [7, 11, 45])


_PAIR = "SELECT a.col AS a, b.col AS b, {} FROM {x} AS a JOIN {x} AS b ON a.row_idx = b.row_idx AND a.col < b.col GROUP BY a.col, b.col"


def _pair_sql(what: str, of: str) -> str:
    return "SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, value FROM (" + _PAIR.format(f"round({what}, 6) + 0.0 AS value", x=of) + ")"


def _pairs(spark: SparkSession, square: np.ndarray, diagonal: bool = False) -> DataFrame:
    return pairwise.pairs(spark, square, "value", diagonal).select("a", "b", _r("value").alias("value"))


@query(f"WITH {E} " + _pair_sql("corr(a.value, b.value)", "e"))
def pearson_columns(spark, d):
    return _pairs(spark, pairwise.pearson(matrix_e(spark, d)))


@query(f"WITH {E} " + _pair_sql("sqrt(sum((a.value - b.value) * (a.value - b.value)))", "e"))
def euclid_columns(spark, d):
    return _pairs(spark, pairwise.euclidean(matrix_e(spark, d)))


@query(f"WITH {E}, k AS (SELECT e.* FROM e JOIN (SELECT row_idx FROM e GROUP BY row_idx HAVING max(value) > 0.35) USING (row_idx)) " + _pair_sql("corr(a.value, b.value)", "k"))
def pearson_selected_rows(spark, d):
    return _pairs(spark, pairwise.pearson(select.rows_max_above(matrix_e(spark, d), 0.35)))


@query(f"WITH {U}, k AS (SELECT row_idx, col, value - avg(value) OVER (PARTITION BY row_idx) AS value, max(value) OVER (PARTITION BY row_idx) AS top FROM u), c AS (SELECT * FROM k WHERE top BETWEEN 4 AND 30) SELECT CAST(a.col AS INTEGER) AS a, CAST(b.col AS INTEGER) AS b, round(sum(a.value * b.value), 6) + 0.0 AS value FROM c AS a JOIN c AS b ON a.row_idx = b.row_idx AND a.col <= b.col GROUP BY a.col, b.col")
def gram_control_rows(spark, d):
    return _pairs(spark, pairwise.gram(select.weak_signal_rows(matrix_u(spark, d), 4.0, 30.0), centre_rows=True), True)


_ANOVA = f"""WITH {E}, gm AS (SELECT row_idx, col // 16 AS g, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS ss FROM e GROUP BY ALL),
t AS (SELECT row_idx, avg(value) AS gmean FROM e GROUP BY row_idx),
f AS (SELECT row_idx, (sum(n * (m - gmean) * (m - gmean)) / 3) / (sum(ss) / 60) AS f FROM gm JOIN t USING (row_idx) GROUP BY row_idx) """


@query(_ANOVA + "SELECT row_idx, round(f, 6) AS f FROM f")
def row_anova_f(spark, d):
    return tests_stat.row_anova(matrix_e(spark, d), GROUPS).select("row_idx", _r("f").alias("f"))


#: Fixed value: the upper 5 % point of F with 3 and 60 degrees of freedom, as tables have it.
_F_3_60 = 2.758078


@query(_ANOVA + f"SELECT row_idx, f < {_F_3_60} AS is_control FROM f")
def anova_control_flags(spark, d):
    return tests_stat.control_rows_by_anova(matrix_e(spark, d), GROUPS, CONTROL_P).select("row_idx", "is_control")


@query(_ANOVA + "SELECT round(avg(f), 6) AS mean_f, round(median(f), 6) AS median_f, count(*) AS n FROM f")
def anova_summary(spark, d):
    got = tests_stat.f_summary(tests_stat.row_anova(matrix_e(spark, d), GROUPS))
    return got.select(_r("mean_f").alias("mean_f"), _r("median_f").alias("median_f"), "n")


_WELCH = f"""WITH {E}, s AS (SELECT row_idx, avg(value) FILTER (col < 32) AS ma, avg(value) FILTER (col >= 32) AS mb, var_samp(value) FILTER (col < 32) / 32 AS va, var_samp(value) FILTER (col >= 32) / 32 AS vb FROM e GROUP BY row_idx),
t AS (SELECT row_idx, (ma - mb) / sqrt(va + vb) AS t, (va + vb) * (va + vb) / (va * va / 31 + vb * vb / 31) AS df FROM s) """


def _welch(spark, d):
    return tests_stat.row_welch(matrix_e(spark, d), [(range(32), range(32, 64))])


@query(_WELCH + "SELECT row_idx, round(t, 6) + 0.0 AS t, round(df, 4) AS df FROM t")
def welch_t_rows(spark, d):
    return _welch(spark, d).select("row_idx", _r("t").alias("t"), _r("df", 4).alias("df"))


@query(_WELCH + "SELECT round(avg(t * t), 6) AS mse, round(avg(abs(t)), 6) AS mae, count(*) AS n FROM t")
def t_mse_mae(spark, d):
    return tests_stat.t_errors(_welch(spark, d)).select(_r("mse").alias("mse"), _r("mae").alias("mae"), "n")


@query(f"WITH {G}, c AS (SELECT start_bin + ((s + s + 1 + event_id % 100) // 2) // 3600 AS bin, count(*) AS n FROM g JOIN refs USING (ref) WHERE (s + s + 1 + event_id % 100) // 2 < 2678400 GROUP BY ALL) SELECT CAST(b.bin AS BIGINT) AS bin, coalesce(n, 0) AS count FROM (SELECT unnest(range(744 * (SELECT count(*) FROM refs))) AS bin) AS b LEFT JOIN c USING (bin)")
def bin_counts(spark, d):
    return B.count_midpoints(points_g(spark, d), bins_g(spark, d), BIN)


@query(f"WITH {G}, x AS (SELECT DISTINCT ref, start_bin + s // 3600 AS bin, start_bin FROM g JOIN refs USING (ref) WHERE s < 2678400) SELECT CAST(bin AS BIGINT) AS bin, ref, CAST((bin - start_bin) * 3600 AS BIGINT) AS \"from\", CAST(least((bin - start_bin + 1) * 3600, 2678400) AS BIGINT) AS \"to\" FROM x")
def bin_map_lookup(spark, d):
    at = B.located(points_g(spark, d), bins_g(spark, d), BIN, F.col("start"))
    return B.bin_ranges(bins_g(spark, d), at.where("bin >= 0").select("bin").distinct(), BIN)


def _touched(g: DataFrame, b: DataFrame) -> DataFrame:
    ends = [B.located(g, b, BIN, pos).where("bin >= 0").select("bin") for pos in (F.col("start"), F.least(F.col("end"), F.lit(MONTH)) - 1)]
    return ends[0].unionByName(ends[1]).distinct()


@query(f"WITH {G}, r AS (SELECT start_bin, s AS a, least(s + 1 + event_id % 100, 2678400) AS z FROM g JOIN refs USING (ref)) SELECT CAST(start_bin + x // 3600 AS BIGINT) AS bin, CAST(x % 3600 AS BIGINT) AS \"offset\", count(*) AS count FROM r, unnest(range(a, z)) AS t(x) GROUP BY ALL")
def per_unit_coverage(spark, d):
    """The covered units of every bin; per_unit_coverage_all_bins has the others, too."""
    return per_unit_coverage_all_bins(spark, d).where("count <> 0")


@query()
def per_unit_coverage_all_bins(spark, d):
    """Every unit of every bin that an interval touches."""
    g, b = points_g(spark, d), bins_g(spark, d)
    return B.coverage(g, b, BIN, _touched(g, b))


@query(f"WITH {G}, i AS (SELECT s AS a, s + 1 + event_id % 100 AS z FROM g WHERE ref = (SELECT min(ref) FROM g)) SELECT count(DISTINCT x) AS n FROM i, unnest(range(a, z)) AS t(x) WHERE x >= 100000 AND x < 1000000")
def flagged_units(spark, d):
    g = points_g(spark, d)
    return B.flagged_units(g.select("ref", "start", "end"), bins_g(spark, d).agg(F.min("ref")).first()[0], 100_000, 1_000_000)


@query(f"WITH {G}, w AS (SELECT ref, s, user_id, unnest(range(greatest(CAST(floor((s - 86400) / 21600) AS BIGINT) + 1, 0), s // 21600 + 1)) AS win FROM g) SELECT ref, CAST(win AS BIGINT) AS \"window\", count(DISTINCT s) AS n_sites, count(DISTINCT user_id) AS n_reads, max(s) - min(s) + 1 AS span FROM w GROUP BY ref, win")
def sliding_window_descriptors(spark, d):
    return B.window_descriptors(points_g(spark, d).select("ref", F.col("start").alias("pos"), F.col("user_id").alias("read")), 21600, 86400)


@query(f"WITH {G} SELECT ref, s AS pos, count(*) OVER (PARTITION BY ref ORDER BY s RANGE BETWEEN 1800 PRECEDING AND 1799 FOLLOWING) AS n FROM g")
def centred_windows(spark, d):
    return B.centred_windows(points_g(spark, d).select("ref", F.col("start").alias("pos")), 3600)


_METH = """WITH x AS (SELECT l_partkey AS site, l_linestatus = 'O' AS w, CASE l_returnflag WHEN 'A' THEN 'm' WHEN 'N' THEN 'u' ELSE 'x' END AS k FROM lineitem),
c AS (SELECT site, count(*) FILTER (k <> 'x') AS total, count(*) FILTER (k = 'm') AS methylated FROM x GROUP BY site) """


def _evidence(spark, d):
    watson = F.col("l_linestatus") == "O"
    allele = F.when(F.col("l_returnflag") == "A", F.when(watson, "C").otherwise("G")).when(F.col("l_returnflag") == "N", F.when(watson, "T").otherwise("A")).otherwise("X")
    return _table(spark, d, "lineitem").select(F.col("l_partkey").alias("site"), watson.alias("is_watson"), allele.alias("allele"))


@query(_METH + "SELECT * FROM c")
def methylation_counts(spark, d):
    return B.count_methylated(_evidence(spark, d))


@query(_METH + ", v AS (SELECT CAST(total AS DOUBLE) AS n, CAST(methylated AS DOUBLE) AS k FROM c WHERE total > 0), a AS (SELECT count(*) AS s, sum(n) AS n, sum(k) / sum(n) AS mu, avg(1 / n) AS inv FROM v), b AS (SELECT a.s * sum(v.n * (v.k / v.n - mu) * (v.k / v.n - mu)) / (a.s - 1) / a.n AS s2 FROM v, a GROUP BY a.s, a.n) SELECT s AS n_sites, round(mu, 6) AS mu, round((mu * (1 - mu) - s2) / (s2 - mu * (1 - mu) * inv), 4) AS m FROM a, b")
def beta_binomial_moments(spark, d):
    return B.beta_binomial_moments(B.count_methylated(_evidence(spark, d))).select("n_sites", _r("mu").alias("mu"), _r("m", 4).alias("m"))


@query("SELECT event_type AS ref FROM (SELECT DISTINCT event_type, user_id % 7 AS sample FROM events) GROUP BY event_type HAVING count(*) = 7")
def common_refs(spark, d):
    return B.common_refs(_table(spark, d, "events").select((F.col("user_id") % 7).alias("sample"), F.col("event_type").alias("ref")))


@query(f"WITH {P} SELECT row_number() OVER (ORDER BY value DESC, row_idx) - 1 AS rank, row_idx, value FROM p WHERE col = 3")
def arg_sort_desc(spark, d):
    got = order.arg_sort(matrix_p(spark, d).df.select("row_idx", F.get("v", F.lit(3)).alias("value")), "value", descending=True)
    return got.select("rank", "row_idx", "value")


@query(f"WITH {P}, x AS (SELECT row_idx, value FROM p WHERE col = 3) SELECT row_idx, CAST(rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS DOUBLE) AS rank FROM x")
def average_ranks(spark, d):
    got = order.average_rank(matrix_p(spark, d).df.select("row_idx", F.get("v", F.lit(3)).alias("value")), "value")
    return got.select("row_idx", F.col("rank").cast("double").alias("rank"))


@query(f"WITH {P}, r AS (SELECT row_idx, row_number() OVER (PARTITION BY col ORDER BY value DESC, row_idx) AS k, col FROM p WHERE col IN (1, 2)), m AS (SELECT greatest(a.k, b.k) AS w FROM r AS a JOIN r AS b USING (row_idx) WHERE a.col = 1 AND b.col = 2) SELECT size, round((SELECT count(*) FROM m WHERE w <= size) / size, 6) AS share FROM (SELECT unnest([50, 200, 500]) AS size)")
def concordance_at_top(spark, d):
    p = matrix_p(spark, d)
    a, b = (order.arg_sort(p.df.select("row_idx", F.get("v", F.lit(j)).alias("value")), "value", descending=True).select("row_idx", (F.col("rank") + 1).alias("rank")) for j in (1, 2))
    return order.concordance_at_top(a, b, [50, 200, 500]).select("size", _r("share").alias("share"))


@query("SELECT c_mktsegment AS key, list(c_custkey ORDER BY c_custkey)[1] AS first_row, count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment HAVING count(*) >= 3")
def associate_rows(spark, d):
    c = _table(spark, d, "customer").select(F.col("c_mktsegment").alias("key"), F.col("c_custkey").alias("row_idx"))
    return joins.associate(c.select("key"), c, "key", 3).groupBy("key").agg(F.min("row_idx").alias("first_row"), F.max("n").alias("n"))


@query("SELECT c_mktsegment AS key, c_custkey AS row_idx, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer WHERE c_mktsegment IS NOT NULL QUALIFY n >= 3")
def associated_pairs(spark, d):
    c = _table(spark, d, "customer").select(F.col("c_mktsegment").alias("key"), F.col("c_custkey").alias("row_idx"))
    return joins.associate(c.select("key"), c, "key", 3)


@query(f"WITH {G}, k AS (SELECT ref, s AS a, s + 1 + event_id % 100 AS z, event_id AS region FROM g) SELECT g.event_id, k.region FROM g JOIN k ON g.ref = k.ref AND g.s >= k.a AND g.s < k.z")
def regions_of_points(spark, d):
    """Every event's interval is a region."""
    g = points_g(spark, d)
    r = g.select("ref", F.col("start").alias("a"), F.col("end").alias("z"), F.col("event_id").alias("region"))
    return joins.in_ranges(g.select("ref", "start", "event_id"), r, "start", "a", "z", 256, on="ref").select("event_id", "region")


@query("SELECT p.p_partkey AS row_idx, CASE WHEN n.n_nationkey IS NULL THEN -1 ELSE n.n_nationkey END AS id FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'NONE' ELSE (SELECT min(n_name) FROM nation) END AS name FROM part) AS p LEFT JOIN nation AS n ON n.n_name = p.name")
def name_lookup(spark, d):
    nation = _table(spark, d, "nation")
    first = nation.agg(F.min("n_name")).first()[0]
    p = _table(spark, d, "part").select(F.col("p_partkey").alias("row_idx"), F.when(F.col("p_partkey") % 3 == 0, "NONE").otherwise(first).alias("name"))
    return joins.name_to_id(p, nation, "name", "n_name", "n_nationkey").select("row_idx", "id")


_STEP = """c AS (SELECT row_idx AS cl, col, value FROM {x} WHERE row_idx < 5),
dd AS (SELECT x.row_idx, c.cl, sum((x.value - c.value) * (x.value - c.value)) AS d2 FROM {x} AS x JOIN c USING (col) GROUP BY x.row_idx, c.cl),
a AS (SELECT row_idx, cl, d2 FROM (SELECT *, row_number() OVER (PARTITION BY row_idx ORDER BY d2, cl) AS k FROM dd) WHERE k = 1) """
_NEW = "SELECT CAST(cl AS INTEGER) AS cluster, CAST(col AS BIGINT) AS col, count(*) AS n, round(avg(value), 6) + 0.0 AS value FROM {x} JOIN a USING (row_idx) GROUP BY cl, col"


def _centroids(spark, new: np.ndarray, counts: np.ndarray) -> DataFrame:
    rows = [(c, j, int(counts[c]), float(v)) for c, centre in enumerate(new) for j, v in enumerate(centre)]
    return spark.createDataFrame(rows, "cluster int, col bigint, n bigint, value double").withColumn("value", _r("value"))


def _one_step(spark, m: BigMatrix) -> DataFrame:
    new, counts, _, _ = kmeans.step(m, kmeans.seeds_of_rows(m, range(5)))
    return _centroids(spark, new, counts)


@query(f"WITH {E}, " + _STEP.format(x="e") + _NEW.format(x="e"))
def kmeans_one_step(spark, d):
    return _one_step(spark, matrix_e(spark, d))


@query(
    f"WITH {E}, " + _STEP.format(x="e") + ", c2 AS (SELECT cl, col, avg(value) AS value FROM e JOIN a USING (row_idx) GROUP BY cl, col), "
    "d3 AS (SELECT e.row_idx, c2.cl, sum((e.value - c2.value) * (e.value - c2.value)) AS d2 FROM e JOIN c2 USING (col) GROUP BY e.row_idx, c2.cl), "
    "a3 AS (SELECT row_idx, cl FROM (SELECT *, row_number() OVER (PARTITION BY row_idx ORDER BY d2, cl) AS k FROM d3) WHERE k = 1) "
    + _NEW.format(x="e").replace("JOIN a USING", "JOIN a3 USING")
)
def kmeans_two_steps(spark, d):
    m = matrix_e(spark, d)
    first = kmeans.step(m, kmeans.seeds_of_rows(m, range(5)))[0]
    new, counts, _, _ = kmeans.step(m, first)
    return _centroids(spark, new, counts)


@query()
def kmeans_parallel_seeds(spark, d):
    m = matrix_e(spark, d)
    r = kmeans.kmeans(m, kmeans.KMeansConfig(20, seeding="parallel", max_iterations=5))
    return kmeans.centroid_table(spark, r)


_UNIT = "n AS (SELECT row_idx, col, c / sqrt(sum(c * c) OVER (PARTITION BY row_idx)) AS value FROM (SELECT row_idx, col, value - avg(value) OVER (PARTITION BY row_idx) AS c FROM e))"


@query(f"WITH {E}, {_UNIT}, " + _STEP.format(x="n") + _NEW.format(x="n"))
def kmeans_correlation_step(spark, d):
    return _one_step(spark, kmeans.prepared(matrix_e(spark, d), "correlation"))


@query(f"WITH {E}, " + _STEP.format(x="e") + "SELECT row_idx, round(d2, 6) + 0.0 AS d2 FROM a")
def kmeans_pp_distance(spark, d):
    m = matrix_e(spark, d)
    return kmeans.min_square_distances(m, kmeans.seeds_of_rows(m, range(5))).select("row_idx", _r("d2").alias("d2"))


@query()
def kmeans_fixed_iters(spark, d):
    m = matrix_e(spark, d)
    kept = m.with_df(materialize(m.df, "kmeans-input"))
    r = kmeans.kmeans(kept, kmeans.KMeansConfig(10, max_iterations=10))
    return kmeans.assign(kept, r.centroids)


@query()
def fk_statistic(spark, d):
    return kmeans.results_table(spark, kmeans.kmeans_batch(matrix_e(spark, d), [1, 2, 3, 4]), 64)


def _logged(spark, d) -> BigMatrix:
    return rowops.log_counts(rowops.common_library_size(matrix_u(spark, d), "median"))


#: Two leading eigenvectors of the control rows' Gram matrix by power iteration, the second with the first taken out.
_RUVG = f"""WITH RECURSIVE {U}, sz AS (SELECT col, sum(value) AS s FROM u GROUP BY col), md AS (SELECT median(s) AS m FROM sz),
lg AS (SELECT row_idx, col, ln(value * (m / s) + 1) AS value FROM u JOIN sz USING (col), md),
c AS (SELECT *, value - avg(value) OVER (PARTITION BY row_idx) AS y FROM lg),
k AS (SELECT c.* FROM c JOIN (SELECT row_idx FROM u GROUP BY row_idx HAVING max(value) BETWEEN 4 AND 30) USING (row_idx)),
gm AS (SELECT a.col AS i, b.col AS j, sum(a.y * b.y) AS g FROM k AS a JOIN k AS b USING (row_idx) GROUP BY ALL),
mt AS (SELECT list(r ORDER BY i) AS mx, list_transform(range(count(*)), lambda x: cos(1.7 * x + 0.3)) AS v0 FROM (SELECT i, list(g ORDER BY j) AS r FROM gm GROUP BY i)),
p AS (SELECT 0 AS t, v0 AS v FROM mt UNION ALL SELECT t + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) FROM (SELECT t, list_transform(mx, lambda r: list_dot_product(r, v)) AS w FROM p, mt WHERE t < 600)),
v1 AS (SELECT v AS a FROM p WHERE t = 600),
o AS (SELECT 0 AS t, v0 AS v FROM mt UNION ALL SELECT t + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) FROM (
  SELECT t, list_transform(list_zip(w0, a), lambda z: z[1] - list_dot_product(w0, a) * z[2]) AS w FROM (SELECT t, a, list_transform(mx, lambda r: list_dot_product(r, v)) AS w0 FROM o, mt, v1 WHERE t < 600))),
v2 AS (SELECT v AS b FROM o WHERE t = 600),
f AS (SELECT row_idx, sum(y * a[CAST(col + 1 AS INTEGER)]) AS fa, sum(y * b[CAST(col + 1 AS INTEGER)]) AS fb FROM c, v1, v2 GROUP BY row_idx) """


@query(_RUVG + "SELECT row_idx, CAST(col AS BIGINT) AS col, round(value - fa * a[CAST(col + 1 AS INTEGER)] - fb * b[CAST(col + 1 AS INTEGER)], 6) + 0.0 AS value FROM c JOIN f USING (row_idx), v1, v2")
def factor_ruvg_project(spark, d):
    m = _logged(spark, d)
    model = factor.fit_ruvg(m, factor.control_rows(matrix_u(spark, d), "weak-signal"))
    return _long(factor.component(m, model, "signal_random", 2))


#: Two leading eigenvectors of the replicate differences' Gram matrix by power iteration. All columns are
#: replicates and all rows controls, so W is the Gram matrix of the centred rows times each vector over its
#: eigenvalue, and a, estimated beside the group means, is the row times the vectors.
_RUVS = f"""WITH RECURSIVE {E}, y AS (SELECT row_idx, col, avg(value) OVER r AS m, value - avg(value) OVER r AS y, value - avg(value) OVER (PARTITION BY row_idx, col // 16) AS s FROM e WINDOW r AS (PARTITION BY row_idx)),
pr AS (SELECT a.col AS i, b.col AS j, sum(a.s * b.s) AS sa, sum(a.y * b.y) AS sg FROM y AS a JOIN y AS b USING (row_idx) GROUP BY ALL),
mt AS (SELECT list(ra ORDER BY i) AS mx, list(rg ORDER BY i) AS gx, list_transform(range(64), lambda x: cos(1.7 * x + 0.3)) AS v0 FROM (SELECT i, list(sa ORDER BY j) AS ra, list(sg ORDER BY j) AS rg FROM pr GROUP BY i)),
p AS (SELECT 0 AS t, v0 AS v FROM mt UNION ALL SELECT t + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) FROM (SELECT t, list_transform(mx, lambda r: list_dot_product(r, v)) AS w FROM p, mt WHERE t < 1500)),
v1 AS (SELECT v AS a FROM p WHERE t = 1500),
o AS (SELECT 0 AS t, v0 AS v FROM mt UNION ALL SELECT t + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) FROM (
  SELECT t, list_transform(list_zip(w0, a), lambda z: z[1] - list_dot_product(w0, a) * z[2]) AS w FROM (SELECT t, a, list_transform(mx, lambda r: list_dot_product(r, v)) AS w0 FROM o, mt, v1 WHERE t < 1500))),
v2 AS (SELECT v AS b FROM o WHERE t = 1500),
ws AS (SELECT a, b, list_transform(gx, lambda r: list_dot_product(r, a) / list_dot_product(a, list_transform(mx, lambda q: list_dot_product(q, a)))) AS wa,
  list_transform(gx, lambda r: list_dot_product(r, b) / list_dot_product(b, list_transform(mx, lambda q: list_dot_product(q, b)))) AS wb FROM mt, v1, v2),
f AS (SELECT row_idx, sum(y * a[CAST(col + 1 AS INTEGER)]) AS fa, sum(y * b[CAST(col + 1 AS INTEGER)]) AS fb FROM y, ws GROUP BY row_idx),
rest AS (SELECT row_idx, col, m, y - fa * wa[CAST(col + 1 AS INTEGER)] - fb * wb[CAST(col + 1 AS INTEGER)] AS r FROM y JOIN f USING (row_idx), ws) """


@query(_RUVS + "SELECT row_idx, CAST(col AS BIGINT) AS col, round(avg(r) OVER (PARTITION BY row_idx, col // 16) + m, 6) + 0.0 AS value FROM rest")
def factor_ruvs_project(spark, d):
    m = matrix_e(spark, d)
    return _long(factor.component(m, factor.fit_ruvs(m, GROUPS), "signal", 2, artifact="adjusted"))


@query()
def factor_components_by_config(spark, d):
    m = matrix_e(spark, d)
    got = factor.components_of_configs(m, factor.fit_ruvs(m, GROUPS), "artifact", [(0, 0), (1, 0), (3, 0)])
    return got.select("k", "n_known", "row_idx", F.posexplode("v").alias("col", "value")).withColumn("value", _r("value"))


@query(f"""WITH {E}, s AS (SELECT row_idx, col, value, avg(value) OVER (PARTITION BY row_idx, col // 16) AS b, avg(value) OVER (PARTITION BY row_idx) AS rm FROM e),
t AS (SELECT avg(value) AS g FROM s),
q AS (SELECT sum((value - g) * (value - g)) AS ss_t, sum((b - g) * (b - g)) AS ss_b, sum((value - b) * (value - b)) AS ss_r, sum((rm - g) * (rm - g)) AS b_ss_bl, sum((b - rm) * (b - rm)) AS b_ss_wl FROM s, t)
SELECT round(ss_t, 6) AS ss_t, round(ss_b, 6) AS ss_b, 0.0 AS ss_u, round(ss_r, 6) AS ss_r, round(b_ss_bl, 6) AS b_ss_bl, round(b_ss_wl, 6) AS b_ss_wl, round(ss_b / ss_t, 6) AS b, round(1 - ss_b / ss_t, 6) AS e FROM q""")
def variance_decomposition(spark, d):
    m = matrix_e(spark, d)
    model = factor.fit_ruvs(m, GROUPS)
    got = factor.decompose_variance(m, model, [(0, 0)])
    return got.select(*(_r(c).alias(c) for c in ("ss_t", "ss_b", "ss_u", "ss_r", "b_ss_bl", "b_ss_wl", "b", "e")))


#: A known factor that tells the first 32 columns from the others; centred it is 1/2 and -1/2, and its square 16.
HALVES = [[1.0] * 32 + [0.0] * 32]
_KNOWN = f"""WITH {E}, y AS (SELECT row_idx, col, value, avg(value) OVER r AS m, CASE WHEN col < 32 THEN 0.5 ELSE -0.5 END AS s FROM e WINDOW r AS (PARTITION BY row_idx)),
a AS (SELECT *, s * sum(s * (value - m)) OVER (PARTITION BY row_idx) / 16 AS art FROM y),
p AS (SELECT *, avg(value - m - art) OVER (PARTITION BY row_idx, col // 16) AS sg, value - art AS kept FROM a) """


def _three_components(m: BigMatrix, model, config: tuple[int, int]) -> DataFrame:
    parts = [_long(factor.component(m, model, which, *config)).withColumnRenamed("value", which) for which in ("artifact", "signal", "random")]
    return parts[0].join(parts[1], ["row_idx", "col"]).join(parts[2], ["row_idx", "col"])


def _known_model(m: BigMatrix):
    return factor.fit_ruvg(m, known=np.array(HALVES), groups=GROUPS)


@query(_KNOWN + "SELECT row_idx, CAST(col AS BIGINT) AS col, round(art, 6) + 0.0 AS artifact, round(sg + m, 6) + 0.0 AS signal, round(value - m - art - sg, 6) + 0.0 AS random FROM p")
def known_factor_components(spark, d):
    m = matrix_e(spark, d)
    return _three_components(m, _known_model(m), (0, 1))


#: What distances, F and variances are of the table p of (row_idx, col, value, m, art, sg, kept).
_DISTANCES = "SELECT CAST(x.a AS INTEGER) AS a, CAST(x.b AS INTEGER) AS b, value FROM (" + _PAIR.format("round(sqrt(sum((a.kept - b.kept) * (a.kept - b.kept))), 6) AS value", x="p") + ") AS x"
_F = """, gm AS (SELECT row_idx, col // 16 AS g, count(*) AS n, avg(kept) AS mg, var_pop(kept) * count(*) AS ss FROM p GROUP BY ALL),
t AS (SELECT row_idx, avg(kept) AS gmean FROM p GROUP BY row_idx)
SELECT row_idx, round((sum(n * (mg - gmean) * (mg - gmean)) / 3) / (sum(ss) / 60), 6) AS f FROM gm JOIN t USING (row_idx) GROUP BY row_idx"""
_SS = """, w AS (SELECT *, sg + m AS b, avg(sg + m) OVER (PARTITION BY row_idx) AS rb FROM p),
t AS (SELECT avg(value) AS gt, avg(b) AS gb, avg(art) AS gu, avg(b + art) AS gbu, avg(value - b - art) AS gr FROM w),
q AS (SELECT sum((value - gt) ** 2) AS ss_t, sum((b - gb) ** 2) AS ss_b, sum((art - gu) ** 2) AS ss_u, sum((b + art - gbu) ** 2) AS ss_bu, sum((value - b - art - gr) ** 2) AS ss_r, sum((rb - gb) ** 2) AS b_ss_bl, sum((b - rb) ** 2) AS b_ss_wl FROM w, t)
SELECT round(ss_t, 6) AS ss_t, round(ss_b, 6) AS ss_b, round(ss_u, 6) AS ss_u, round(ss_bu, 6) AS ss_bu, round(ss_r, 6) AS ss_r, round(b_ss_bl, 6) AS b_ss_bl, round(b_ss_wl, 6) AS b_ss_wl,
round(ss_b / ss_t, 6) AS b, round(ss_bu / ss_t - ss_b / ss_t, 6) + 0.0 AS u, round(1 - ss_bu / ss_t, 6) AS e FROM q"""


def _distances(spark: SparkSession, m: BigMatrix, model, config: tuple[int, int]) -> DataFrame:
    ((_, square),) = factor.per_config(m, model, [config], lambda c: pairwise.distance_matrix(c, "euclidean")).items()
    return _pairs(spark, square)


def _f(m: BigMatrix, model, config: tuple[int, int]) -> DataFrame:
    return factor.anova_by_config(m, model, [config], GROUPS).select("row_idx", _r("f").alias("f"))


def _ss(m: BigMatrix, model, config: tuple[int, int]) -> DataFrame:
    got = factor.decompose_variance(m, model, [config])
    return got.select(*(_r(c).alias(c) for c in ("ss_t", "ss_b", "ss_u", "ss_bu", "ss_r", "b_ss_bl", "b_ss_wl", "b", "u", "e")))


@query(_KNOWN + _DISTANCES)
def distance_known_factor(spark, d):
    m = matrix_e(spark, d)
    return _distances(spark, m, _known_model(m), (0, 1))


@query(_KNOWN + _F)
def anova_known_factor(spark, d):
    m = matrix_e(spark, d)
    return _f(m, _known_model(m), (0, 1))


@query(_KNOWN + _SS)
def variance_known_factor(spark, d):
    m = matrix_e(spark, d)
    return _ss(m, _known_model(m), (0, 1))


#: The first factor that is learned from replicates, and a from the row alone: what lies along W.
_LEARNED = _RUVS[: _RUVS.index("o AS (SELECT 0 AS t")] + """ws AS (SELECT list_transform(gx, lambda r: list_dot_product(r, a)) AS wa FROM mt, v1),
ar AS (SELECT row_idx, col, m, y + m AS value, wa[CAST(col + 1 AS INTEGER)] * sum(y * wa[CAST(col + 1 AS INTEGER)]) OVER (PARTITION BY row_idx) / list_dot_product(wa, wa) AS art FROM y, ws),
"""
_LEARNED = _LEARNED.replace("p AS (SELECT 0 AS t", "pw AS (SELECT 0 AS t").replace("FROM p, mt", "FROM pw, mt").replace("FROM p WHERE t", "FROM pw WHERE t") + "p AS (SELECT *, avg(value - m - art) OVER (PARTITION BY row_idx, col // 16) AS sg, value - art AS kept FROM ar) "


@query(_LEARNED + "SELECT row_idx, CAST(col AS BIGINT) AS col, round(art, 6) + 0.0 AS artifact, round(sg + m, 6) + 0.0 AS signal, round(value - m - art - sg, 6) + 0.0 AS random FROM p")
def learned_factor_components(spark, d):
    m = matrix_e(spark, d)
    return _three_components(m, factor.fit_ruvs(m, GROUPS), (1, 0))


@query(_LEARNED + _DISTANCES)
def distance_learned_factor(spark, d):
    m = matrix_e(spark, d)
    return _distances(spark, m, factor.fit_ruvs(m, GROUPS), (1, 0))


@query(_LEARNED + _F)
def anova_learned_factor(spark, d):
    m = matrix_e(spark, d)
    return _f(m, factor.fit_ruvs(m, GROUPS), (1, 0))


@query(_LEARNED + _SS)
def variance_learned_factor(spark, d):
    m = matrix_e(spark, d)
    return _ss(m, factor.fit_ruvs(m, GROUPS), (1, 0))


@query(_KNOWN + "SELECT CAST(n AS INTEGER) AS n_known, row_idx, CAST(col AS BIGINT) AS col, round(CASE WHEN n = 0 THEN 0 ELSE art END, 6) + 0.0 AS value FROM p, (SELECT unnest([0, 1]) AS n)")
def exported_configs(spark, d):
    """Components of several configurations written as one matrix each, and read back from their folders."""
    m, path = matrix_e(spark, d), scratch_path(spark, "configs")
    store.export_configs(m, _known_model(m), "artifact", [(0, 0), (0, 1)], path)
    back = spark.read.parquet(path)
    return back.select(F.col("n_known").cast("int").alias("n_known"), "row_idx", F.posexplode("v").alias("col", "value")).select("n_known", "row_idx", F.col("col").cast("bigint").alias("col"), _r("value").alias("value"))


# --- sources and sinks: tables written in a format and read back ---------------------------------

_RANKED = f"WITH {P}, k AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part) "
_RANKED_ROWS = "SELECT k.pos AS row_idx, CAST(col AS BIGINT) AS col, round(value, 6) + 0.0 AS value FROM p JOIN k ON k.p_partkey = p.row_idx"


def _numbered(spark: SparkSession, d: str) -> tuple[BigMatrix, int]:
    """matrix_p with rows numbered from 0 in their order, as files without row ids have them."""
    m = matrix_p(spark, d)
    ranked = order.with_rank(m.df, F.col("row_idx")).select(F.col("rank").alias("row_idx"), "v")
    return m.with_df(ranked), ranked.count()


@query(_RANKED + _RANKED_ROWS.replace("round(value, 6)", "round(value + 1, 6)"))
def text_round_trip(spark, d):
    """A text matrix with a heading and a first column of names, 1 added to each cell when it is read."""
    (m, n), path = _numbered(spark, d), scratch_path(spark, "text")
    lines = m.df.select("row_idx", F.concat_ws("\t", F.concat(F.lit("part"), F.col("row_idx").cast("string")), F.array_join(F.col("v").cast("array<string>"), "\t")).alias("value"))
    heading = spark.createDataFrame([(-1, "\t".join(["name", *(name for _, name in m.cols)]))], lines.schema)
    lines.unionByName(heading).repartitionByRange(4, "row_idx").sortWithinPartitions("row_idx").select("value").write.text(path)
    return _long(files.text_matrix(spark, path, n, m.n_cols, sep="\t", skip_cols=1, skip_rows=1, col_names=True, add=1.0))


@query(_RANKED + _RANKED_ROWS)
def binary_round_trip(spark, d):
    (m, n), prefix = _numbered(spark, d), scratch_path(spark, "binary") + "/m"
    _folder(spark, prefix)
    files.write_binary(m, prefix, n)
    return _long(files.load(spark, f"binary-mat@{prefix}", n_rows=n, n_cols=m.n_cols))


@query(_RANKED + _RANKED_ROWS)
def binary_batches_round_trip(spark, d):
    """Numbered files of at most 40 rows, read in ranges of some rows."""
    (m, n), prefix = _numbered(spark, d), scratch_path(spark, "batches") + "/m"
    _folder(spark, prefix)
    limit = 40 * m.n_cols * 8
    files.write_binary(m, prefix, n, limit=limit)
    return _long(files.binary_matrix(spark, prefix, n, m.n_cols, limit=limit, chunk_bytes=1000))


def _folder(spark: SparkSession, prefix: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(prefix).getParent()
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row_idx, CAST(p_size AS BIGINT) AS value FROM part")
def integer_vector_round_trip(spark, d):
    sizes = _table(spark, d, "part").select(F.col("p_partkey").alias("row_idx"), F.array(F.col("p_size").cast("double")).alias("v"))
    ranked = order.with_rank(sizes, F.col("row_idx")).select(F.col("rank").alias("row_idx"), "v")
    prefix, n = scratch_path(spark, "vector") + "/v", ranked.count()
    _folder(spark, prefix)
    files.write_binary(BigMatrix.of(ranked, 1), prefix, n, "<i4")
    return files.binary_vector(spark, prefix, n)


@query(f"WITH {P} SELECT row_idx, CAST(col AS BIGINT) AS col, round(value, 6) + 0.0 AS value FROM p WHERE row_idx >= 20 AND row_idx < 120 AND col IN (2, 5)")
def store_round_trip(spark, d):
    """A matrix stored in two parts, of which a range of rows and two columns are read back."""
    m, path = matrix_p(spark, d), scratch_path(spark, "store")
    store.save_matrix(m.rows(0, 50), path, "parts")
    store.append_rows(m.with_df(m.df.where("row_idx >= 50")), path)
    back = files.load(spark, f"matrix@{path}")
    return _long(back.rows(20, 120).columns([3, 6])).withColumn("col", F.when(F.col("col") == 0, 2).otherwise(5).cast("bigint"))


@query(f"WITH {P} SELECT 'parts' AS name, 7 AS n_cols, count(*) // 7 AS n_rows, min(row_idx) AS first_row, max(row_idx) AS last_row FROM p")
def store_manifest(spark, d):
    m, path = matrix_p(spark, d), scratch_path(spark, "manifest")
    store.save_matrix(m, path, "parts")
    got = store.read_manifest(spark, path)
    return spark.createDataFrame([(got["name"], len(got["cols"]), got["n_rows"], got["first_row"], got["last_row"])], "name string, n_cols int, n_rows bigint, first_row bigint, last_row bigint")


@query(f"WITH {E}, ids AS (SELECT unnest(range({len(IDS)})) AS pos, unnest({IDS}) AS row_idx) SELECT pos AS row_idx, CAST(col AS BIGINT) AS col, round(value, 6) + 0.0 AS value FROM ids JOIN e USING (row_idx)")
def exported_ids_round_trip(spark, d):
    m, path = matrix_e(spark, d), scratch_path(spark, "ids")
    store.export_taken(select.take_rows(m, IDS), m, path)
    return _long(store.load_output(spark, path))


@query(f"WITH {U} " + _rows("CASE WHEN value < 10 THEN 0 ELSE value END", "u"))
def exported_zero_background(spark, d):
    path = scratch_path(spark, "background")
    store.export_zero_background(matrix_u(spark, d), path, 10.0)
    return _long(store.load_output(spark, path))


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos, c_custkey - 1 AS row_idx FROM customer")
def row_id_list_round_trip(spark, d):
    path = scratch_path(spark, "rowids")
    ids = _table(spark, d, "customer").select("c_custkey")
    ids.repartitionByRange(3, "c_custkey").sortWithinPartitions("c_custkey").select(F.col("c_custkey").cast("string")).write.text(path)
    return files.load(spark, f"text-rowids@{path}", base=1)


@query("""WITH x AS (SELECT DISTINCT l_partkey AS site, l_orderkey AS o, l_linenumber AS l, l_linestatus AS w, l_returnflag AS k, CAST(l_quantity AS INTEGER) AS q, l_suppkey % 30 AS c FROM lineitem WHERE CAST(l_quantity AS INTEGER) >= 20 AND l_suppkey % 30 < 10)
SELECT site - CASE WHEN w = 'O' THEN 0 ELSE 1 END AS site, count(*) FILTER (k <> 'R') AS total, count(*) FILTER (k = 'A') AS methylated FROM x GROUP BY ALL""")
def evidence_round_trip(spark, d):
    """Evidence written as a table of tabs, read with a least quality and some cycles, strands put together."""
    path, x = scratch_path(spark, "evidence"), _table(spark, d, "lineitem")
    watson, flag, number = F.col("l_linestatus") == "O", F.col("l_returnflag"), lambda c: c.cast("int")
    allele = F.when(flag == "A", F.when(watson, "C").otherwise("G")).when(flag == "N", F.when(watson, "T").otherwise("A")).otherwise("X")
    zero = [F.lit(0).alias(c) for c in ("IsForward", "SamFlag", "Qual1", "Qual2")]
    rows = x.select(F.lit("chr1").alias("RefName"), F.col("l_partkey").alias("RefOffset"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("ReadID"), allele.alias("Allele"), number(watson).alias("IsWaston"), *zero, number(F.col("l_suppkey") % 30).alias("SeqCycle"), F.lit(50).alias("AlLen"), F.lit(0).alias("AlScore"), number(F.col("l_quantity")).alias("MAPQ"), F.lit("m").alias("MateID"))
    rows.write.option("sep", "\t").option("header", "true").csv(path)
    read = files.merge_strands(files.read_evidence(spark, path, 20, cycles=range(10)))
    return B.count_methylated(read.select(F.col("RefOffset").alias("site"), (F.col("IsWaston") == 1).alias("is_watson"), F.col("Allele").alias("allele")))


@query()
def variance_by_config(spark, d):
    m = matrix_e(spark, d)
    return factor.decompose_variance(m, factor.fit_ruvs(m, GROUPS), [(0, 0), (1, 0), (2, 0), (5, 0)], rows=(0, 1 << 40))


@query(_ANOVA + "SELECT CAST(0 AS INTEGER) AS k, row_idx, round(f, 6) AS f FROM f")
def anova_without_factors(spark, d):
    m = matrix_e(spark, d)
    got = factor.anova_by_config(m, factor.fit_ruvs(m, GROUPS), [(0, 0)], GROUPS)
    return got.select("k", "row_idx", _r("f").alias("f"))


@query()
def anova_by_config(spark, d):
    m = matrix_e(spark, d)
    return factor.anova_by_config(m, factor.fit_ruvs(m, GROUPS), [(1, 0), (3, 0)], GROUPS)


@query()
def distance_by_config(spark, d):
    m = matrix_e(spark, d)
    found = factor.per_config(m, factor.fit_ruvs(m, GROUPS), [(0, 0), (2, 0)], lambda c: pairwise.distance_matrix(c, "euclidean"))
    rows = [(k, n, int(a), int(b), float(x[a, b])) for (k, n), x in found.items() for a, b in zip(*np.triu_indices(64, 1))]
    return spark.createDataFrame(rows, "k int, n_known int, a int, b int, distance double")


@query()
def eigen_permutation_null(spark, d):
    from .functions.curves import explained_fractions

    model = factor.fit_ruvg(_logged(spark, d), permutations=3)
    share, null = explained_fractions(model.eigenvalues, model.permuted)
    return spark.createDataFrame([(i, float(v), float(s), [float(x) for x in n]) for i, (v, s, n) in enumerate(zip(model.eigenvalues, share, null))], "i int, eigenvalue double, share double, null_shares array<double>")


@query()
def column_clusters(spark, d):
    from .functions.curves import complete_linkage, cut_tree, dissimilarity

    merges = complete_linkage(dissimilarity(pairwise.pearson(matrix_e(spark, d))))
    return spark.createDataFrame(list(enumerate(cut_tree(merges, 64, 4))), "col int, cluster int")


@query()
def beta_binomial_mle(spark, d):
    counts = B.count_methylated(_evidence(spark, d)).withColumn("key", F.col("site") % 8)
    return B.beta_binomial_mle(counts, "key").select("key", _r("mu").alias("mu"), _r("m", 3).alias("m"))


@query(f"""WITH {E}, j AS (SELECT a.row_idx, a.col, a.value AS y, b.value AS x FROM e AS a JOIN e AS b ON b.row_idx = a.row_idx + 1 AND b.col = a.col),
m AS (SELECT row_idx, avg(y) AS my, avg(x) AS mx FROM j WHERE col < 32 GROUP BY row_idx),
k AS (SELECT row_idx, my, mx, sum((x - mx) * (y - my)) / (sum((x - mx) * (x - mx)) + 1e-6) AS beta FROM j JOIN m USING (row_idx) WHERE col < 32 GROUP BY ALL)
SELECT row_idx, round(avg((y - my - beta * (x - mx)) ** 2), 9) AS error, round(avg((y - my - beta * (x - mx)) ** 2) / avg((y - my) ** 2), 9) AS relative FROM j JOIN k USING (row_idx) WHERE col >= 32 GROUP BY row_idx""")
def predicted_rows(spark, d):
    """The second half of each row's cells from those of the next row, by a ridge regression on the first half."""
    e = matrix_e(spark, d).df
    xs = e.select((F.col("row_idx") - 1).alias("row_idx"), F.array("v").alias("xs"))
    found = factor.predict_rows(e.withColumnRenamed("v", "y").join(xs, "row_idx"), range(32), range(32, 64))
    return found.select("row_idx", _r("error", 9).alias("error"), _r("relative", 9).alias("relative"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Counts to shares, logs, unit rows, then correlations of the columns."""
    m = rowops.log_counts(rowops.divide_by_column_sum(matrix_u(spark, d)))
    return _pairs(spark, pairwise.pearson(rowops.adjust_rows(m, "zero_mean_unit_length")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, (fn, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
