"""Fixed-width bins over named references: maps, counts, coverage and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BIN_MAP = "ref string, len bigint, start_bin bigint, end_bin bigint"


def natural_key(name: str) -> tuple[str, int, str]:
    """Sorts chr2 before chr10: letters, then the number, then the rest."""
    head = name.rstrip("0123456789")
    tail = name[len(head) :]
    return (head, int(tail) if tail else -1, tail)


def bin_map(spark: SparkSession, refs: Sequence[tuple[str, int]], width: int) -> DataFrame:
    """(ref, len, start_bin, end_bin): references in the order given, each with a last bin for its rest."""
    rows, at = [], 0
    for name, length in refs:
        n = -(-length // width)
        rows.append((name, length, at, at + n))
        at += n
    return spark.createDataFrame(rows, BIN_MAP)


def total_bins(bins: DataFrame) -> int:
    return bins.agg(F.max("end_bin")).first()[0] or 0


def natural_order(ref: Column) -> list[Column]:
    """natural_key as columns to sort by."""
    tail = F.regexp_extract(ref, "[0-9]+$", 0)
    return [F.regexp_replace(ref, "[0-9]+$", ""), F.when(tail == "", F.lit(-1)).otherwise(tail.try_cast("decimal(38,0)")), tail]


def common_refs(samples: DataFrame) -> DataFrame:
    """(ref) in natural order: names that every sample of (sample, ref) has."""
    n = samples.select("sample").distinct().count()
    found = samples.groupBy("ref").agg(F.countDistinct("sample").alias("n")).where(F.col("n") == n).select("ref")
    return found.orderBy(*natural_order(F.col("ref")))


def located(points: DataFrame, bins: DataFrame, width: int, pos: Column) -> DataFrame:
    """points (with ref) and their bin and offset; -1 for both where ref is unknown or pos is outside."""
    b = bins.select(F.col("ref").alias("_ref"), F.col("len").alias("_len"), F.col("start_bin").alias("_start"))
    met = points.withColumn("_pos", pos).join(b, F.col("ref") == F.col("_ref"), "left")
    ok = F.coalesce((F.col("_pos") >= 0) & (F.col("_pos") < F.col("_len")), F.lit(False))
    bin_ = F.when(ok, F.expr(f"_start + _pos div {width}")).otherwise(F.lit(-1))
    return met.withColumns({"bin": bin_.cast("bigint"), "offset": F.when(ok, F.expr(f"_pos % {width}")).otherwise(F.lit(-1)).cast("bigint")}).drop("_pos", "_ref", "_len", "_start")


def bin_ranges(bins: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(bin, ref, from, to) of bin ids; ids outside all references drop out.

    References are cut into cells of 2**20 bins, so that ids meet them by an equi-join.
    """
    from .joins import in_ranges

    met = in_ranges(ids, bins, "bin", "start_bin", "end_bin", 1 << 20)
    begin = (F.col("bin") - F.col("start_bin")) * width
    return met.select("bin", "ref", begin.alias("from"), F.least(begin + width, F.col("len")).alias("to"))


def count_midpoints(alignments: DataFrame, bins: DataFrame, width: int) -> DataFrame:
    """(bin, count) for every bin, 0 where none: mapped (ref, start, end, is_mapped) by their midpoint."""
    met = located(alignments.where("is_mapped"), bins, width, F.expr("(start + end) div 2")).where("bin >= 0")
    counts = met.groupBy("bin").agg(F.count("*").alias("count"))
    every = alignments.sparkSession.range(total_bins(bins)).withColumnRenamed("id", "bin")
    return every.join(counts, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("count"))


def coverage(reads: DataFrame, bins: DataFrame, width: int, wanted: DataFrame) -> DataFrame:
    """(bin, offset, count) for every unit of the wanted bins: how many reads [start, end) cover it.

    Reads give two events per bin that they touch, not one row per unit; a running sum within a
    bin, at most ``width`` rows, makes the counts.
    """
    b = bins.select(F.col("ref").alias("_ref"), F.col("len").alias("_len"), "start_bin")
    cut = reads.join(b, F.col("ref") == F.col("_ref")).withColumns({"s": F.greatest("start", F.lit(0)), "e": F.least("end", "_len")}).where("s < e")
    each = cut.select("s", "e", "start_bin", F.explode(F.expr(f"sequence(s div {width}, (e - 1) div {width})")).alias("k"))
    each = each.select((F.col("start_bin") + F.col("k")).alias("bin"), (F.greatest("s", F.col("k") * width) - F.col("k") * width).alias("a"), (F.least("e", (F.col("k") + 1) * width) - F.col("k") * width).alias("z"))
    kept = each.join(wanted.select("bin").distinct(), "bin", "left_semi")
    events = kept.select("bin", F.explode(F.array(F.struct(F.col("a").alias("offset"), F.lit(1).alias("d")), F.struct(F.col("z").alias("offset"), F.lit(-1).alias("d")))).alias("x")).select("bin", "x.*")
    steps = events.groupBy("bin", "offset").agg(F.sum("d").alias("d"))
    # of each bin one row that holds its steps in order, then the units: no row waits for a sort of all units
    packed = wanted.select("bin").distinct().join(steps.groupBy("bin").agg(F.map_from_entries(F.collect_list(F.struct("offset", "d"))).alias("m")), "bin", "left")
    units = packed.select("bin", "m", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("offset"))
    running = Window.partitionBy("bin").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    step = F.coalesce(F.try_element_at("m", F.col("offset").cast("bigint")), F.lit(0))
    limit = bin_ranges(bins, wanted.select("bin").distinct(), width).select(F.col("bin").alias("_bin"), (F.col("to") - F.col("from")).alias("_size"))
    out = units.select("bin", F.col("offset").cast("bigint").alias("offset"), F.sum(step).over(running).alias("count"))
    return out.join(limit, F.col("bin") == F.col("_bin")).where("offset < _size").select("bin", "offset", "count")


def flagged_units(flags: DataFrame, ref: str, start: int, stop: int) -> DataFrame:
    """(n): units of [start, stop) of ref that lie in any interval (ref, start, end) of flags.

    Intervals may overlap: each counts from the greatest end before it.
    """
    cut = flags.where(F.col("ref") == ref).select(F.greatest("start", F.lit(start)).alias("s"), F.least("end", F.lit(stop)).alias("e")).where("s < e")
    distinct = cut.groupBy("s").agg(F.max("e").alias("e"))
    # the running maximum stays within cells, into which intervals are cut
    parts = distinct.select(F.explode(F.expr("sequence(s div 1048576, (e - 1) div 1048576)")).alias("c"), "s", "e").select("c", F.greatest("s", F.col("c") * 1048576).alias("s"), F.least("e", (F.col("c") + 1) * 1048576).alias("e"))
    before = Window.partitionBy("c").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("e") - F.greatest("s", F.coalesce(F.max("e").over(before), F.lit(start))))
    return parts.select(new.alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"))


def window_descriptors(sites: DataFrame, step: int, width: int) -> DataFrame:
    """(ref, window, n_sites, n_reads, span) of overlapping windows [window * step, window * step + width).

    sites: (ref, pos, read). Windows without sites have no row.
    """
    first = F.greatest(F.floor((F.col("pos") - width) / step) + 1, F.lit(0))
    each = sites.select("ref", "pos", "read", F.explode(F.sequence(first, F.floor(F.col("pos") / step))).alias("window"))
    return each.groupBy("ref", "window").agg(F.countDistinct("pos").alias("n_sites"), F.countDistinct("read").alias("n_reads"), (F.max("pos") - F.min("pos") + 1).alias("span"))


def centred_windows(sites: DataFrame, width: int, by: str = "bp") -> DataFrame:
    """(ref, pos, n): sites in the window round each site, by distance ("bp") or by number of sites.

    A reference is cut into cells of many widths, and sites near a border stand in both cells, so
    that a reference with most of the sites is no single task.
    """
    from .order import with_rank

    half, rest, cell = width // 2, width - width // 2 - 1, max(width, 1) * 64
    if by == "bp":  # sites of one position have one window: a hot position is one row of it
        placed = sites.groupBy("ref", "pos").agg(F.count("*").alias("c")).withColumn("at", F.col("pos"))
    else:
        placed = with_rank(sites.select("ref", "pos"), F.col("ref"), F.col("pos")).select("ref", "pos", F.lit(1).cast("bigint").alias("c"), F.col("rank").alias("at"))
    near = F.sequence(F.floor((F.col("at") - rest) / cell), F.floor((F.col("at") + half) / cell))
    each = placed.select("*", F.explode(near).alias("cell"))
    w = Window.partitionBy("ref", "cell").orderBy("at").rangeBetween(-half, rest)
    found = each.select("ref", "pos", "c", "at", "cell", F.sum("c").over(w).alias("n")).where(F.col("cell") == F.floor(F.col("at") / cell))
    return found.select("ref", "pos", "n", F.explode(F.sequence(F.lit(1), F.col("c")))).select("ref", "pos", "n")


def count_methylated(evidence: DataFrame) -> DataFrame:
    """(site, total, methylated) of reads (site, is_watson, allele).

    Watson: C methylated, T not. Crick: G methylated, A not. Any other allele is a mismatch, which
    makes the site valid and counts nowhere.
    """
    meth = (F.col("is_watson") & (F.col("allele") == "C")) | (~F.col("is_watson") & (F.col("allele") == "G"))
    not_ = (F.col("is_watson") & (F.col("allele") == "T")) | (~F.col("is_watson") & (F.col("allele") == "A"))
    return evidence.groupBy("site").agg(F.count_if(meth | not_).alias("total"), F.count_if(meth).alias("methylated"))


def beta_binomial_moments(counts: DataFrame) -> DataFrame:
    """(n_sites, mu, m): moment estimates over sites with reads (total > 0).

    mu is the pooled share k / n, s2 the weighted variance of the sites' shares, and
    m = (mu (1 - mu) - s2) / (s2 - mu (1 - mu) mean(1 / n)).
    """
    c = counts.where("total > 0").select(F.col("total").cast("double").alias("n"), F.col("methylated").cast("double").alias("k"))
    # sum of n (k/n - mu)^2 = sum k^2/n - mu^2 sum n, since mu is sum k / sum n
    got = c.agg(F.count("*").alias("sites"), F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("q"), F.avg(1 / F.col("n")).alias("inv"))
    got = got.withColumn("mu", F.col("k") / F.col("n"))
    s2 = F.col("sites") * (F.col("q") - F.col("mu") * F.col("mu") * F.col("n")) / F.nullif(F.col("sites") - 1, F.lit(0)) / F.col("n")
    got = got.withColumn("s2", s2).withColumn("v", F.col("mu") * (1 - F.col("mu")))
    return got.select(F.col("sites").alias("n_sites"), "mu", F.try_divide(F.col("v") - F.col("s2"), F.col("s2") - F.col("v") * F.col("inv")).alias("m"))


def beta_binomial_mle(counts: DataFrame, key: str, steps: int = 400) -> DataFrame:
    """(key, mu, m): maximum likelihood per group of sites, NaN where it cannot be found.

    Sites are first counted by (total, methylated), so that a task holds the different pairs of a
    group and not its sites.
    """
    import math

    import numpy as np
    import pandas as pd

    def lgamma_at(base: np.ndarray, extra: float) -> np.ndarray:
        """lgamma(base + extra), worked out once for each different base."""
        some, at = np.unique(base, return_inverse=True)
        return np.array([math.lgamma(x + extra) for x in some.tolist()])[at]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        n, k, w = (pdf[c].to_numpy(float) for c in ("total", "methylated", "_w"))
        best = (np.nan, np.nan)
        if len(n) and 0 < (k * w).sum() < (n * w).sum():

            def loss(p):
                mu, m = 1 / (1 + np.exp(-p[0])), float(np.exp(np.clip(p[1], -20, 20)))
                a, b = float(mu * m), float((1 - mu) * m)
                return -(w * (lgamma_at(k, a) - math.lgamma(a) + lgamma_at(n - k, b) - math.lgamma(b) - lgamma_at(n, m) + math.lgamma(m))).sum()

            mu0 = (k * w).sum() / (n * w).sum()
            p, size = np.array([np.log(mu0 / (1 - mu0)), 1.0]), np.array([0.5, 1.0])
            at = loss(p)
            for _ in range(steps):  # coordinate search with shrinking steps
                moved = False
                for i in (0, 1):
                    for sign in (1, -1):
                        q = p.copy()
                        q[i] += sign * size[i]
                        got = loss(q)
                        if got < at - 1e-12:
                            p, at, moved = q, got, True
                if not moved:
                    size /= 2
                    if size.max() < 1e-9:
                        break
            best = (1 / (1 + np.exp(-p[0])), float(np.exp(p[1])))
        return pd.DataFrame({key: [pdf[key].iloc[0]], "mu": [best[0]], "m": [best[1]]})

    kind = counts.schema[key].dataType.simpleString()
    pairs = counts.withColumn("_ok", F.col("total") > 0).groupBy(key, F.when(F.col("_ok"), F.col("total")).alias("total"), F.when(F.col("_ok"), F.col("methylated")).alias("methylated")).agg(F.count("*").alias("_w"))
    kept = pairs.select(key, F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("methylated", F.lit(0)).alias("methylated"), "_w")
    return kept.groupBy(key).applyInPandas(fit, f"`{key}` {kind}, mu double, m double")
