"""K-means over the rows of a matrix: k-means++ seeds, Lloyd iterations, several K over one input.

A pass sends K sums per task, added up in layers; only centroids and counts reach the driver.
Correlation distance is Euclidean distance of rows of mean 0 and length 1 (half of it, squared,
is 1 - r).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.curves import f_of_k
from ..matrix import BigMatrix, block
from ..scratch import materialize, release
from .rowops import unit_length_or_zero
from .stats import tree_sum


@dataclass(frozen=True)
class KMeansConfig:
    k: int
    distance: str = "euclidean"
    seeding: str = "kmeans++"  # or "uniform", "parallel" (few scans for large K), or "given" with seeds
    max_iterations: int = 100
    min_changed: int = 0
    min_explained_change: float = 1e-4
    seed: int = 1


@dataclass
class KMeansResult:
    k: int
    centroids: np.ndarray
    counts: np.ndarray
    seed_rows: list[int]
    distortion: float
    explained: float
    iterations: int
    history: list[float] = field(default_factory=list)


def square_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)[None], 0)


def prepared(m: BigMatrix, distance: str) -> BigMatrix:
    if not m.n_cols:
        raise ValueError("no columns")
    if distance == "correlation":
        return m.map(unit_length_or_zero)
    if distance != "euclidean":
        raise ValueError(f"unknown distance {distance}")
    return m


def assign(m: BigMatrix, centroids: np.ndarray) -> DataFrame:
    """(row_idx, cluster, d2): the nearest centroid, the first of equals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = square_distances(block(b.column(1)), centroids)
                own = d.argmin(1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(d)), own])], ["row_idx", "cluster", "d2"])

    return m.df.select("row_idx", "v").mapInArrow(run, "row_idx bigint, cluster int, d2 double")


def step(m: BigMatrix, centroids: np.ndarray, previous: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float, int]:
    """New centroids, counts, distortion against ``centroids``, and rows whose cluster changed from ``previous``.

    A cluster without rows keeps its centroid.
    """
    k, n = centroids.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = np.zeros((k, n + 3))
        for b in batches:
            if not b.num_rows:
                continue
            x = block(b.column(0))
            d = square_distances(x, centroids)
            own = d.argmin(1)
            mark = np.zeros((len(x), k))
            mark[np.arange(len(x)), own] = 1
            total[:, :n] += mark.T @ x
            total[:, n] += mark.sum(0)
            total[0, n + 1] += d[np.arange(len(x)), own].sum()
            if previous is not None:
                total[0, n + 2] += (square_distances(x, previous).argmin(1) != own).sum()
        return total

    got = tree_sum(m.df.select("v"), partial)
    if got is None:
        return centroids, np.zeros(k, np.int64), 0.0, 0
    counts = got[:, n]
    new = np.where(counts[:, None] > 0, got[:, :n] / np.maximum(counts, 1)[:, None], centroids)
    return new, counts.astype(np.int64), float(got[0, n + 1]), int(got[0, n + 2])


def _uniform(rows: np.ndarray, seed: int, round_: int) -> np.ndarray:
    """A number in (0, 1) for each row id, the same however the rows are split (splitmix64)."""
    with np.errstate(over="ignore"):
        z = rows.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + round_ * 0xD1B54A32D192ED03 + 1) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(float) / 2**53 + 2**-54


def pick_row(m: BigMatrix, centroids: np.ndarray | None, seed: int, round_: int) -> tuple[int, np.ndarray]:
    """A row drawn with probability in proportion to its square distance from the centroids.

    An exponential race: the row of least -log(u) / weight wins, which needs one pass, one row per
    task and no running sums. Without centroids all rows weigh the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: tuple[float, int, list[float]] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            x, rows = block(b.column(1)), b.column(0).to_numpy()
            w = np.ones(len(x)) if centroids is None else square_distances(x, centroids).min(1)
            w = np.where(w <= 1e-12 * np.maximum((x * x).sum(1), 1e-300), 0, w)
            with np.errstate(divide="ignore"):
                time = np.where(w > 0, -np.log(_uniform(rows, seed, round_)) / np.where(w > 0, w, 1), np.inf)
            i = int(np.lexsort((rows, time))[0])
            if best is None or (time[i], rows[i]) < best[:2]:
                best = (float(time[i]), int(rows[i]), x[i].tolist())
        if best is not None:
            yield pa.RecordBatch.from_pylist([{"time": best[0], "row_idx": best[1], "v": best[2]}], pa.schema([("time", pa.float64()), ("row_idx", pa.int64()), ("v", pa.list_(pa.float64()))]))

    got = m.df.select("row_idx", "v").mapInArrow(run, "time double, row_idx bigint, v array<double>").orderBy("time", "row_idx").first()
    if got is None:
        raise ValueError("no rows")
    return got["row_idx"], np.array(got["v"])


def parallel_seeds(m: BigMatrix, k: int, seed: int = 1, rounds: int = 5, oversampling: float = 2.0) -> tuple[np.ndarray, list[int]]:
    """k-means|| (Bahmani et al. 2012): each of a few scans draws about oversampling * k rows at once.

    A row is drawn where its hash falls below its share of the distortion; the candidates, some
    2 * rounds * k rows, are weighted by the rows nearest to them and thinned to k by k-means++ on the
    driver. Twice as many scans as rounds, whatever k is.
    """
    row, v = pick_row(m, None, seed, 0)
    candidates, rows = [v], [row]
    for r in range(1, rounds + 1):
        centres = np.array(candidates)
        total = step(m, centres)[2]
        if total <= 0:
            break

        def draw(batches: Iterator[pa.RecordBatch], centres=centres, total=total, r=r) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x, ids = block(b.column(1)), b.column(0).to_numpy()
                share = oversampling * k * square_distances(x, centres).min(1) / total
                yield b.filter(pa.array(_uniform(ids, seed, r) < share))

        for got in m.df.select("row_idx", "v").mapInArrow(draw, "row_idx bigint, v array<double>").orderBy("row_idx").collect():
            candidates.append(np.array(got["v"]))
            rows.append(got["row_idx"])
    x = np.array(candidates)
    weight = step(m, x)[1].astype(float)
    weight[weight == 0] = 1e-9
    chosen: list[int] = []
    for r in range(min(k, len(x))):
        w = weight if not chosen else weight * square_distances(x, x[chosen]).min(1)
        w[chosen] = 0
        with np.errstate(divide="ignore"):
            chosen.append(int(np.argmin(np.where(w > 0, -np.log(_uniform(np.arange(len(x)), seed + 1, r)) / np.where(w > 0, w, 1), np.inf))))
    while len(chosen) < k:  # fewer different rows than seeds wanted
        chosen.append(chosen[0])
    return x[chosen], [rows[c] for c in chosen]


def seeds(m: BigMatrix, k: int, seeding: str = "kmeans++", seed: int = 1) -> tuple[np.ndarray, list[int]]:
    if seeding == "parallel":
        return parallel_seeds(m, k, seed)
    rows: list[int] = []
    centres: list[np.ndarray] = []
    for r in range(k):
        row, v = pick_row(m, np.array(centres) if centres and seeding == "kmeans++" else None, seed, r)
        rows.append(row)
        centres.append(v)
    return np.array(centres), rows


def seeds_of_rows(m: BigMatrix, row_ids: Sequence[int]) -> np.ndarray:
    found = {r["row_idx"]: r["v"] for r in m.df.where(m.df.row_idx.isin(list(row_ids))).collect()}  # K rows
    return np.array([found[i] for i in row_ids])


def min_square_distances(m: BigMatrix, centroids: np.ndarray) -> DataFrame:
    """(row_idx, d2) to the nearest centroid: the weights of the next seed."""
    return assign(m, centroids).select("row_idx", "d2")


def kmeans(m: BigMatrix, config: KMeansConfig, given: np.ndarray | None = None, base_distortion: float | None = None) -> KMeansResult:
    """Stops at max_iterations, when few rows change, or when the explained share moves little three times running.

    For correlation distance the adjusted rows are written once, and not made again in every pass.
    """
    data = prepared(m, config.distance)
    if data is not m:
        written = materialize(data.df, "kmeans-rows")
        try:
            return _iterated(data.with_df(written), config, given, base_distortion)
        finally:
            release(written)
    return _iterated(data, config, given, base_distortion)


def _iterated(data: BigMatrix, config: KMeansConfig, given: np.ndarray | None, base_distortion: float | None) -> KMeansResult:
    m = data
    if given is not None:
        centroids, rows = np.asarray(given, float), []
    else:
        centroids, rows = seeds(data, config.k, config.seeding, config.seed)
    if base_distortion is None:
        mean = step(data, np.zeros((1, m.n_cols)))[0]
        base_distortion = step(data, mean)[2]
    history: list[float] = []
    previous, calm, last = None, 0, None
    done = 0
    counts = np.zeros(config.k, np.int64)
    for done in range(1, config.max_iterations + 1):
        new, counts, distortion, changed = step(data, centroids, previous)
        history.append(distortion)
        explained = 1 - distortion / base_distortion if base_distortion else 1.0
        calm = calm + 1 if last is not None and abs(explained - last) < config.min_explained_change else 0
        if calm >= 3 or (previous is not None and changed <= config.min_changed):
            break
        previous, centroids, last = centroids, new, explained
    _, counts, distortion, _ = step(data, centroids)
    return KMeansResult(config.k, centroids, counts, rows, distortion, 1 - distortion / base_distortion if base_distortion else 1.0, done, history)


def kmeans_batch(m: BigMatrix, ks: Sequence[int], **options) -> list[KMeansResult]:
    """A result per K over one input, which is prepared and written once."""
    written = materialize(prepared(m, options.get("distance", "euclidean")).df, "kmeans-rows")
    try:
        data = m.with_df(written)
        base = step(data, step(data, np.zeros((1, m.n_cols)))[0])[2]
        return [_iterated(data, KMeansConfig(k, **options), None, base) for k in ks]
    finally:
        release(written)


def results_table(spark: SparkSession, results: Sequence[KMeansResult], n_cols: int) -> DataFrame:
    """(k, distortion, col_count, explained, fk); fk is NaN unless the Ks are 1, 2, 3, ..."""
    ks = [r.k for r in results]
    fk = f_of_k([r.distortion for r in results], n_cols) if ks == list(range(1, len(ks) + 1)) else [float("nan")] * len(ks)
    return spark.createDataFrame([(r.k, r.distortion, n_cols, r.explained, float(f)) for r, f in zip(results, fk)], "k int, distortion double, col_count int, explained double, fk double")


def centroid_table(spark: SparkSession, result: KMeansResult) -> DataFrame:
    """(cluster, n, v)."""
    return spark.createDataFrame([(i, int(n), c.tolist()) for i, (n, c) in enumerate(zip(result.counts, result.centroids))], "cluster int, n bigint, v array<double>")
