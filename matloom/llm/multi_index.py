"""Embedding near-duplicates by an inverted multi-index.

Two codebooks, one for each half of the vectors, span a product grid of cells (Babenko and
Lempitsky 2012). Every distinct vector lies in the list of its nearest cell and visits the cells
nearest to it by multi-sequence traversal. The distance to a cell is a lower bound: how far a vector
must move at least, in each half, to cross the bisector between its own word and the cell's. So a
traversal to the greatest distance of a link misses none, and one to less than that is calibrated
for the target recall on the links that a sample of vectors has with all of them.
What it meets there is verified by cosine in double precision. Equal vectors are one class with a
count. Long lists are cut into blocks and searched block by block, and a block returns counts and
the star of each connected part, so that dense groups make no pairs outside a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, materialize, release
from .simhash import NO_ID, unite


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = (x.shape[1] + 1) // 2
    return x[:, :cut], x[:, cut:]


def _square_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None], 0)


def _codebook(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    for _ in range(rounds):
        own = _square_distances(x, centres).argmin(1)
        order = np.argsort(own, kind="stable")
        words, starts, n = np.unique(own[order], return_index=True, return_counts=True)
        centres[words] = np.add.reduceat(x[order], starts) / n[:, None]
    return centres


def _crossings(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Squares of the least moves that bring x into the cell of each word: to the bisector with the nearest word."""
    d = _square_distances(x, words)
    home = d.argmin(1)
    gap = 2 * np.sqrt(_square_distances(words, words))[home]
    ahead = np.maximum(d - d[np.arange(len(d)), home][:, None], 0)
    return np.divide(ahead, gap, out=np.zeros_like(d), where=gap > 1e-6) ** 2


@dataclass
class MultiIndex:
    """Codebooks of unit vectors' halves, and how far from its own cell a vector looks."""

    first: np.ndarray
    second: np.ndarray
    margin: float

    def costs(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Square distances of both halves to all words."""
        a, b = _halves(unit)
        return _square_distances(a, self.first), _square_distances(b, self.second)

    def crossings(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two parts of the lower bound of the square distance to any vector of a cell."""
        a, b = _halves(unit)
        return _crossings(a, self.first), _crossings(b, self.second)

    def homes(self, unit: np.ndarray) -> np.ndarray:
        p, q = self.costs(unit)
        return (p.argmin(1) * len(self.second) + q.argmin(1)).astype(np.int32)

    def traverse(self, near: np.ndarray, far: np.ndarray) -> list[int]:
        """Cells of one vector in order of cost, to the margin beyond the least."""
        return next(self.traversals(near[None], far[None]))[1].tolist()

    def traversals(self, near: np.ndarray, far: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(visits per vector, their cells) for consecutive vectors: multi-sequence traversal of two cost tables.

        Both sequences of a vector are sorted, and of the second one the prefix that still lies
        within the margin is taken for each entry of the first: the same cells that a queue would
        give out, in the same order, for many vectors at once. No piece has over ``limit`` visits
        but where one vector has.
        """
        r, c = np.argsort(near, axis=1, kind="stable"), np.argsort(far, axis=1, kind="stable")
        x, y = np.take_along_axis(near, r, 1), np.take_along_axis(far, c, 1)
        n, k = y.shape
        stop = x[:, 0] + y[:, 0] + self.margin
        # row by row in one search: rows are set apart by more than any cost; the slack goes again below
        apart = (np.arange(n) * (float(y.max(initial=0)) + 1))[:, None]
        room = np.clip(stop[:, None] - x, -0.5, y.max(initial=0)) + 1e-9 * (1 + n)
        prefix = np.searchsorted((y + apart).ravel(), (room + apart).ravel(), "right").reshape(x.shape) - np.arange(n)[:, None] * k
        prefix = np.clip(prefix, 0, k)
        total = np.cumsum(prefix.sum(1))
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + limit, "right")))
            many = prefix[a:b].ravel()
            at = np.repeat(np.arange(len(many)), many)
            j = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            row, i = at // x.shape[1] + a, at % x.shape[1]
            cost = x[row, i] + y[row, j]
            kept = cost <= stop[row]
            row, i, j, cost = row[kept], i[kept], j[kept], cost[kept]
            order = np.lexsort((cost, row))
            row, i, j = row[order], i[order], j[order]
            yield np.bincount(row - a, minlength=b - a), (r[row, i] * k + c[row, j]).astype(np.int32)
            a = b


def fit_index(sample: np.ndarray, n: int, threshold: float, list_size: int = 256, most: int = 2048, seed: int = 3) -> MultiIndex:
    """Codebooks of about sqrt(n / list_size) words; the margin loses no link: that of the greatest distance of one."""
    k = max(1, min(most, round((n / list_size) ** 0.5), max(1, len(sample) // 4)))
    a, b = _halves(sample)
    return MultiIndex(_codebook(a, k, seed), _codebook(b, k, seed + 1), 2 * (1 - threshold) + 1e-9)


def _clean(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """vec: the components as little-endian numbers of their own kind; null if there is no usable vector."""
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            out = []
            for v in vectors:
                x = None if not v.is_valid else v.values.to_numpy(zero_copy_only=False).astype(kind, copy=False)
                usable = x is not None and len(x) and not v.values.null_count and np.isfinite(x).all() and 0 < float((y := x.astype(float)) @ y) < np.inf
                out.append((x + x.dtype.type(0)).tobytes() if usable else None)  # -0 becomes 0: equal vectors have equal bytes
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.binary())], ["vec_id", "vec"])

    return run


def _unit(column: pa.Array, dims: int) -> np.ndarray:
    """Unit vectors in double precision; four or eight bytes a component."""
    data = b"".join(column.to_pylist())
    x = np.frombuffer(data, "<f8" if len(data) == 8 * dims * len(column) else "<f4").astype(float).reshape(-1, dims)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _locate(index: MultiIndex, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                unit = _unit(part.column(2), dims)
                home, at = index.homes(unit), 0
                for visits, cells in index.traversals(*index.crossings(unit)):
                    some = part.slice(at, len(visits))
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(visits)]), pa.int32()), pa.array(cells, pa.int32()))
                    yield pa.RecordBatch.from_arrays([*(some.column(c) for c in range(3)), pa.array(home[at : at + len(visits)]), lists], ["h", "n", "vec", "home", "visits"])
                    at += len(visits)

    return run


#: Needed margins are counted in so many steps of the greatest one.
_STEPS = 4096


def _needs(index: MultiIndex, dims: int, hashes: np.ndarray, copies: np.ndarray, queries: np.ndarray, threshold: float, block: int = 1024):
    """What margins the links of queries with rows need: (kind, step, n), by number, by copies, and of those just above the threshold."""
    p, q = index.crossings(queries)
    most = 2 * (1 - threshold)
    brink = threshold + (1 - threshold) / 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, _STEPS + 1))
        for batch in batches:
            h, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a in range(0, batch.num_rows, block):
                x = _unit(batch.column(2).slice(a, block), dims)
                cosine = x @ queries.T
                i, j = np.nonzero(cosine >= threshold)
                other = h[a + i] != hashes[j]
                i, j = i[other], j[other]
                if not len(i):
                    continue
                some, at = np.unique(i, return_inverse=True)
                home = index.homes(x[some])[at]
                need = p[j, home // len(index.second)] + q[j, home % len(index.second)]
                step = np.clip(np.ceil(need / most * _STEPS), 0, _STEPS).astype(np.int64)
                near = cosine[i, j] < brink
                np.add.at(total[0], step, 1)
                np.add.at(total[1], step, n[a + i].astype(float) * copies[j])
                np.add.at(total[2], step[near], 1)
        kind, step = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(step.astype(np.int32)), pa.array(total[kind, step])], ["kind", "step", "n"])

    return run


def true_margin(index: MultiIndex, classes: DataFrame, dims: int, hashes: np.ndarray, copies: np.ndarray, queries: np.ndarray, threshold: float, target_recall: float) -> tuple[float, int]:
    """(margin, links): the margin by which queries meet the target share of their links among classes(h, n, vec).

    In one direction of the search, though a link that either end finds counts. It is the largest of
    what is needed for the share of all links, of links weighted by copies, and of those just above
    the threshold; 0 if there are none.
    """
    needs = classes.select("h", "n", "vec").mapInArrow(_needs(index, dims, hashes, copies, queries, threshold), "kind int, step int, n double")
    rows = needs.groupBy("kind", "step").agg(F.sum("n").alias("n")).collect()  # at most the steps, thrice
    total = np.zeros((3, _STEPS + 1))
    for r in rows:
        total[r["kind"], r["step"]] = r["n"]
    steps = [int(np.searchsorted(np.cumsum(t), target_recall * t.sum() * (1 - 1e-12))) for t in total if t.any()]
    return (max(steps) / _STEPS * 2 * (1 - threshold) + 1e-9 if steps else 0.0), int(total[0].sum())


def _verify(dims: int, grid: int, threshold: float, block: int = 1024):
    """Links between the list block and the visitors' block of each (cell, i, j)."""

    def links(cell: int, rows: pa.RecordBatch) -> pa.RecordBatch | None:
        visitor = rows.column("visitor").to_numpy(zero_copy_only=False).astype(bool)
        own, come = np.flatnonzero(~visitor), np.flatnonzero(visitor)
        if not len(own) or not len(come):
            return None
        h, n, home = (rows.column(c).to_numpy() for c in ("h", "n", "home"))
        x = _unit(rows.column("vec"), dims)
        # where each listed vector itself goes: a pair that both ends find counts in one place only
        lists = rows.column("visits").take(pa.array(own))
        goes = np.sort(np.repeat(np.arange(len(own)), [len(v) for v in lists.to_pylist()]).astype(np.int64) * grid + lists.flatten().to_numpy())
        codes, at = np.unique(h, return_inverse=True)
        parent, total = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        for a in range(0, len(come), block):
            v = come[a : a + block]
            i, j = np.nonzero(x[v] @ x[own].T >= threshold)
            v, u = v[i], own[j]
            found = goes[np.minimum(np.searchsorted(goes, j * grid + home[v]), len(goes) - 1)] == j * grid + home[v]
            here = ~found | (cell > home[v]) | ((cell == home[v]) & (h[v] < h[u]))
            here &= h[v] != h[u]
            v, u = v[here], u[here]
            np.add.at(total, at[v], n[u])
            np.add.at(total, at[u], n[v])
            unite(parent, at[v], at[u])
        met = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(codes[met]), pa.array(total[met]), pa.array(codes[parent[met]])], ["h", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("cell", "i", "j")])
            starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(starts[:-1], starts[1:]):
                k = tuple(keys[:, a].tolist())
                if k != key and held:
                    if (out := links(key[0], pa.concat_batches(held))) is not None:
                        yield out
                    held = []
                key = k
                held.append(batch.slice(a, b - a))
        if held and (out := links(key[0], pa.concat_batches(held))) is not None:
            yield out

    return run


def embedding_links(
    vectors: DataFrame, threshold: float = 0.9, target_recall: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = 20_000, block_rows: int = 2048, query_rows: int = 1024, least_links: int = 500
) -> DataFrame:
    """One row per input row: (vec_id, n_links, component_id, kept).

    n_links counts the other rows whose cosine with this one is found to be at least ``threshold``
    (all those of equal vectors, and none below it); component_id is the smallest id that links
    reach. Vectors that are null, empty, zero, hold null or non-finite components, or have another
    length than most of the sample link with nothing. A component of null ids only has a null
    component_id; such rows are not kept. Repeated rows are rows like others, linked as equal
    vectors; an empty table gives no rows; other columns, whatever their names, are not read.

    The codebooks are fitted on at most ``sample_rows`` distinct vectors, those of least hash; every
    row is indexed and searched. The margin of the search is that by which the first ``query_rows``
    vectors of the sample meet ``target_recall`` of their links among all rows. If they have fewer
    than ``least_links``, all of the sample are asked; if those have fewer too and are not all
    vectors, the margin is the one that loses no link, whatever it costs.
    """
    read = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("embedding"))
    kind = "<f4" if isinstance(read.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"
    if kind == "<f8":
        read = read.withColumn("embedding", F.col("embedding").cast("array<double>"))
    rows = read.mapInArrow(_clean(kind), "vec_id bigint, vec binary")
    rows = materialize(rows.withColumn("h", F.when(F.col("vec").isNotNull(), F.xxhash64("vec"))), "vectors")
    classes = rows.where("h is not null").groupBy("h").agg(F.first("vec").alias("vec"), F.count("*").alias("n"), F.min("vec_id").alias("rep"))
    classes = materialize(classes.select("h", "vec", "n", F.coalesce("rep", F.lit(NO_ID) + F.expr("shiftrightunsigned(h, 2)")).alias("rep")), "vector-classes")
    drawn = classes.orderBy("h").limit(sample_rows).select("h", "n", "vec").collect()
    alone = rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    if not drawn:
        return alone
    lengths = [len(r["vec"]) for r in drawn]
    width = max(set(lengths), key=lambda x: (lengths.count(x), x))
    dims = width // np.dtype(kind).itemsize
    usable = classes.where(F.octet_length("vec") == width)
    drawn = [r for r in drawn if len(r["vec"]) == width]
    fitted = _unit(pa.array([bytes(r["vec"]) for r in drawn], pa.binary()), dims)
    n = usable.count()
    index = fit_index(fitted, n, threshold)
    grid = len(index.first) * len(index.second)
    if grid > 1:
        hashes, copies = np.array([r["h"] for r in drawn], np.int64), np.array([r["n"] for r in drawn], float)
        asked, links = 0, 0
        while links < least_links and asked < len(drawn):
            asked = min(query_rows, len(drawn)) if not asked else len(drawn)
            margin, links = true_margin(index, usable, dims, hashes[:asked], copies[:asked], fitted[:asked], threshold, target_recall)
        if links >= least_links or asked == n:
            index.margin = margin
    located = materialize(usable.select("h", "n", "vec").mapInArrow(_locate(index, dims), "h bigint, n bigint, vec binary, home int, visits array<int>"), "vector-cells")
    blocks = lambda c: F.ceil(F.col(c) / block_rows).cast("int")
    cells = (  # at most as many rows as the grid has cells
        located.groupBy(F.col("home").alias("cell")).agg(F.count("*").alias("a"))
        .join(located.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.count("*").alias("b")), "cell")
        .select("cell", blocks("a").alias("own"), blocks("b").alias("come"))
    )
    cells = materialize(cells, "vector-lists")  # Spark sends it out if it is small, by its size on disk
    listed = located.withColumn("cell", F.col("home")).join(cells, "cell").withColumn("i", F.expr("cast(pmod(xxhash64(h, 1), own) as int)"))
    listed = listed.select("cell", "i", F.explode(F.sequence(F.lit(0), F.col("come") - 1)).alias("j"), F.lit(False).alias("visitor"), "h", "n", "home", "vec", "visits")
    guests = located.withColumn("cell", F.explode("visits")).join(cells, "cell").withColumn("j", F.expr("cast(pmod(xxhash64(h, 2), come) as int)"))
    guests = guests.select("cell", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("i"), "j", F.lit(True).alias("visitor"), "h", "n", "home", "vec", F.expr("cast(array() as array<int>)").alias("visits"))
    met = listed.unionByName(guests).repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "visitor", "h")
    found = materialize(met.mapInArrow(_verify(dims, grid, threshold), "h bigint, links bigint, root bigint"), "vector-links")
    roots = materialize(connected_components(found.select(F.col("h").alias("a"), F.col("root").alias("b"))), "vector-roots")
    links = materialize(found.groupBy("h").agg(F.sum("links").alias("links")), "vector-counts")
    of = classes.join(roots.withColumnRenamed("node", "h"), "h", "left").join(links, "h", "left")
    of = materialize(of.select("h", F.coalesce("root", "h").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "rep", (F.octet_length("vec") == width).alias("ok")), "vector-of")
    least = materialize(of.groupBy("root").agg(F.min("rep").alias("component_id")), "vector-least")
    full = materialize(of.join(least, "root").select(F.col("h"), "n_links", "component_id", "ok"), "vector-full")
    release(classes, cells, located, found, roots, links, of, least)
    out = rows.select("vec_id", "h").join(full, "h", "left")
    linked = F.coalesce("ok", F.lit(False))
    component = F.when(linked, F.when(F.col("component_id") < NO_ID, F.col("component_id"))).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(linked, F.col("n_links")).otherwise(F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )
