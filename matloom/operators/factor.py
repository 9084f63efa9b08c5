"""Removal of unwanted variation: Y = Xb + Wa + e, with W learned from control rows or replicates.

The maths is that of RUVg and RUVs (Risso et al. 2014; Gagnon-Bartlett and Speed 2012). Rows are
centred; whatever is summed over rows is n x n and added up in layers; whatever is applied to rows
is a product with a small matrix in Arrow batches. Names of components and of the two ways to
estimate a are this package's own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import BigMatrix, block, map_scalars
from .stats import tree_sum

RANK_TOLERANCE = 1e-7
COMPONENTS = ("signal_random", "artifact", "signal", "random", "all")
#: How a component's values are given back: as they were fitted, or with a logarithm undone.
SCALES = {"log": lambda y, add: y, "raw": lambda y, add: np.exp(y) - add, "raw2": lambda y, add: np.exp2(y) - add}


# --- control rows -----------------------------------------------------------------------------


def control_rows(m: BigMatrix, method: str = "all", low: float = 4.0, high: float | None = 30.0, rows: DataFrame | None = None, quantiles: Sequence[float] | None = None, fraction: float = 1.0) -> DataFrame:
    """(row_idx, is_control).

    all: every row. weak-signal: the row's maximum lies in [low, high]. specified-rows: row_idx is
    in ``rows``. quantile: at least ``fraction`` of a row's cells are below their column's threshold
    in ``quantiles``. Comparisons with NaN fail.
    """
    ids = m.df.select("row_idx", "v")
    if method == "all":
        return ids.select("row_idx", F.lit(True).alias("is_control"))
    if method == "weak-signal":
        top = float("inf") if high is None else high
        return map_scalars(m.df, lambda x: {"is_control": (x.max(1) >= low) & (x.max(1) <= top)}, "is_control boolean")
    if method == "specified-rows":
        wanted = rows.select("row_idx").distinct().withColumn("is_control", F.lit(True))
        return ids.select("row_idx").join(wanted, "row_idx", "left").select("row_idx", F.coalesce("is_control", F.lit(False)).alias("is_control"))
    if method == "quantile":
        cut = np.asarray(quantiles, float)
        return map_scalars(m.df, lambda x: {"is_control": (x < cut).mean(1) >= fraction}, "is_control boolean")
    raise ValueError(f"unknown method {method}")


# --- fit --------------------------------------------------------------------------------------


@dataclass
class FactorModel:
    """What is learned: eigenvalues, the factors of every rank, and the settings."""

    kind: str
    groups: list[list[int]]
    eigenvalues: np.ndarray
    w: np.ndarray  # (column, factor), all factors above the rank tolerance
    known: np.ndarray  # (column, known factor)
    permuted: np.ndarray | None = None  # (eigenvalue, round)
    replicates: list[int] = field(default_factory=list)
    vectors: np.ndarray | None = None  # ruvs: eigenvectors over the replicate columns
    b: np.ndarray | None = None
    c: np.ndarray | None = None

    def factors(self, k: int, n_known: int | None = None, chosen: Sequence[int] | None = None) -> np.ndarray:
        """W of the first k learned factors, or of the chosen ones, beside the first n_known known factors."""
        picks = list(range(k)) if chosen is None else list(chosen)
        if any(not 0 <= p < self.w.shape[1] for p in picks):
            raise ValueError(f"the model has {self.w.shape[1]} factors")
        if self.kind == "ruvs" and self.vectors is not None:
            u = self.vectors[:, picks]
            learned = self.c @ u @ np.linalg.pinv(u.T @ self.b @ u) if picks else np.zeros((len(self.c), 0))
        else:
            learned = self.w[:, picks]
        n = self.known.shape[1] if n_known is None else n_known
        return np.hstack([learned, self.known[:, :n]])

    def design(self) -> np.ndarray:
        """0/1 matrix of columns and groups; ungrouped columns are groups of one."""
        n = len(self.w)
        grouped = {j for g in self.groups for j in g}
        every = self.groups + [[j] for j in range(n) if j not in grouped]
        x = np.zeros((n, len(every)))
        for i, g in enumerate(every):
            x[g, i] = 1
        return x

    def conditions(self, names: Sequence[str] = ()) -> list[dict]:
        """Each group, and each column of no group, with its columns and their names: the columns of design()."""
        return [{"condition": i, "columns": [int(j) for j in np.flatnonzero(x)], "samples": [names[j] for j in np.flatnonzero(x)] if names else []} for i, x in enumerate(self.design().T)]

    def wt(self, k: int, n_known: int | None = None) -> np.ndarray:
        """The factors as rows."""
        return self.factors(k, n_known).T

    def projector(self, k: int, n_known: int | None = None, artifact: str = "naive", chosen: Sequence[int] | None = None) -> np.ndarray:
        """Z with Z y the artifact of a centred row y.

        naive: a is estimated from y alone. adjusted: jointly with the group means, so that what
        groups explain is not taken for artifact.
        """
        w = self.factors(k, n_known, chosen)
        if not w.shape[1]:
            return np.zeros((len(w), len(w)))
        if artifact == "naive":
            return w @ np.linalg.pinv(w)
        if artifact != "adjusted":
            raise ValueError(f"unknown artifact estimate {artifact}")
        x = self.design()
        r = np.eye(len(w)) - x @ np.linalg.pinv(x)
        return w @ np.linalg.pinv(w.T @ r @ w) @ w.T @ r

    def choose_k(self, least_fraction: float) -> tuple[int, np.ndarray]:
        """How many eigenvalues have at least this share of their sum, and all shares."""
        total = self.eigenvalues.sum()
        share = self.eigenvalues / total if total else self.eigenvalues
        return int((share >= least_fraction).sum()), share

    def to_json(self) -> str:
        return json.dumps({k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in asdict(self).items()})

    def check(self, m: BigMatrix | None = None) -> FactorModel:
        """The model itself, or an error that names what does not fit together, or does not fit the matrix."""
        n = len(self.w)
        grouped = [j for g in self.groups for j in g]
        faults = [
            (self.kind not in ("ruvg", "ruvs"), f"unknown kind {self.kind}"),
            (m is not None and m.n_cols != n, f"the model has {n} columns, the matrix {m.n_cols if m is not None else 0}"),
            (any(not 0 <= j < n for j in grouped), "a group names a column that is not there"),
            (len(set(grouped)) < len(grouped), "a column is in two groups"),
            (self.known.shape[0] != n, "known factors have another length than the columns"),
            (self.permuted is not None and len(self.permuted) != len(self.eigenvalues), "permuted eigenvalues do not match the eigenvalues"),
            (not np.isfinite(self.w).all() or not np.isfinite(self.eigenvalues).all(), "factors or eigenvalues are not finite"),
            (bool((np.diff(self.eigenvalues) > 1e-9 * max(1.0, float(np.abs(self.eigenvalues).max(initial=0)))).any()), "eigenvalues are not in order"),
            (self.kind == "ruvs" and (self.b is None or self.c is None or self.vectors is None), "a ruvs model lacks its sums"),
            (self.kind == "ruvs" and self.c is not None and self.c.shape != (n, len(self.replicates)), "the sums do not match the replicate columns"),
        ]
        if said := [text for bad, text in faults if bad]:
            raise ValueError("; ".join(said))
        return self

    @classmethod
    def from_json(cls, text: str) -> FactorModel:
        """A model as it was written, checked."""
        arrays = ("eigenvalues", "w", "known", "permuted", "vectors", "b", "c")
        found = {k: np.array(v, float) if k in arrays and v is not None else v for k, v in json.loads(text).items()}
        for name in ("w", "known"):
            found[name] = found[name].reshape(len(found[name]), -1)
        return cls(**found).check()


def _eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from the greatest, above the tolerance, and vectors whose largest entry is positive."""
    values, vectors = np.linalg.eigh((a + a.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    live = values > RANK_TOLERANCE
    vectors = vectors[:, live]
    lead = np.abs(vectors).argmax(0)
    return np.maximum(values, 0), vectors * np.sign(vectors[lead, np.arange(vectors.shape[1])])


def shuffled(x: np.ndarray, rows: np.ndarray, seed: int, round_: int, groups: Sequence[Sequence[int]] | None = None) -> np.ndarray:
    """Cells of each row permuted, within groups if given; keyed by row id, so the split does not matter."""
    from .kmeans import _uniform

    out = x.copy()
    for g in groups or [range(x.shape[1])]:
        g = np.asarray(list(g))
        keys = np.stack([_uniform(rows, seed + 7919 * (int(j) + 1), round_) for j in g], 1)
        out[:, g] = np.take_along_axis(x[:, g], np.argsort(keys, axis=1), 1)
    return out


def _flagged(m: BigMatrix, controls: DataFrame | None) -> DataFrame:
    if controls is None:
        return m.df.select("row_idx", "v", F.lit(True).alias("is_control"))
    return m.df.join(controls.select("row_idx", "is_control"), "row_idx", "left").select("row_idx", "v", F.coalesce("is_control", F.lit(False)).alias("is_control"))


def _centred(x: np.ndarray) -> np.ndarray:
    return x - x.mean(1, keepdims=True)


def fit_ruvg(m: BigMatrix, controls: DataFrame | None = None, known: np.ndarray | None = None, permutations: int = 0, seed: int = 1, groups: Sequence[Sequence[int]] = (), adjust: str | None = None) -> FactorModel:
    """W from the Gram matrix of centred control rows; with a permutation null of its eigenvalues.

    adjust: a row adjustment (rowops.ADJUSTMENTS) that rows go through before they are fitted on.
    """
    m = _adjusted(m, adjust)
    n, rounds = m.n_cols, permutations

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = np.zeros((1 + rounds, n, n))
        for b in batches:
            if not b.num_rows:
                continue
            keep = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            x, rows = _centred(block(b.column(1)))[keep], b.column(0).to_numpy()[keep]
            total[0] += x.T @ x
            for r in range(rounds):
                y = shuffled(x, rows, seed, r)
                total[1 + r] += y.T @ y
        return total

    got = tree_sum(_flagged(m, controls), partial)
    if got is None:
        got = np.zeros((1 + rounds, n, n))
    values, vectors = _eigen(got[0])
    null = np.stack([_eigen(a)[0] for a in got[1:]], 1) if rounds else None
    return FactorModel("ruvg", [list(g) for g in groups], values, vectors, _known(known, n), null)


def _adjusted(m: BigMatrix, adjust: str | None) -> BigMatrix:
    from .rowops import adjust_rows

    return adjust_rows(m, adjust) if adjust else m


def _known(known: np.ndarray | None, n: int) -> np.ndarray:
    if known is None:
        return np.zeros((n, 0))
    k = np.asarray(known, float).reshape(-1, n).T
    return k - k.mean(0)


def fit_ruvs(m: BigMatrix, groups: Sequence[Sequence[int]], controls: DataFrame | None = None, known: np.ndarray | None = None, permutations: int = 0, seed: int = 1, adjust: str | None = None) -> FactorModel:
    """W from replicate columns less their group mean, regressed on the control rows; adjust as in fit_ruvg.

    One pass sums A = S S' over all rows, B = S S' and C = Y S' over control rows, S being the
    replicate differences; B is A when all rows are controls and is not summed then.
    """
    m = _adjusted(m, adjust)
    n, rounds = m.n_cols, permutations
    sets = [list(g) for g in groups if len(g) > 1]
    cols = [j for g in sets for j in g]
    if not cols:
        raise ValueError("no group has two columns")
    r = len(cols)
    everything = controls is None

    def differences(x: np.ndarray) -> np.ndarray:
        return np.hstack([x[:, g] - x[:, g].mean(1, keepdims=True) for g in sets])

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = np.zeros((2 + rounds, r, r))
        cross = np.zeros((n, r))
        for b in batches:
            if not b.num_rows:
                continue
            x, rows = _centred(block(b.column(1))), b.column(0).to_numpy()
            keep = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            s = differences(x)
            total[0] += s.T @ s
            if not everything:
                total[1] += s[keep].T @ s[keep]
            cross += x[keep].T @ s[keep]
            for k in range(rounds):
                p = differences(shuffled(x, rows, seed, k))
                total[2 + k] += p.T @ p
        return np.concatenate([total.ravel(), cross.ravel()])

    got = tree_sum(_flagged(m, controls), partial)
    if got is None:
        got = np.zeros((2 + rounds) * r * r + n * r)
    squares, c = got[: (2 + rounds) * r * r].reshape(-1, r, r), got[(2 + rounds) * r * r :].reshape(n, r)
    values, vectors = _eigen(squares[0])
    b = squares[0] if everything else squares[1]
    w = c @ vectors @ np.linalg.pinv(vectors.T @ b @ vectors)
    null = np.stack([_eigen(a)[0] for a in squares[2:]], 1) if rounds else None
    return FactorModel("ruvs", [list(g) for g in groups], values, w, _known(known, n), null, cols, vectors, b, c)


# --- components -------------------------------------------------------------------------------


def split_rows(x: np.ndarray, z: np.ndarray, groups: Sequence[Sequence[int]], skip: Sequence[int] = ()) -> dict[str, np.ndarray]:
    """artifact, signal, random and mean of rows: they add up to the rows.

    signal is the mean over each group's columns, without the skipped ones, of the row less its
    mean and artifact, plus the row's mean; a column of no group is a group of its own.
    """
    mean = x.mean(1, keepdims=True)
    artifact = (x - mean) @ z.T
    rest = x - mean - artifact
    signal = rest.copy()
    for g in groups:
        use = [j for j in g if j not in set(skip)] or list(g)
        signal[:, list(g)] = rest[:, use].mean(1, keepdims=True)
    return {"artifact": artifact, "signal": signal + mean, "random": rest - signal, "mean": mean}


def component(m: BigMatrix, model: FactorModel, which: str, k: int, n_known: int | None = None, artifact: str = "naive", scale: str = "log", add: float = 1.0, columns: Sequence[int] = (), skip: Sequence[int] = (), adjust: str | None = None, chosen: Sequence[int] | None = None) -> BigMatrix:
    """One component of every row for a choice of factors; scale "raw" undoes log(x + add), "raw2" log2(x + add).

    What cannot be read is an error: an unknown component, scale, adjustment or column, or a matrix
    that the model was not made for.
    """
    from .rowops import ADJUSTMENTS

    if which not in COMPONENTS:
        raise ValueError(f"component is one of {COMPONENTS}")
    if scale not in SCALES:
        raise ValueError(f"scale is one of {tuple(SCALES)}")
    if adjust and adjust not in ADJUSTMENTS:
        raise ValueError(f"adjustment is one of {tuple(ADJUSTMENTS)}")
    if any(not 0 <= j < m.n_cols for j in columns):
        raise ValueError("no such column")
    model.check(m)
    z, groups = model.projector(k, n_known, artifact, chosen), model.groups

    def fn(x: np.ndarray) -> np.ndarray:
        parts = split_rows(x, z, groups, skip)
        y = {"signal_random": parts["signal"] + parts["random"], "artifact": parts["artifact"], "signal": parts["signal"], "random": parts["random"], "all": x}[which]
        y = SCALES[scale](y, add)
        y = y[:, list(columns)] if columns else y
        return ADJUSTMENTS[adjust](y) if adjust else y

    out = m.map(fn)
    return out if not columns else out.with_df(out.df, tuple(m.cols[j] for j in columns))


def components_of_configs(m: BigMatrix, model: FactorModel, which: str, configs: Sequence[tuple[int, int]], **options) -> DataFrame:
    """(k, n_known, row_idx, v) for several configurations from one scan of the input."""
    zs = [(k, n, model.projector(k, n, options.get("artifact", "naive"))) for k, n in configs]
    groups = model.groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..matrix import as_lists

        for b in batches:
            if not b.num_rows:
                continue
            x = block(b.column(1))
            for k, n, z in zs:
                p = split_rows(x, z, groups)
                y = {"signal_random": p["signal"] + p["random"], "artifact": p["artifact"], "signal": p["signal"], "random": p["random"], "all": x}[which]
                rows = b.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, k, np.int32)), pa.array(np.full(rows, n, np.int32)), b.column(0), as_lists(np.ascontiguousarray(y))], ["k", "n_known", "row_idx", "v"])

    return m.df.select("row_idx", "v").mapInArrow(run, "k int, n_known int, row_idx bigint, v array<double>")


def per_config(m: BigMatrix, model: FactorModel, configs: Sequence[tuple[int, int]], fn, which: str = "signal_random", **options) -> dict[tuple[int, int], object]:
    """fn(component) for every (k, n_known): distance matrices, ANOVA and the like over a sweep of models."""
    return {(k, n): fn(component(m, model, which, k, n, **options)) for k, n in configs}


def anova_by_config(m: BigMatrix, model: FactorModel, configs: Sequence[tuple[int, int]], groups: Sequence[Sequence[int]], **options) -> DataFrame:
    """(k, n_known, row_idx, f)."""
    from .tests_stat import row_anova

    tables = per_config(m, model, configs, lambda c: row_anova(c, groups), **options)
    out = None
    for (k, n), t in tables.items():
        t = t.select(F.lit(k).alias("k"), F.lit(n).alias("n_known"), "row_idx", "f")
        out = t if out is None else out.unionByName(t)
    return out


SUMS = ("ss_t", "ss_b", "ss_u", "ss_bu", "ss_r", "b_ss_bl", "b_ss_wl")


def decompose_variance(m: BigMatrix, model: FactorModel, configs: Sequence[tuple[int, int]], artifact: str = "naive", rows: tuple[int, int] | None = None) -> DataFrame:
    """A row per (k, n_known): sums of squares about the grand means of the total, the signal (b), the
    artifact (u), both (bu) and the rest (r); the signal's between and within rows; and the shares.

    Two passes over the rows: grand means, then sums about them.
    """
    part = m if rows is None else m.rows(*rows)
    zs = [model.projector(k, n, artifact) for k, n in configs]
    groups = model.groups

    def pieces(x: np.ndarray, z: np.ndarray) -> list[np.ndarray]:
        p = split_rows(x, z, groups)
        return [x, p["signal"], p["artifact"], p["signal"] + p["artifact"], p["random"]]

    def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = np.zeros((len(zs), 6))
        for b in batches:
            if b.num_rows:
                x = block(b.column(0))
                for i, z in enumerate(zs):
                    total[i, :5] += [y.sum() for y in pieces(x, z)]
                    total[i, 5] += x.size
        return total

    first = tree_sum(part.df.select("v"), sums)
    means = np.zeros((len(zs), 5)) if first is None else first[:, :5] / np.maximum(first[:, 5:], 1)

    def squares(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = np.zeros((len(zs), len(SUMS)))
        for b in batches:
            if b.num_rows:
                x = block(b.column(0))
                for i, z in enumerate(zs):
                    got = pieces(x, z)
                    total[i, :5] += [((y - mean) ** 2).sum() for y, mean in zip(got, means[i])]
                    row = got[1].mean(1, keepdims=True)
                    total[i, 5] += x.shape[1] * ((row - means[i, 1]) ** 2).sum()
                    total[i, 6] += ((got[1] - row) ** 2).sum()
        return total

    second = tree_sum(part.df.select("v"), squares)
    second = np.zeros((len(zs), len(SUMS))) if second is None else second
    table = [(int(k), int(n), *map(float, s)) for (k, n), s in zip(configs, second)]
    df = m.df.sparkSession.createDataFrame(table, "k int, n_known int, " + ", ".join(f"{s} double" for s in SUMS))
    return variance_shares(df)


def variance_shares(sums: DataFrame) -> DataFrame:
    """Adds shares of the total: bu, b, its within-row and between-row parts b_wl and b_bl, u and e."""
    share = lambda a, b: F.try_divide(F.col(a), F.col(b))
    df = sums.withColumns({"bu": share("ss_bu", "ss_t"), "b": share("ss_b", "ss_t")})
    df = df.withColumn("b_wl", F.col("b") * (1 - share("b_ss_bl", "ss_b")))
    return df.withColumns({"b_bl": F.col("b") - F.col("b_wl"), "u": F.col("bu") - F.col("b"), "e": 1 - F.col("bu")})


def predict_rows(pairs: DataFrame, train: Sequence[int], test: Sequence[int], ridge: float = 1e-6) -> DataFrame:
    """(row_idx, error, relative): test error of the ridge regression of each response on its predictors.

    pairs: (row_idx, y, xs) with y the response's cells and xs its predictor rows; columns train fit,
    columns test are predicted; relative is against predicting the training mean.
    """
    train, test = list(train), list(test)

    def fit(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows of a batch that have the same number of predictors; x: (row, predictor, column)."""
        mean, centre = y[:, train].mean(1, keepdims=True), x[:, :, train].mean(2, keepdims=True)
        a = x[:, :, train] - centre
        beta = np.linalg.solve(a @ a.transpose(0, 2, 1) + ridge * np.eye(x.shape[1]), (a @ (y[:, train] - mean)[:, :, None]))
        guess = ((x[:, :, test] - centre) * beta).sum(1)
        error, base = ((y[:, test] - mean - guess) ** 2).mean(1), ((y[:, test] - mean) ** 2).mean(1)
        return error, np.divide(error, base, out=np.full(len(error), np.nan), where=base > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            y, lists = block(b.column(1)), b.column(2)
            many = np.diff(lists.offsets.to_numpy())
            starts = np.cumsum(many) - many
            cells = block(lists.flatten()) if many.sum() else np.zeros((0, y.shape[1]))
            error, relative = np.full(len(y), np.nan), np.full(len(y), np.nan)
            for p in np.unique(many[many > 0]).tolist():
                rows = np.flatnonzero(many == p)
                error[rows], relative[rows] = fit(y[rows], cells[starts[rows][:, None] + np.arange(p)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(error), pa.array(relative)], ["row_idx", "error", "relative"])

    return pairs.select("row_idx", "y", "xs").mapInArrow(run, "row_idx bigint, error double, relative double")
