"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Shallow trees grown on bootstrap samples give candidate rules (the paths from the root to every
node), a lasso logistic regression keeps few of them, and those become one Spark expression, so
that scoring is a projection of the documents without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[tuple[str, bool, float], ...]

#: At most so many labelled rows are used to fit; the rows of least hash are taken.
FIT_ROWS = 20_000


STATISTICS = (
    "log_chars chars_per_word words_per_line distinct_words repeated_words distinct_lines symbols pipes exclamations digits sentence_ends upper".split()
)


def with_statistics(df: DataFrame, text_col: str, prefix: str) -> DataFrame:
    """df with a column ``prefix + name`` for each of STATISTICS of whole texts; null texts are empty.

    Words and lines are columns of their own, so that each is split once for all that is counted, and
    so is the text without small letters and spaces, in whose few characters the others are counted.
    """
    t, words, lines, rest = (f"`{prefix}{x}`" for x in ("text", "words", "lines", "rest"))
    n, n_words, n_lines = f"greatest(length({t}), 1)", f"greatest(size({words}), 1)", f"greatest(size({lines}), 1)"
    share = lambda drop: F.expr(f"(length({rest}) - length(translate({rest}, '{drop}', ''))) / cast({n} as double)")
    values = {
        "log_chars": F.expr(f"log1p(length({t}))"),
        "chars_per_word": F.expr(f"length({t}) / cast({n_words} as double)"),
        "words_per_line": F.expr(f"size({words}) / cast({n_lines} as double)"),
        "distinct_words": F.expr(f"size(array_distinct({words})) / cast({n_words} as double)"),
        "repeated_words": F.regexp_count(F.col(t), F.lit(r"(?<![^ \n])([^ \n]++)(?=[ \n]\1(?![^ \n]))")) / F.expr(f"cast({n_words} as double)"),
        "distinct_lines": F.expr(f"size(array_distinct({lines})) / cast({n_lines} as double)"),
        "symbols": share("#$%&*+<=>@[]^_{|}~"),
        "pipes": share("|"),
        "exclamations": share("!"),
        "digits": share("0123456789"),
        "sentence_ends": share("."),
        "upper": F.regexp_count(F.col(rest), F.lit("\\p{Lu}")) / F.expr(f"cast({n} as double)"),
    }
    df = df.withColumn(f"{prefix}text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    df = df.withColumns({
        f"{prefix}words": F.array_remove(F.split(F.col(t), "[ \\t\\r\\n]+"), ""),
        f"{prefix}lines": F.array_remove(F.split(F.col(t), "\n"), ""),
        f"{prefix}rest": F.regexp_replace(t, "[\\p{Ll} \n,]+", ""),
    })
    return df.withColumns({prefix + k: values[k] for k in STATISTICS}).drop(*(prefix + x for x in ("text", "words", "lines", "rest")))


def _grow(x: np.ndarray, y: np.ndarray, depth: int, path: tuple, out: set, min_leaf: int, rng: np.random.Generator) -> None:
    """All paths of a tree that splits by Gini impurity among a random half of the statistics."""
    if path:
        out.add(tuple(sorted(path)))
    if not depth or len(y) < 2 * min_leaf or y.min() == y.max():
        return
    best = (1e-9, None, 0.0)
    p = y.mean()
    for f in rng.permutation(x.shape[1])[: max(2, (x.shape[1] + 1) // 2)]:
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        at = np.arange(min_leaf, len(y) - min_leaf + 1)
        at = at[v[at - 1] < v[np.minimum(at, len(v) - 1)]]
        if not len(at):
            continue
        left = ones[at - 1] / at
        right = (ones[-1] - ones[at - 1]) / (len(y) - at)
        gain = p * (1 - p) - (at * left * (1 - left) + (len(y) - at) * right * (1 - right)) / len(y)
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (gain[k], int(f), float((v[at[k] - 1] + v[at[k]]) / 2))
    if best[1] is None:
        return
    low = x[:, best[1]] <= best[2]
    for side, mask in ((True, low), (False, ~low)):
        _grow(x[mask], y[mask], depth - 1, (*path, (best[1], side, best[2])), out, min_leaf, rng)


def _holds(x: np.ndarray, rule: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, low, cut in rule:
        out &= (x[:, f] <= cut) if low else (x[:, f] > cut)
    return out


def _lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty, by accelerated proximal gradient steps."""
    n, k = a.shape
    w, z, b, c, t = np.zeros(k), np.zeros(k), 0.0, 0.0, 1.0
    rate = 4 * n / (np.linalg.norm(a, 2) ** 2 + n)
    for _ in range(steps):
        r = 1 / (1 + np.exp(-np.clip(a @ z + c, -35, 35))) - y
        w1 = z - rate * (a.T @ r) / n
        w1 = np.sign(w1) * np.maximum(np.abs(w1) - rate * penalty, 0)
        b1 = c - rate * r.mean()
        t1 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, c = w1 + (t - 1) / t1 * (w1 - w), b1 + (t - 1) / t1 * (b1 - b)
        w, b, t = w1, b1, t1
    return w, b


@dataclass
class RuleModel:
    rules: list[tuple[Rule, float]]
    bias: float

    def score(self, statistic: dict[str, Column]) -> Column:
        """The score as one Spark expression over the columns that hold the statistics."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            test = F.lit(True)
            for name, low, cut in rule:
                test = test & ((statistic[name] <= cut) if low else (statistic[name] > cut))
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 24, depth: int = 3, penalty: float = 0.002, steps: int = 400, seed: int = 7) -> RuleModel:
    """Rules and weights from a matrix of statistics and 0/1 labels; without both labels, a constant."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1.0)
        return RuleModel([], float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    found: set = set()
    for _ in range(trees):
        rows = rng.integers(0, len(y), min(len(y), 4000))
        _grow(x[rows], y[rows], depth, (), found, max(3, len(rows) // 200), rng)
    columns: dict[bytes, tuple] = {}
    for rule in sorted(found, key=lambda r: (len(r), r)):  # of rules that hold alike the shortest stays
        h = _holds(x, rule)
        if 0 < h.sum() < len(h):
            key = min(h.tobytes(), (~h).tobytes())
            columns.setdefault(key, rule)
    rules = list(columns.values())
    if not rules:
        share = (y.sum() + 0.5) / (len(y) + 1.0)
        return RuleModel([], float(np.log(share / (1 - share))))
    a = np.stack([_holds(x, r) for r in rules], 1).astype(float)
    w, b = _lasso(a, y.astype(float), penalty, steps)
    kept = [(tuple((names[f], low, cut) for f, low, cut in r), float(v)) for r, v in zip(rules, w) if abs(v) > 1e-6]
    return RuleModel(kept, float(b))


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS, **options) -> RuleModel:
    """Fit on labelled rows whose crc32(id as text) mod folds is not held_fold, at most fit_rows of them.

    Rows with a null id or label are not used; of rows with the same id the least label counts, and
    of texts with the same id the one whose statistics come first. Without rows, or without both
    labels, the model is a constant. Other columns of both tables are not read.
    """
    known = (
        labels.select(F.col(id_col).cast("bigint").alias("_id"), F.col(label_col).cast("int").alias("_y"))
        .where(f"_id is not null and _y in (0, 1) and crc32(cast(_id as string)) % {folds} <> {held_fold}")
        .groupBy("_id")
        .agg(F.min("_y").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(fit_rows)
    )
    wanted = F.broadcast(known)  # fit_rows rows of two numbers at most
    text = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_t")).join(wanted, "_id")
    # counted where the texts are read: only numbers are shuffled
    stats = with_statistics(text, "_t", "").select("_id", F.struct("_y", *STATISTICS).alias("_s")).groupBy("_id").agg(F.min("_s").alias("_s"))
    rows = stats.select("_id", "_s.*").toPandas().sort_values("_id")
    return fit_rules(rows[STATISTICS].to_numpy(float), rows["_y"].to_numpy(int), STATISTICS, **options)


def score_quality(docs: DataFrame, model: RuleModel, text_col: str = "text") -> DataFrame:
    """docs with a column score: 0 to 1, higher where label 1 is likelier.

    Every row is scored from its whole text alone; null and empty texts get what their statistics,
    all zero, give. Other columns pass through; a column named score is replaced.
    """
    prefix = "_q_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    held = with_statistics(docs, text_col, prefix)
    return held.withColumn("score", model.score({k: F.col(prefix + k) for k in STATISTICS})).drop(*(prefix + k for k in STATISTICS))


def accepted(docs: DataFrame, model: RuleModel, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, whose score is at least the threshold.

    The row number keeps the optimiser from moving the condition below the statistics, where a
    filter would work out each of them again for every rule that names it.
    """
    number = "_row"
    while any(c.startswith(number) for c in docs.columns):
        number = "_" + number
    scored = score_quality(docs.withColumnRenamed("score", number + "_score"), model, text_col).withColumn(number, F.monotonically_increasing_id())
    kept = scored.where((F.col("score") >= threshold) & (F.col(number) >= 0)).drop("score")
    return kept.withColumnRenamed(number + "_score", "score").select(*docs.columns)
