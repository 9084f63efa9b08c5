"""Toxicity scores by non-negative positive-unlabelled learning.

A linear model over words and word beginnings is trained in numpy from confirmed toxic texts and
unlabelled text only. The risk is that of Kiryo et al. (2017): what the positives contribute to
the risk of the unlabelled as negatives is subtracted by the class prior, and never below zero.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

#: At most so many rows of each kind are used to fit; those of least hash are taken.
FIT_POSITIVES, FIT_UNLABELLED = 4_000, 8_000
#: A word counts as itself and by beginnings of these lengths.
BEGINNINGS = (4, 5, 6, 7)

_WORD = re.compile(r"[^\W\d_]+")


def words_in(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) >= n)]


class WordWeights(dict):
    """word -> weight of all its features, filled as words are met."""

    def __init__(self, weights: dict[str, float], most: int = 500_000):
        self.weights, self.most = weights, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = sum(self.weights.get(f, 0.0) for f in features_of(word))
        return value


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float

    def scorer(self):
        known = WordWeights(self.weights)

        def score(text: str | None) -> float:
            total = self.bias + sum(map(known.__getitem__, words_in(text)))
            return float(1 / (1 + np.exp(-np.clip(total, -35, 35))))

        return score


class Words:
    """Documents as arrays of word numbers; words and their features are kept once."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.feature: dict[str, int] = {}
        self.of_word: list[int] = []
        self.word_from: list[int] = [0]

    def add(self, words) -> np.ndarray:
        out = []
        for w in words:
            k = self.number.get(w)
            if k is None:
                k = self.number[w] = len(self.number)
                self.of_word += [self.feature.setdefault(f, len(self.feature)) for f in features_of(w)]
                self.word_from.append(len(self.of_word))
            out.append(k)
        return np.array(out, np.int32)

    def freeze(self) -> None:
        self.of_word, self.word_from = np.array(self.of_word, np.int32), np.array(self.word_from, np.int64)

    def features(self, doc: np.ndarray) -> np.ndarray:
        """Feature numbers of a document's words, one after another."""
        n = self.word_from[doc + 1] - self.word_from[doc]
        return self.of_word[np.repeat(self.word_from[doc] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]


#: A feature has to be in so many positives to be chosen.
LEAST_POSITIVES = 3


def nnpu_fit(positive, unlabelled, prior: float, most_features: int = 3000, **options) -> ToxicityModel:
    """From documents as collections of distinct words, or as strings of them between spaces, all in memory.

    Features are those whose rate among the positives exceeds that among the unlabelled by
    1 + log10(number of positives) times its error: the more texts, the more features are tried,
    and the fewer may enter by chance. Without positives the model is the prior alone.
    """
    if not positive or not unlabelled:
        return nnpu_train([], [], [], prior)
    words = Words()
    kinds = [[words.add(d.split() if isinstance(d, str) else d) for d in docs] for docs in (positive, unlabelled)]
    words.freeze()
    rates = []
    for docs in kinds:
        seen = np.zeros(len(words.feature), np.int64)
        for d in docs:
            seen[np.unique(words.features(d))] += 1
        rates.append(seen)
    n_p, n_u = len(kinds[0]), len(kinds[1])
    p, u = rates[0] / n_p, rates[1] / n_u
    z = (p - u) / ((p * (1 - p) + 1 / n_p) / n_p + (u * (1 - u) + 1 / n_u) / n_u) ** 0.5
    names = list(words.feature)
    found = np.flatnonzero((rates[0] >= LEAST_POSITIVES) & (z > 1 + np.log10(n_p))).tolist()
    chosen = [names[f] for f in sorted(found, key=lambda f: (-z[f], names[f]))[:most_features]]
    place = np.full(len(names), -1, np.int64)
    place[[words.feature[f] for f in chosen]] = np.arange(len(chosen))
    lists = [[x[x >= 0] for x in (place[words.features(d)] for d in docs)] for docs in kinds]
    return nnpu_train(chosen, *lists, prior, **options)


def nnpu_train(chosen: list[str], positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 400, rate: float = 0.05, ridge: float = 5e-4, slack: float = 0.0) -> ToxicityModel:
    """The model from documents as places of chosen features; a place may be there more than once.

    Minimises prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)) by Adam.
    """
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    base = float(np.log(prior / (1 - prior)))
    n_p, n_u = len(positive), len(unlabelled)
    if not n_p or not n_u:
        return ToxicityModel({}, base)

    def matrix(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the chosen features of all documents end to end, and the document of each."""
        return np.concatenate([np.zeros(0, np.int64), *docs]), np.repeat(np.arange(len(docs)), [len(g) for g in docs])

    (pi, pr), (ui, ur) = matrix(positive), matrix(unlabelled)
    k = len(chosen)
    w, b = np.zeros(k + 1), base
    w[k] = b
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -35, 35)))
    softplus = lambda x: np.logaddexp(0, x)

    def back(index, row, g):
        return np.append(np.bincount(index, g[row], k) if len(index) else np.zeros(k), g.sum())

    for step in range(1, steps + 1):
        fp = np.bincount(pr, w[pi], n_p) + w[k]
        fu = np.bincount(ur, w[ui], n_u) + w[k]
        negative = softplus(fu).mean() - prior * softplus(fp).mean()
        g_negative = back(ui, ur, sigmoid(fu) / n_u) - prior * back(pi, pr, sigmoid(fp) / n_p)
        if negative >= -slack:
            g = back(pi, pr, prior * (sigmoid(fp) - 1) / n_p) + g_negative
        else:  # the estimate of the negatives' risk went below zero: undo the over-fit
            g = -g_negative
        g[:k] += ridge * w[:k]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return ToxicityModel({f: float(x) for f, x in zip(chosen, w) if x}, float(w[k]))


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        words = [" ".join(sorted(words_in(texts[k].as_py()))) for k in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.string()), *batch.columns[2:]], ["_id", "words", "p", "u"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, p, u): in how many positives and unlabelled texts of a batch each feature is."""
    for batch in batches:
        p, u = Counter(), Counter()
        for words, in_p, in_u in zip(*(batch.column(c).to_pylist() for c in ("words", "p", "u"))):
            got = {f for w in words.split() for f in features_of(w)}
            if in_p:
                p.update(got)
            if in_u:
                u.update(got)
        names = [*p, *(f for f in u if f not in p)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([p[f] for f in names], pa.int64()), pa.array([u[f] for f in names], pa.int64())], ["feature", "p", "u"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held_fold: int = 2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", prior: float | None = None, positives: int = FIT_POSITIVES, unlabelled: int = FIT_UNLABELLED, most_features: int = 3000, **options) -> ToxicityModel:
    """Fit on rows whose crc32(id as text) mod folds is not held_fold.

    Positives are rows labelled 1; the unlabelled are rows of docs whatever their label, which is
    not looked at. The class prior is the share of 1 among the labels of these rows unless given.
    Rows with a null id are not used, of repeated ids one text is; without positives or texts the
    model is the prior alone. Other columns of both tables are not read. Features are counted and
    chosen as nnpu_fit says, but where the texts are: at most ``most_features`` features, and their
    places in at most ``positives`` and ``unlabelled`` texts, reach the driver, however long these are.
    """
    fold = lambda c: F.expr(f"{c} is not null and crc32(cast({c} as string)) % {folds} <> {held_fold}")
    known = labels.select(F.col(id_col).cast("bigint").alias("_id"), F.col(label_col).cast("int").alias("_y")).where(fold("_id")).where("_y in (0, 1)")
    if prior is None:
        n = known.agg(F.sum("_y").alias("p"), F.count("*").alias("n")).first()
        prior = (n["p"] or 0) / max(n["n"], 1)
    toxic = known.where("_y = 1").select("_id").distinct().orderBy(F.xxhash64("_id"), "_id").limit(positives)
    text = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_t")).where(fold("_id"))
    some = text.select("_id").distinct().orderBy(F.xxhash64("_id", F.lit(1)), "_id").limit(unlabelled)
    both = toxic.select("_id", F.lit(1).alias("p"), F.lit(0).alias("u")).unionByName(some.select("_id", F.lit(0).alias("p"), F.lit(1).alias("u")))
    wanted = F.broadcast(both.groupBy("_id").agg(F.max("p").alias("p"), F.max("u").alias("u")))  # a stated number of rows of three numbers
    met = text.join(wanted, "_id").mapInArrow(_words_of, "_id bigint, words string, p int, u int")
    met = materialize(met.groupBy("_id").agg(F.min("words").alias("words"), F.max("p").alias("p"), F.max("u").alias("u")), "toxicity-words")
    n = met.agg(F.sum("p").alias("p"), F.sum("u").alias("u")).first()
    n_p, n_u = n["p"] or 0, n["u"] or 0
    if not n_p or not n_u:
        release(met)
        return nnpu_train([], [], [], prior)
    counts = met.select("words", "p", "u").mapInArrow(_counted, "feature string, p bigint, u bigint").groupBy("feature").agg(F.sum("p").alias("n_p"), F.sum("u").alias("n_u"))
    rates = counts.where(F.col("n_p") >= LEAST_POSITIVES).select("feature", (F.col("n_p") / n_p).alias("p"), (F.col("n_u") / n_u).alias("u"))
    z = F.expr(f"(p - u) / sqrt((p * (1 - p) + 1D / {n_p}) / {n_p} + (u * (1 - u) + 1D / {n_u}) / {n_u})")
    best = rates.select("feature", z.alias("z")).where(F.col("z") > 1 + float(np.log10(n_p))).orderBy(F.desc("z"), "feature").limit(most_features)
    chosen = [r["feature"] for r in best.collect()]
    place = {f: k for k, f in enumerate(chosen)}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[place[f] for w in words.split() for f in features_of(w) if f in place] for words in batch.column(1).to_pylist()]
            sets = [np.unique(r, return_counts=True) if r else ([], []) for r in rows]
            lists = [pa.array([list(map(int, s[k])) for s in sets], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *lists], ["p", "u", "places", "times"])

    rows = met.orderBy("_id").select("_id", "words", "p", "u").mapInArrow(found, "p int, u int, places array<int>, times array<int>").collect()
    release(met)
    lists = [[np.repeat(np.array(r["places"], np.int64), r["times"]) for r in rows if r[k]] for k in ("p", "u")]
    return nnpu_train(chosen, *lists, prior, **options)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) per row from whole texts; a text without words, like null, gets the bias alone.

    Rows with null or repeated ids are scored like others, an empty table gives no rows, and other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            texts = batch.column(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([score(texts[k].as_py()) for k in range(batch.num_rows)], pa.float64())], [id_col, "score"])

    return docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).cast("string").alias("_t")).mapInArrow(run, f"`{id_col}` bigint, score double")
