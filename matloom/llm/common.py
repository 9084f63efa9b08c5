"""Shared pieces: scratch tables (from matloom.scratch), key filters and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize, release, release_all, scratch_path, scratch_root, scratch_scope

__all__ = ["connected_components", "fresh", "materialize", "quoted", "release", "release_all", "scratch_path", "scratch_root", "scratch_scope", "sift"]


def fresh(columns: list[str], name: str) -> str:
    """The name, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def quoted(name: str) -> str:
    """A column's name for F.col, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def sift(df: DataFrame, key: Column, keys: DataFrame, name: str, most_bits: int = 1 << 26) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose BIGINT key is surely not in column ``name`` of keys, and all others.

    Only the second part needs a join with the keys, so that the rest is not shuffled. The test is a
    bit map of uniform hashes with 32 bits a key, sent out as words of 64 bits. It never has more
    than ``most_bits`` (a million words); beyond that it only lets more rows through to the join.
    """
    n = keys.count()
    if not n:
        return df, df.where(F.lit(False))
    bits = 1 << max(16, min(most_bits.bit_length() - 1, (32 * n - 1).bit_length()))
    at, word = fresh(df.columns, "at"), fresh(df.columns, "word")
    place = lambda k: k.bitwiseAND(bits - 1)
    bit = lambda k: k.bitwiseAND(63).cast("int")
    k = F.col(name)
    words = keys.groupBy(F.shiftright(place(k), 6).alias(at)).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(k))).alias(word))
    words = F.broadcast(materialize(words, "key-words"))
    met = df.join(words, F.shiftright(place(key), 6) == F.col(at), "left")
    hit = F.coalesce(F.call_function("shiftrightunsigned", F.col(word), bit(key)).bitwiseAND(1) == 1, F.lit(False))
    return met.where(~hit).drop(at, word), met.where(hit).drop(at, word)


def _minima(pairs: DataFrame) -> DataFrame:
    """(u, m): for each u the least of u and its neighbours v."""
    return materialize(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-min")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph given as ``edges(a BIGINT, b BIGINT)``.

    Returns ``(node, root)`` for every node with an edge to another node; root is the least node
    of its component. Alternates the large-star and small-star steps (Kiveris et al. 2014); each
    step is a partial aggregation and an equi-join of two written tables, so that a node with very
    many neighbours is split by adaptive skew handling. Nothing but two counts reaches the driver.
    Self loops, nulls and repeated edges are ignored.
    """
    e = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges"
    )
    for _ in range(max_rounds):
        # every a has one b and no b is itself an a: the graph is a set of stars round their least nodes
        n = e.agg(F.count("*").alias("n"), F.countDistinct("a").alias("d")).first()
        if n["n"] == n["d"] and e.join(e.select(F.col("a").alias("x")), F.col("b") == F.col("x"), "left_semi").isEmpty():
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        m = _minima(both)
        large = materialize(
            both.where("v > u").join(m, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large"
        )
        release(e, m)
        m = _minima(large)  # here v < u always holds
        joined = large.join(m, "u")
        e = materialize(
            joined.where("v <> m")
            .select(F.col("v").alias("a"), F.col("m").alias("b"))
            .unionByName(m.select(F.col("u").alias("a"), F.col("m").alias("b")))
            .distinct(),
            "cc-edges",
        )
        release(large, m)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
