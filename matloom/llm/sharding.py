"""Shards cut from Hilbert-curve order, for files that several metadata columns can prune.

Every dimension is quantised to a grid by the ranks of its values, the cell's place on the Hilbert
curve orders the rows, and consecutive runs of equal count become shards. All of it is DataFrame
expressions: quantiles of the dimensions, one scan that writes narrow rows with their place on the
curve, one range-partitioned sort of these, one small table of counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialize, quoted, release

#: So many different strings of a dimension are ranked on the driver at most; beyond, ranges of them.
DISTINCT = 4096


def _turns(n: int) -> list[int]:
    """The curve's steps in one table: at state * 2**n + bits lies next state * 2**n + digit.

    Hamilton's account of the curve (Compact Hilbert Indices, 2006): a state is an entry corner e and
    a direction d. The bits of a level, seen from the state, are a Gray code; its number is the
    digit, and corner and direction of that number lead to the state of the level below.
    """
    full = (1 << n) - 1
    left = lambda x, k: (x << k % n | x >> (n - k % n)) & full if k % n else x
    ones = lambda x: ((x ^ (x + 1)).bit_length() - 1) if x != full else n  # noqa: E731  trailing ones
    out = [0] * (n << 2 * n)
    for e in range(1 << n):
        for d in range(n):
            for bits in range(1 << n):
                seen = left(bits ^ e, n - (d + 1) % n)
                w, shift = seen, 1
                while shift < n:
                    w ^= w >> shift
                    shift *= 2
                corner = 0 if w == 0 else (w - 1 >> 1 << 1) ^ (w - 1 >> 1 << 1) >> 1
                along = 0 if w == 0 else ones(w - 1 if w % 2 == 0 else w) % n
                state = (e ^ left(corner, d + 1)) * n + (d + along + 1) % n
                out[((e * n + d) << n) + bits] = (state << n) + w
    return out


def _array(values) -> Column:
    return F.expr(f"array({', '.join(map(str, values))})")


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of a grid cell; each cell coordinate has ``bits`` bits.

    From the highest bit down, one look into the table of the curve's steps for each level.
    """
    n = len(cells)
    if n == 1:
        return cells[0].cast("bigint")
    table, low = _array(_turns(n)), (1 << n) - 1
    met, total = F.lit(0), F.lit(0).cast("bigint")
    for level in range(bits - 1, -1, -1):
        digit = F.lit(0)
        for k, c in enumerate(cells):
            digit = digit.bitwiseOR(F.shiftleft(F.shiftright(c.cast("int"), level).bitwiseAND(1), k))
        met = F.get(table, met.bitwiseAND(~low).bitwiseOR(digit))
        total = total.bitwiseOR(F.shiftleft(met.bitwiseAND(low).cast("bigint"), n * level))
    return total


def _string_cuts(docs: DataFrame, name: str, cells: int) -> list[str]:
    """cells - 1 sorted strings: a value's cell is how many of them are not above it.

    A value's cell is its rank, scaled, and different values have different cells as long as there
    are enough. Of more than DISTINCT values ranges are ranked, by their least value.
    """
    counts = docs.where(F.col(quoted(name)).isNotNull()).groupBy(F.col(quoted(name)).alias("v")).agg(F.count("*").alias("w"))
    counts = materialize(counts, "hilbert-values")
    rows = counts.limit(DISTINCT + 1).collect()
    if len(rows) > DISTINCT:
        ranges = counts.repartitionByRange(DISTINCT, "v").groupBy(F.spark_partition_id().alias("p"))
        rows = ranges.agg(F.min("v").alias("v"), F.sum("w").alias("w")).collect()
    release(counts)
    rows = sorted((r["v"].encode(), r["w"]) for r in rows)
    total, before, cell, cuts = sum(w for _, w in rows), 0, -1, []
    for k, (v, w) in enumerate(rows):
        rank = before * cells // total
        cell = rank if len(rows) > cells else min(max(rank, cell + 1), cells - len(rows) + k)
        cuts += [v.decode()] * (cell - len(cuts))
        before += w
    return cuts


def _cuts(docs: DataFrame, dimensions: list[str], cells: int) -> tuple[dict[str, Column], dict[str, Column]]:
    """For each dimension its value as something that can be compared, and an array of cells - 1 sorted cuts (or nulls)."""
    value, cuts, numbers = {}, {}, []
    for d in dimensions:
        kind, c = docs.schema[d].dataType, F.col(quoted(d))
        if isinstance(kind, T.StringType):
            value[d] = c
            found = _string_cuts(docs, d, cells)
            texts = [F.lit(x) for x in found]
            cuts[d] = F.array(*texts, *([F.lit(None).cast("string")] * (cells - 1 - len(found))))
            continue
        number = c.cast("timestamp").cast("double") if isinstance(kind, (T.TimestampType, T.DateType, T.TimestampNTZType)) else c.cast("double")
        value[d] = F.nanvl(number, F.lit(None).cast("double"))
        numbers.append(d)
    if numbers:
        at = [k / cells for k in range(1, cells)]
        got = docs.agg(*(F.percentile_approx(value[d], at, 10_000).alias(f"q{k}") for k, d in enumerate(numbers))).first()
        for k, d in enumerate(numbers):
            found = got[f"q{k}"] or []
            cuts[d] = _array([*(f"{x!r}D" if abs(x) < float("inf") else f"double('{x}')" for x in found), *["cast(null as double)"] * (cells - 1 - len(found))])
    return value, cuts


def hilbert_shards(docs: DataFrame, dimensions: list[str], shards: int = 16, bits: int = 8, id_col: str = "doc_id", carry: dict[str, Column] | None = None) -> DataFrame:
    """(id, *carry, hilbert, shard, slot) per row: runs of the curve order whose counts differ by one at most.

    Each dimension (numbers, times or strings) is cut into 2**bits cells at its quantiles, so that
    neither outliers nor a common prefix leave cells unused; numbers by a sketch of 1/10,000 of the
    rows. Nulls and NaN lie in cell 0. Rows of one cell follow by id, null ids first, then by the
    carried columns, so that repeated rows have a fixed place up to their equality and a hot cell is
    split by range like any other. An empty table gives no rows. Columns that are not named are not
    read, whatever their names.
    """
    carry, cells = carry or {}, 1 << bits
    value, cuts = _cuts(docs, dimensions, cells)
    narrow = docs.select(F.col(quoted(id_col)).alias("_id"), F.struct(*(c.alias(k) for k, c in carry.items())).alias("_carry") if carry else F.lit(True).alias("_carry"), *(v.alias(f"_v{k}") for k, v in enumerate(value.values())))
    place = {f"_c{k}": F.lit(0) for k in range(len(dimensions))}
    narrow = narrow.withColumns(place)
    for b in range(bits - 1, -1, -1):  # binary search for the number of cuts that are not above the value
        step = {c: F.when(F.get(cuts[d], F.col(c) + F.lit((1 << b) - 1)) <= F.col(f"_v{k}"), F.col(c) + F.lit(1 << b)).otherwise(F.col(c)) for k, (c, d) in enumerate(zip(place, dimensions))}
        narrow = narrow.withColumns(step)
    rows = materialize(narrow.select("_id", "_carry", hilbert_index([F.col(c) for c in place], bits).alias("hilbert")), "hilbert-rows")
    total = rows.count()
    by = ["hilbert", "_id", "_carry"]
    n_parts = max(shards, -(-total // 1_000_000))
    ordered = rows.repartitionByRange(n_parts, *by).sortWithinPartitions(*by)
    # the low 33 bits of the id number the rows of a partition in their order
    placed = materialize(ordered.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_nth")), "hilbert-order")
    release(rows)
    starts, before = {}, 0
    for p in placed.groupBy("_part").count().orderBy("_part").collect():  # a row per partition
        starts[p["_part"]] = before
        before += p["count"]
    begin = F.get(_array(f"{starts.get(k, 0)}L" for k in range(max(starts, default=0) + 1)), F.col("_part"))
    out = placed.withColumn("_at", begin + F.col("_nth")).withColumn("shard", F.expr(f"cast(((_at + 1) * {shards} - 1) div {max(total, 1)} as int)"))
    slot = F.expr(f"_at - (cast(shard as bigint) * {total}) div {shards}")
    return out.select(F.col("_id").alias(id_col), *(F.col("_carry").getField(k).alias(k) for k in carry), "hilbert", "shard", slot.alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Whole rows as one folder per shard, in curve order, so that Parquet statistics prune each dimension.

    placed: a row per document of distinct, non-null id, as hilbert_shards returns.
    """
    key, shard, slot = (fresh(docs.columns, x) for x in ("shard_key", "shard", "slot"))
    keys = placed.select(F.col(quoted(id_col)).alias(key), F.col("shard").alias(shard), F.col("slot").alias(slot))
    joined = docs.join(keys, F.col(quoted(id_col)) == F.col(key)).drop(key)
    joined.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
