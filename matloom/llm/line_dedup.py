"""Line deduplication over overlapping windows of three lines.

Windows are hashed once, where the text is read, and written as hashes and places; a count by one
64-bit hash leaves the windows that may repeat, then those few are compared by 128 bits. Only texts
that may have a covered line are shuffled, to meet their spans. The joins are merge joins at every
size, since what repeats grows with the input and has no bound that would allow to send it out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, quoted, release, sift


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row is known by its id and two hashes of id and text: twins in both are one document."""
    text, doc = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("bigint")
    return docs.select(doc.alias("doc_id"), text.alias("text"), F.xxhash64(doc, text).alias("k1"), F.xxhash64(text, F.lit(1), doc).alias("k2"))


def windows(keyed: DataFrame, span: int = 3) -> DataFrame:
    """A row per window: hashes h1 and h2, its number pos, and lines, the places of its lines.

    Lines without visible characters stand in no window. A text of fewer lines, but not none, is
    one window of them all.
    """
    lines = r"filter(transform(split(text, '\n', -1), (x, i) -> struct(x, i)), s -> trim(BOTH ' \t\r' FROM s.x) <> '')"
    hashed = F.expr(f"transform({lines}, s -> struct(s.i AS i, xxhash64(s.x, 1) AS a, xxhash64(2, s.x) AS b))")  # each line once
    # line k with those after it: linear in the lines, where a slice for each window would copy a list each time
    beside = F.arrays_zip(*(F.expr(f"slice(c, {1 + k}, size(c))").alias(f"l{k}") for k in range(span)))
    fields = lambda f: ", ".join(f"w.l{k}.{f}" for k in range(span))
    each = F.expr(
        f"""transform(slice(z, 1, greatest(size(c) - {span - 1}, 1)), (w, i) -> struct(i + 1 AS pos,
              xxhash64(least(size(c), {span}), {fields("a")}) AS h1, xxhash64({fields("b")}, least(size(c), {span})) AS h2, array_compact(array({fields("i")})) AS lines))"""
    )
    held = keyed.withColumn("c", hashed).withColumn("z", beside)
    return held.select("doc_id", "k1", "k2", F.explode(each).alias("w")).select("doc_id", "k1", "k2", "w.*")


def covered_lines(keyed: DataFrame, span: int = 3) -> DataFrame:
    """(doc_id, k1, k2, spans): line ranges [from, to] that later occurrences of windows cover.

    The first occurrence is that of the smallest (doc_id, k1, k2, pos), null ids last. Where a
    window overlaps its own first occurrence, only what lies beyond the first is covered.
    """
    found = materialize(windows(keyed, span), "lines-all")
    maybe = materialize(found.groupBy("h1").count().where("count > 1").select("h1"), "lines-repeated")
    some = materialize(found.join(maybe.hint("merge"), "h1"), "lines-windows")
    release(found, maybe)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2", "pos")
    first = materialize(some.groupBy("h1", "h2").agg(F.min(place).alias("f"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "f"), "lines-first")
    same = F.expr("doc_id <=> f.doc_id and k1 = f.k1 and k2 = f.k2")
    ahead = F.when(same, F.col("pos") - F.col("f.pos")).otherwise(F.lit(span))
    later = some.join(first.hint("merge"), ["h1", "h2"]).withColumn("ahead", ahead).where("ahead > 0")
    begin = F.expr(f"element_at(lines, 1 + greatest({span} - ahead, 0))")
    return later.select("doc_id", "k1", "k2", F.struct(begin.alias("a"), F.element_at("lines", -1).alias("b")).alias("s")).groupBy("doc_id", "k1", "k2").agg(F.collect_set("s").alias("spans"))


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = batch.column("text"), batch.column("spans")
        out, total, removed = [], [], []
        for k in range(batch.num_rows):
            text, cover = texts[k].as_py(), spans[k].as_py()
            lines = text.split("\n")
            full = sum(1 for x in lines if x.strip(" \t\r"))
            total.append(full)
            if not cover:
                out.append(text)
                removed.append(0)
                continue
            gone = bytearray(len(lines))
            for s in cover:
                gone[s["a"] : s["b"] + 1] = b"\1" * (s["b"] + 1 - s["a"])
            kept = [x for x, g in zip(lines, gone) if not g]
            left = sum(1 for x in kept if x.strip(" \t\r"))
            out.append("\n".join(kept) if left else "")
            removed.append(full - left)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in batch.schema.names if c not in ("text", "spans")), pa.array(out, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())],
            [*(c for c in batch.schema.names if c not in ("text", "spans")), "text", "n_lines", "n_removed"],
        )


def rewritten(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 3, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows that surely lose no line (doc_id, kept, text), and the others (.., n_lines, n_removed) as dedup_lines says.

    kept is a struct of the columns ``keep``, whatever their names.
    """
    keyed = _keyed(docs, id_col, text_col)
    cover = materialize(covered_lines(keyed, span), "lines-covered").withColumnsRenamed({"doc_id": "d", "k1": "j1", "k2": "j2"})
    kept = F.struct(*(docs[quoted(c)] for c in keep)) if keep else F.lit(True)
    full = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), kept.alias("kept"))
    full = full.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64("text", F.lit(1), "doc_id")})
    rest, some = sift(full, F.col("k1"), cover, "j1")
    met = some.join(cover.hint("merge"), F.expr("k1 = j1 and k2 = j2 and doc_id <=> d"), "left").select("doc_id", "kept", "text", "spans")
    numbers = [T.StructField(c, T.LongType()) for c in ("n_lines", "n_removed")]
    changed = met.mapInArrow(_rewritten, T.StructType([met.schema["doc_id"], met.schema["kept"], T.StructField("text", T.StringType()), *numbers]))
    return rest.select("doc_id", "kept", "text"), changed


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: (doc_id, *keep, text, n_lines, n_removed).

    text lacks the lines that later occurrences of ``span`` consecutive lines cover; if none with
    visible characters is left, it is empty. n_lines and n_removed count lines with visible
    characters. Null texts come back empty. Rows that agree in id and text are one document, and
    what is removed goes from each. An empty table gives no rows. Columns but the named ones and
    ``keep`` are not read; those of ``keep`` may have any names but the four of the result, for
    which rewritten() has them in a struct.
    """
    if taken := {"doc_id", "text", "n_lines", "n_removed"} & {c.lower() for c in keep}:
        raise ValueError(f"the result has its own {sorted(taken)}")
    same, changed = rewritten(docs, id_col, text_col, span, keep)
    n_lines = F.expr(r"cast(size(filter(split(text, '\n', -1), x -> trim(BOTH ' \t\r' FROM x) <> '')) as bigint)")
    every = same.withColumns({"n_lines": n_lines, "n_removed": F.lit(0).cast("bigint")}).unionByName(changed)
    return every.select("doc_id", *(F.col("kept").getField(c).alias(c) for c in keep), "text", "n_lines", "n_removed")
