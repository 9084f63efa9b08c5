"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Lengths are whole numbers up to the capacity, so an instance is its histogram: a few thousand
counts, however many documents there are. The reduction and the best fit work on the counts and
give patterns (the lengths in a sequence, and how many sequences look so); documents find their
place by their rank among those of equal length.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Lower-case Latin words, which no normalisation changes; as UTF-8.
_PLAIN = re.compile("(?:[a-z]|{})+".format("|".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)).encode())
#: Punctuation that no contraction or special token has, so that a word before it stays a token run of its own.
_ENDINGS = b".,;:!?%*#$&)]}"

Pattern = tuple[tuple[int, ...], int]


class ChunkIds(dict):
    """Token ids, as little-endian uint32 bytes, of chunks that hold no white space.

    The tokenizer drops white space and no token spans it, so a text's ids are those of its chunks.
    They are worked out as chunks are met, and at most so many are kept.
    """

    def __init__(self, path: str, most: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in visible]
        self.split = self.tokenizer.model.tokenize
        #: byte-level BPE writes a byte as its own character, or as one from U+0100 on if it is not visible
        self.glyphs = [chr(b) if b in visible else chr(0x100 + hidden.index(b)) for b in range(256)]

    def __missing__(self, chunk: bytes) -> bytes:
        """Those of a plain word and its punctuation come from both parts."""
        if len(self) >= self.most:
            self.clear()
        core = chunk.rstrip(_ENDINGS)
        word = core.lower()
        if word.isalpha() or _PLAIN.fullmatch(word):
            ids = self.get(word)
            if ids is None:
                ids = self[word] = b"".join([t.id.to_bytes(4, "little") for t in self.split("".join([self.glyphs[x] for x in word]))])
            if len(core) < len(chunk):
                ids += self[chunk[len(core) :]]
        else:
            ids = np.array(self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        self[chunk] = ids
        return ids


@functools.lru_cache(maxsize=1)
def _chunk_ids(path: str) -> ChunkIds:
    """The ids that a worker process has met, kept from task to task."""
    return ChunkIds(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids: (doc_id, piece, start, length, ids_crc32, task, nth[, ids]).

    nth counts the pieces of equal length of one task; with task it makes a rank. Null texts are
    empty: one piece that holds only the end id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _chunk_ids(tokenizer_path)
        seen = np.zeros(capacity + 1, np.int64)
        task = TaskContext.get().partitionId()
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            out: list[list] = [[] for _ in range(8)]
            held = 0
            for doc, text in zip(ids, texts):
                whole = b"".join(map(known.__getitem__, text.as_py().split())) + end if text.is_valid else end
                for k in range(-(-len(whole) // (4 * capacity))):
                    part = whole[4 * capacity * k : 4 * capacity * (k + 1)]
                    n = len(part) // 4
                    for column, value in zip(out, (doc, k, k * capacity, n, zlib.crc32(part), task, int(seen[n]), part if keep_ids else None)):
                        column.append(value)
                    seen[n] += 1
                held += len(whole)
                if held > 32 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)
                    out, held = [[] for _ in range(8)], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", *["ids"] * keep_ids]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * keep_ids]
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint" + ", ids binary" * keep_ids)


def _smallest(left: list[int], sizes: list[int], skip: int, n: int) -> list[int]:
    """The n smallest items, without one item of size skip."""
    out: list[int] = []
    for s in sizes:
        out += [s] * min(n, left[s] - (s == skip))
        if len(out) >= n:
            break
    return out[:n]


def _best_pair(left: list[int], sizes: list[int], skip: int, room: int) -> tuple[int, int]:
    """Items a >= b of greatest sum within room, without one item of size skip; of equal sums that of largest a."""
    have = [s for s in sizes if left[s] - (s == skip) > 0 and s < room]
    best, lo, hi = (0, 0), 0, len(have) - 1
    while lo <= hi:
        a, b = have[hi], have[lo]
        if a + b > room:
            hi -= 1
            continue
        if a + b > sum(best) and (a != b or left[a] - (a == skip) > 1):
            best = (a, b)
        lo += 1
    return best


def dominance_reduction(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Sets of one, two or three items that dominate all others with their largest item, for good.

    For the largest item j: alone if nothing fits beside it; with the largest i that fits, if that
    fills the sequence, if no two items fit beside j, or if at most two fit and no two fill more
    than i; with the fullest pair a, b if at most two fit, a is as large as i and no two items
    between a and b fit beside j. Equal items are fixed together. Repeats on the smaller instance
    until nothing more is fixed. Returns what is fixed and the counts that remain.
    """
    left = [0] * (capacity + 1)
    for size, n in counts.items():
        left[size] = n
    fixed: list[Pattern] = []

    def fix(items: tuple[int, ...]) -> None:
        need = Counter(items)
        n = min(left[s] // k for s, k in need.items())
        for s, k in need.items():
            left[s] -= n * k
        fixed.append((items, n))

    again = True
    while again:
        again = False
        for j in range(capacity, 0, -1):
            while left[j]:
                room = capacity - j
                sizes = [s for s in range(1, max(room, 1) + 1) if left[s] - (s == j) > 0]
                if not sizes or sizes[0] > room:
                    n, left[j] = left[j], 0
                    fixed.append(((j,), n))
                    again = True
                    break
                i = sizes[-1]
                low = _smallest(left, sizes, j, 3)
                chosen: tuple[int, ...] = ()
                if i == room or len(low) < 2 or low[0] + low[1] > room:
                    chosen = (j, i)
                elif len(low) < 3 or sum(low) > room:
                    a, b = _best_pair(left, sizes, j, room)
                    if i >= a + b:
                        chosen = (j, i)
                    elif a == i:
                        between = [s for s in sizes if b < s < a for _ in range(min(2, left[s] - (s == j)))][:2]
                        if len(between) < 2 or sum(between) > room:
                            chosen = (j, a, b)
                need = Counter(chosen)
                if not chosen or min(left[s] // k for s, k in need.items()) == 0:
                    break
                fix(chosen)
                again = True
    return fixed, {s: n for s, n in enumerate(left) if n}


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """What best fit gives for the items in decreasing order, equal sequences counted together."""
    open_: dict[int, list[list]] = {capacity: []}
    for size in sorted(counts, reverse=True):
        n = counts[size]
        for room in sorted(r for r in open_ if r >= size and r < capacity):
            if not n:
                break
            fit, rest = room // size, []
            for items, many in open_.pop(room):
                full = min(many, n // fit)
                if full:  # each takes as many as fit before the next is tried, for its room is then the least
                    open_.setdefault(room - fit * size, []).append([items + (size,) * fit, full])
                    n -= full * fit
                    many -= full
                if many and 0 < n < fit:
                    open_.setdefault(room - n * size, []).append([items + (size,) * n, 1])
                    n, many = 0, many - 1
                if many:
                    rest.append([items, many])
            if rest:
                open_.setdefault(room, []).extend(rest)
        if n:
            fit = capacity // size
            if n // fit:
                open_.setdefault(capacity - fit * size, []).append([(size,) * fit, n // fit])
            if n % fit:
                open_.setdefault(capacity - (n % fit) * size, []).append([(size,) * (n % fit), 1])
    return [(items, many) for groups in open_.values() for items, many in groups]


def plan_sequences(counts: dict[int, int], capacity: int) -> list[Pattern]:
    fixed, rest = dominance_reduction(counts, capacity)
    return fixed + best_fit_decreasing(rest, capacity)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Every piece with its place: (doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]).

    A text's ids are followed by ``end_id``; only what is longer than ``capacity`` is cut. Null
    and empty texts hold the end id only. Rows with equal or null ids are packed like others, an
    empty table gives no rows, other columns are not read. Only the histogram of lengths, at most
    ``capacity`` rows, reaches the driver; the plan that is sent out has a few thousand patterns.
    """
    pieces = materialize(token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, keep_ids), "pack-pieces")
    by_task = pieces.groupBy("task", "length").count()
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = materialize(by_task.select("task", "length", "count", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first")), "pack-ranks")
    counts = {r["length"]: r["n"] for r in first.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    keys, bases, offsets = [], [], []
    used: Counter[int] = Counter()
    sequence = 0
    for items, many in plan_sequences(counts, capacity):
        at = 0
        for size in items:
            keys.append((size << 44) + used[size])
            bases.append(sequence - used[size])
            offsets.append(at)
            used[size] += many
            at += size
        sequence += many
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    plan = docs.sparkSession.sparkContext.broadcast(tuple(np.array(x, np.int64)[order] for x in (keys, bases, offsets)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, base, offset = plan.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            k = np.searchsorted(key, (length << 44) + rank, "right") - 1
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(base[k] + rank), pa.array(offset[k]), *([batch.column("ids")] if keep_ids else [])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * keep_ids],
            )

    ranked = pieces.join(first.select("task", "length", "first").hint("merge"), ["task", "length"]).withColumn("rank", F.col("first") + F.col("nth"))
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return ranked.mapInArrow(place, schema + ", ids binary" * keep_ids)
