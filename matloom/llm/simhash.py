"""SimHash near-duplicates: fingerprints, BK-tree search inside shards, components.

The distinct fingerprints are dealt to shards by the pigeonhole principle: of five bit blocks at
least one is equal in two fingerprints that differ in at most four bits. Every shard has a
BK-tree (children keyed by the integer Hamming distance to the parent) that is searched along the
edges within the radius only. A tree lies where its shard lies and is not sent to all executors,
since the trees of all documents have no size bound. A shard of more than ``shard_rows``
fingerprints is dealt again, by masks that share out the bits in which its own fingerprints
differ; what is still larger then is cut into chunks, and pairs of chunks are searched as shards of
their own, so no task holds an unbounded group.

Wide fingerprints (near_copies) reach lower similarities: there so many bits may differ that shards
are dealt by samples of the bits, as many as the wanted recall takes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, quoted, release

#: From here on numbers stand for classes whose rows all have a null id (multi_index); never returned.
NO_ID = 1 << 62


def fold_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Majority bit vectors of consecutive runs of 64-bit hashes; a run of none gives zero."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    n = counts[some]
    ends = np.cumsum(n)
    pieces = -(-n // 255)  # a byte lane holds 255 at most
    owner = np.repeat(np.arange(len(n)), pieces)
    first = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    starts = (ends - n)[owner] + 255 * (np.arange(len(owner)) - first[owner])
    lanes = np.empty((len(owner), 8), np.uint64)
    mask = np.uint64(0x0101010101010101)
    for k in range(8):
        lanes[:, k] = np.add.reduceat((hashes >> np.uint64(k)) & mask, starts)
    per = np.add.reduceat(lanes.view(np.uint8).reshape(len(owner), 64).astype(np.int64), first, axis=0)
    majority = per.reshape(-1, 8, 8) * 2 > n[:, None, None]  # run, shift, byte
    shift = np.arange(8)[:, None] + 8 * np.arange(8)[None, :]
    out[some] = (majority.astype(np.uint64) << shift.astype(np.uint64)[None]).sum((1, 2), dtype=np.uint64)
    return out


#: Longer texts are hashed in segments of so many bytes.
SEGMENT = 1 << 22
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _hashes(words: list[bytes], width: int, seed: int) -> list[int]:
    import xxhash

    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-width] + 1).tolist()]
    return list(map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in zip(starts, ends[width - 1 :].tolist())], repeat(seed)))


def shingle_hashes(text: bytes, width: int, seed: int) -> list[int]:
    words = text.lower().split()  # on bytes: A-Z only, and splits at 0x20 and 0x09-0x0D
    return _hashes(words, width, seed) if words else []


def segment_hashes(text: bytes, width: int, seed: int) -> Iterator[list[int]]:
    """shingle_hashes of a long text, a segment of it at a time."""
    begin, held, any_yet = 0, [], False
    while begin < len(text):
        cut = _SPACE.search(text, begin + SEGMENT)
        end = cut.start() if cut else len(text)
        words = held + text[begin:end].lower().split()
        begin = end
        if len(words) >= width:
            yield _hashes(words, width, seed)
            any_yet, words = True, words[len(words) - width + 1 :]
        held = words
    if held and not any_yet:
        yield _hashes(held, width, seed)


def _spread(h: np.ndarray, lane: int) -> np.ndarray:
    """Another 64-bit hash of each hash (the finaliser of splitmix64)."""
    if not lane:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64(lane * 0x9E3779B97F4A7C15 % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def folded(texts: pa.Array, width: int, seed: int, words: int = 1, distinct: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of shingles, and fingerprints (text, word), of a column of texts; distinct: each shingle of a text counts once.

    Hashes are held of a bounded number of texts, and of a bounded part of a long one (of all its
    different ones, where they count once).
    """
    counts, out = np.zeros(len(texts), np.int64), np.zeros((len(texts), words), np.uint64)
    pending: list[int] = []
    first = 0

    def fold(end: int) -> None:
        h = np.array(pending, np.uint64)
        for k in range(words):
            out[first:end, k] = fold_bits(_spread(h, k), counts[first:end])
        pending.clear()

    for i in range(len(texts)):
        text = texts[i].as_py()
        if text and len(text) > SEGMENT:
            fold(i)
            ones = np.zeros((words, 64), np.int64)
            parts = (np.array(part, np.uint64) for part in segment_hashes(text, width, seed))
            if distinct:
                every = np.zeros(0, np.uint64)
                for part in parts:
                    every = np.union1d(every, part)
                parts = [every]
            for h in parts:
                counts[i] += len(h)
                for a in range(0, len(h), 65536):
                    for k in range(words):
                        ones[k] += np.unpackbits(_spread(h[a : a + 65536], k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            out[i] = ((2 * ones > counts[i]).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)
            first = i + 1
            continue
        h = shingle_hashes(text, width, seed) if text else []
        if distinct:
            h = set(h)
        counts[i] = len(h)
        pending.extend(h)
        if len(pending) > 500_000:
            fold(i + 1)
            first = i + 1
    fold(len(texts))
    return counts, out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp BIGINT) per row; null and wordless texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = folded(batch.column(1), width, seed)[1][:, 0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, fp bigint")


class BKForest:
    """BK-trees over bit vectors (one row of 64-bit words each), one for each group, built and searched level by level."""

    def __init__(self, values: np.ndarray, groups: np.ndarray):
        """groups: sorted group number of each value; a group's first value is its root."""
        self.values = values = values if values.ndim == 2 else values[:, None]
        self.edges = 64 * values.shape[1] + 1
        n = len(values)
        parent, key = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        roots = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if n else np.zeros(0, np.int64)
        self.root_of_group = dict(zip(groups[roots].tolist(), roots.tolist()))
        at = np.repeat(roots, np.diff(np.append(roots, n)))
        rest = np.setdiff1d(np.arange(n), roots, assume_unique=True)
        at = at[rest]
        while len(rest):
            d = distances(values[rest], values[at])
            slot = at * self.edges + d
            order = np.argsort(slot, kind="stable")
            lead = np.concatenate([[True], slot[order][1:] != slot[order][:-1]])
            heads = rest[order][lead]  # the first value at each edge becomes the child there
            parent[heads], key[heads] = at[order][lead], d[order][lead]
            below = np.repeat(heads, np.diff(np.append(np.flatnonzero(lead), len(order))))
            rest, at = rest[order][~lead], below[~lead]
        kids = np.flatnonzero(parent >= 0)
        slot = parent[kids] * self.edges + key[kids]
        order = np.argsort(slot, kind="stable")
        self.child, self.slot = kids[order], slot[order]

    def within(self, queries: np.ndarray, start: np.ndarray, radius: int, limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query number, node) pairs within the radius; follows edges d - radius .. d + radius only."""
        queries = queries if queries.ndim == 2 else queries[:, None]
        limit, lap = limit // queries.shape[1], 65536 // queries.shape[1]  # as many bytes at once, however wide
        stack = [(np.arange(len(queries))[i : i + lap], start[i : i + lap]) for i in range(0, len(queries), lap)]
        while stack:
            q, node = stack.pop()
            d = distances(queries[q], self.values[node])
            hit = d <= radius
            if hit.any():
                yield q[hit], node[hit]
            lo = np.searchsorted(self.slot, node * self.edges + np.maximum(d - radius, 0), "left")
            hi = np.searchsorted(self.slot, node * self.edges + np.minimum(d + radius, self.edges - 1), "right")
            n = hi - lo
            some = n > 0
            q, lo, n = q[some], lo[some], n[some]
            cut = np.searchsorted(np.cumsum(n), np.arange(limit, int(n.sum()) + limit, limit)) if len(n) else []
            a = 0
            for b in [min(int(c) + 1, len(n)) for c in cut]:
                if b > a:
                    m = n[a:b]
                    offset = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
                    stack.append((np.repeat(q[a:b], m), self.child[np.repeat(lo[a:b], m) + offset]))
                a = b


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of the rows of two arrays of 64-bit words."""
    out = np.bitwise_count(a[:, 0] ^ b[:, 0]).astype(np.int64)
    for k in range(1, a.shape[1]):
        out += np.bitwise_count(a[:, k] ^ b[:, k])
    return out


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of the sets of a[i] and b[i]; parent holds the least member of each set, fully compressed."""
    while True:
        ra, rb = parent[a], parent[b]
        differ = ra != rb
        if not differ.any():
            return
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def _blocks(n_blocks: int) -> list[tuple[int, int]]:
    edges = [round(i * 64 / n_blocks) for i in range(n_blocks + 1)]
    return list(zip(edges[:-1], edges[1:]))


def block_count(n: int, radius: int, shard_target: int = 4096) -> int:
    """The least number of blocks whose shards are expected to hold few enough of n fingerprints."""
    for blocks in range(radius + 1, 2 * radius + 2):
        if n >> sum(64 // blocks for _ in range(blocks - radius)) <= shard_target:
            return blocks
    return 2 * radius + 1


def _search(radius: int):
    """Stars of the linked parts of each (bucket, i, j); batches: bucket, i, j, probe, rep and the fingerprint's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(t: list[np.ndarray]) -> pa.RecordBatch:
            group = t[2]
            edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
            more = np.repeat(np.diff(edge) > 1, np.diff(edge))  # what is alone has no links
            rep, probe, group, fp = (x[more] for x in t)
            parent = np.arange(len(fp))
            in_tree = np.flatnonzero(probe != 1)
            forest = BKForest(fp[in_tree], group[in_tree])
            seek = np.flatnonzero(probe != 0)
            seek = seek[np.isin(group[seek], group[in_tree])]
            start = np.array([forest.root_of_group[g] for g in group[seek].tolist()], np.int64)
            for q, node in forest.within(fp[seek], start, radius):
                unite(parent, seek[q], in_tree[node])
            moved = np.flatnonzero(parent != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(rep[moved]), pa.array(rep[parent[moved]])], ["a", "b"])

        held: list[list[np.ndarray]] = []
        last, number = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, i, j, probe, rep, *words = (c.to_numpy() for c in batch.columns)
            new = np.concatenate([[(bucket[0], i[0], j[0]) != last], (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            group = number + np.cumsum(new)
            last, number = (bucket[-1], i[-1], j[-1]), int(group[-1])
            held.append([rep, probe, group, np.stack(words, 1).view(np.uint64)])
            if sum(len(h[0]) for h in held) >= 32768:
                t = [np.concatenate(x) for x in zip(*held)]
                whole = int(np.searchsorted(t[2], number))  # the last group may go on
                if whole:
                    yield links([x[:whole] for x in t])
                    t = [x[whole:] for x in t]
                held = [t]
        if held:
            yield links([np.concatenate(x) for x in zip(*held)])

    return run


def _sizes(dealt: DataFrame, shard_rows: int, name: str) -> DataFrame:
    """(bucket, size) of the buckets with more than shard_rows rows."""
    return materialize(dealt.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > shard_rows), name)


def _shard_links(dealt: DataFrame, words: list[str], radius: int, shard_rows: int, hot: DataFrame) -> DataFrame:
    """Edges (a, b) between the rep of rows of a bucket whose words differ in at most radius bits; hot as _sizes gives it."""
    chunks = hot.select("bucket", F.ceil(F.col("size") / shard_rows).cast("int").alias("chunks"))
    cut = dealt.join(chunks, "bucket", "left").withColumn("c", F.expr(f"cast(pmod(xxhash64(1, {', '.join(words)}), coalesce(chunks, 1)) as int)"))
    # of chunks i < j, chunk i makes the tree (probe 0) and chunk j searches it (1); a chunk alone does both (2)
    pairs = F.expr(
        """transform(sequence(0, coalesce(chunks, 1) - 1), k ->
             struct(least(c, k) as i, greatest(c, k) as j, cast(if(k = c, 2, if(c < k, 0, 1)) as tinyint) as probe))"""
    )
    shards = (
        cut.select("bucket", "rep", *words, F.explode(pairs).alias("p"))
        .select("bucket", "p.i", "p.j", "p.probe", "rep", *words)
        .repartition("bucket", "i", "j")
        .sortWithinPartitions("bucket", "i", "j", *words)
    )
    return shards.mapInArrow(_search(radius), "a bigint, b bigint")


def _masks(radius: int):
    """For each (bucket, size, ones of each bit): radius + 1 masks that share out the bits that differ most evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ones = np.stack([c.to_numpy() for c in batch.columns[2:]], 1) / batch.column(1).to_numpy()[:, None]
            order = np.argsort(-np.minimum(ones, 1 - ones), axis=1, kind="stable").astype(np.uint64)
            masks = np.zeros((len(ones), radius + 1), np.uint64)
            for place in range(64):  # dealt to and fro, so that every mask gets its share of the most telling bits
                lap, k = divmod(place, radius + 1)
                masks[:, k if lap % 2 == 0 else radius - k] |= np.uint64(1) << order[:, place]
            lists = pa.ListArray.from_arrays(np.arange(0, masks.size + 1, radius + 1).astype(np.int32), pa.array(masks.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["bucket", "masks"])

    return run


def fingerprint_links(classes: DataFrame, radius: int = 4, shard_rows: int = 1024) -> DataFrame:
    """Edges (a, b) between the representatives of distinct fingerprints ``classes(fp, rep)``.

    The edges connect exactly the fingerprints that the relation "differs in at most radius bits"
    connects; dense shards yield a star for each part and not all their pairs.
    """
    n = classes.count()
    spans = _blocks(block_count(n, radius))
    keys = []
    for k, chosen in enumerate(combinations(spans, len(spans) - radius)):
        parts = [F.expr(f"shiftrightunsigned(fp, {a}) & {(1 << (b - a)) - 1}L") for a, b in chosen]
        keys.append(F.struct(F.xxhash64(F.lit(k), *parts).alias("bucket")) if len(chosen) > 1 else F.struct((parts[0] * len(spans) + k).alias("bucket")))
    dealt = classes.select("fp", "rep", F.explode(F.array(*keys)).alias("x")).select("fp", "rep", "x.bucket")
    hot = _sizes(dealt, shard_rows, "simhash-hot")
    if hot.isEmpty():
        return _shard_links(dealt, ["fp"], radius, shard_rows, hot)
    # two fingerprints of a hot bucket that differ in radius bits at most agree under one of radius + 1 masks
    members = dealt.join(hot.select("bucket"), "bucket")
    ones = members.groupBy("bucket").agg(F.count("*").alias("size"), *(F.sum(F.expr(f"shiftrightunsigned(fp, {b}) & 1L")).alias(f"b{b}") for b in range(64)))
    masks = materialize(ones.mapInArrow(_masks(radius), "bucket bigint, masks array<bigint>"), "simhash-masks")
    again = members.join(masks, "bucket").select("fp", "rep", "bucket", F.posexplode("masks").alias("k", "mask"))
    again = again.select("fp", "rep", F.xxhash64("bucket", "k", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"))
    first = _shard_links(dealt.join(hot.select("bucket"), "bucket", "left_anti"), ["fp"], radius, shard_rows, hot)
    return first.unionByName(_shard_links(again, ["fp"], radius, shard_rows, _sizes(again, shard_rows, "simhash-hotter")))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, seed: int = 42, shard_rows: int = 1024) -> DataFrame:
    """One row per input row: (doc_id, fp BIGINT, component_id).

    component_id is the smallest id that links of at most ``radius`` differing bits reach. Null,
    empty and wordless texts have fingerprint zero and are linked like any others. Rows with a
    null id take part; a component of such rows only has a null component_id. Repeated rows fall
    into one component. An empty table gives no rows; other columns are not read.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, width, seed), "simhash-fp")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    # fingerprints stand for their classes: any id may be a component's least, and null is told from all of them
    edges = materialize(fingerprint_links(classes.select("fp", F.col("fp").alias("rep")), radius, shard_rows), "simhash-links")
    roots = materialize(connected_components(edges), "simhash-roots")
    of = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    of = materialize(of, "simhash-of")
    least = materialize(of.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    of_fp = materialize(of.join(least, "root").select("fp", "component_id"), "simhash-components")
    release(classes, edges, roots, of, least)
    return fps.join(of_fp, "fp", "left").select("doc_id", "fp", "component_id")


# --- wide fingerprints ------------------------------------------------------------------------


def wide_radius(similarity: float, words: int = 4) -> int:
    """Bits in which fingerprints of that similarity, the share of equal bits, may differ.

    A bit differs with probability arccos(c) / pi where c is the cosine of the texts' shingles: a
    share of 0.8 is a cosine of 0.81.
    """
    return int((1 - similarity) * 64 * words + 1e-9)


def sampled_masks(n: int, similarity: float, words: int = 4, recall: float = 0.9, shard_target: int = 128, seed: int = 9) -> np.ndarray:
    """Masks (table, word) of log2(n / shard_target) random bits each.

    There are as many as it takes for two fingerprints of just this similarity to agree under one of
    them with probability ``recall``, and closer ones with a greater one; a single mask without bits
    where n is no more than a shard's target.
    """
    bits = max(0, int(np.ceil(np.log2(max(n, 1) / shard_target))))
    tables = 1 if not bits else int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**bits)))
    rng = np.random.default_rng(seed)
    out = np.zeros((tables, words), np.uint64)
    for t in range(tables):
        for b in rng.choice(64 * words, min(bits, 64 * words), replace=False).tolist():
            out[t, b // 64] |= np.uint64(1) << np.uint64(b % 64)
    return out.view(np.int64)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, words: int = 4, seed: int = 42, shard_rows: int = 1024) -> DataFrame:
    """(doc_id, k1, k2, again) of the rows that are not the first of their group of near copies, and of repeated rows.

    Texts are near copies if their fingerprints of ``words`` 64-bit words over the different shingles
    of ``width`` words, each counted once, agree in ``similarity`` of their bits or more; a group is what such links connect. A
    link of just this similarity is found with the recall of sampled_masks. Texts
    without words (null, empty, blank) are one group. A group's first row is that of the smallest
    doc_id, null ids last, and among equal ids that of the least k1, k2: xxhash64(doc_id, text) and
    xxhash64(text, 1, doc_id) with null texts as empty ones. again: the row is the first itself and
    stands in the table more than once. An empty table gives no rows; no other columns are read.
    """
    names = [f"f{k}" for k in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, fp = folded(batch.column(3), width, seed, words, distinct=True)
            fp = np.ascontiguousarray(fp.T).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n > 0), *(pa.array(f) for f in fp)], ["doc_id", "k1", "k2", "worded", *names])

    text, doc = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")), F.col(quoted(id_col)).cast("bigint")
    slim = docs.select(doc.alias("doc_id"), F.xxhash64(doc, text).alias("k1"), F.xxhash64(text, F.lit(1), doc).alias("k2"), text.cast("binary").alias("text"))
    kinds = ", ".join(f"{f} bigint" for f in names)
    rows = materialize(slim.mapInArrow(run, f"doc_id bigint, k1 bigint, k2 bigint, worded boolean, {kinds}"), "near-rows")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2")
    classes = rows.groupBy("worded", *names).agg(F.count("*").alias("n"), F.min(place).alias("first"))
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "near-classes")
    masks = sampled_masks(classes.count(), similarity, words)
    keys = F.array(*(F.xxhash64(F.lit(t), *(F.col(f).bitwiseAND(int(m)) for f, m in zip(names, mask) if m)) for t, mask in enumerate(masks.tolist())))
    dealt = classes.where("worded").select("rep", *names, F.explode(keys).alias("bucket"))
    edges = _shard_links(dealt, names, wide_radius(similarity, words), shard_rows, _sizes(dealt, shard_rows, "near-hot"))
    edges = materialize(edges, "near-links")
    roots = materialize(connected_components(edges), "near-roots")
    some = classes.join(roots.hint("merge"), F.col("rep") == F.col("node"), "left").where("n > 1 or root is not null")
    some = materialize(some.select("worded", *names, "first", F.coalesce("root", "rep").alias("root")), "near-some")
    firsts = materialize(some.groupBy("root").agg(F.min("first").alias("first")), "near-firsts")
    groups = materialize(some.drop("first").join(firsts.hint("merge"), "root").drop("root"), "near-groups")
    release(classes, edges, roots, some, firsts)
    met = rows.join(groups.hint("merge"), ["worded", *names])
    own = F.expr("doc_id <=> first.doc_id and k1 = first.k1 and k2 = first.k2")
    found = met.groupBy("doc_id", "k1", "k2").agg(F.count("*").alias("n"), F.min(own).alias("again"))
    return found.where("not again or n > 1").select("doc_id", "k1", "k2", "again")
