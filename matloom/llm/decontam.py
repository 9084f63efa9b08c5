"""Benchmark decontamination with a distributed positional inverted index.

The index is sharded by documents: a shard holds, for every test term, the sorted list of its
positions in the shard's token stream, as in distributed search engines. It is written to the
shared folder and searched shard by shard. Phrases are kept by the rarest of their terms in the
whole index, so that a shard looks only at those whose rarest term it holds; from that list on it
intersects the lists of the next rarer terms, adjusted by their offsets. No posting is ever
shuffled, and a frequent word, passage or document lengthens only the lists of the shards that
hold it. Documents are indexed once for all phrases that a bounded vocabulary makes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release

#: Every byte but a-z, 0-9 and those of non-ASCII characters separates words; A-Z become a-z.
_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

INDEX_SCHEMA = "doc_ids array<bigint>, n_words array<int>, terms array<int>, sizes array<int>, positions binary"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


@dataclass
class Items:
    """Test items as numbers of a vocabulary; item k has the tokens [starts[k], starts[k + 1])."""

    vocabulary: dict[bytes, int]
    tokens: np.ndarray
    starts: np.ndarray
    ids: list[int | None]

    def window_counts(self, window: int) -> np.ndarray:
        n = np.diff(self.starts)
        return np.where(n > 0, np.maximum(n - window + 1, 1), 0)


@dataclass
class Phrases:
    """Distinct phrases of term numbers by their rarest term, and the items that hold each."""

    terms: np.ndarray  # (phrase, place), -1 beyond a phrase's end
    order: np.ndarray  # (phrase, place): its places from the rarest term on
    lengths: np.ndarray
    lead: np.ndarray  # the rarest term of each phrase, in order
    item_of: np.ndarray  # item ids, by phrase
    item_from: np.ndarray


def read_items(benchmark: DataFrame, id_col: str, text_col: str, block_terms: int, block_tokens: int) -> Iterator[Items]:
    """The test set in blocks of bounded vocabulary and tokens; one block without items if there are none."""
    rows = benchmark.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("binary"))
    vocabulary: dict[bytes, int] = {}
    tokens, ids, held, any_yet = [], [], 0, False
    block = lambda: Items(vocabulary, np.concatenate([np.zeros(0, np.int32), *tokens]), np.cumsum([0, *map(len, tokens)]), ids)
    for item_id, text in rows.toLocalIterator():
        words = words_of(bytes(text) if text is not None else None)
        tokens.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int32, len(words)))
        ids.append(item_id)
        held += len(words)
        if len(vocabulary) >= block_terms or held >= block_tokens:
            yield block()
            vocabulary, tokens, ids, held, any_yet = {}, [], [], 0, True
    if ids or not any_yet:
        yield block()


def phrases_of(items: Items, window: int, counts: np.ndarray, begin: int = 0, end: int | None = None) -> Phrases:
    """The phrases of the windows [begin, end) of all items; counts: how often each term is in the index."""
    many = items.window_counts(window)
    first = np.cumsum(many) - many
    number = np.arange(begin, int(many.sum()) if end is None else end)
    owner = np.searchsorted(first + many, number, "right")
    start = items.starts[owner] + number - first[owner]
    length = np.minimum(items.starts[owner + 1] - start, window)
    place = np.arange(window)[None]
    at = np.minimum(start[:, None] + place, max(len(items.tokens) - 1, 0))
    terms = np.where(place < length[:, None], items.tokens[at] if len(items.tokens) else -1, -1).astype(np.int32).reshape(len(number), window)
    rows = np.ascontiguousarray(terms).view(np.dtype((np.void, 4 * window))).ravel()
    _, which, phrase = np.unique(rows, return_index=True, return_inverse=True)
    terms, length = terms[which], length[which]
    often = np.where(terms >= 0, counts[np.maximum(terms, 0)] if len(counts) else 0, np.iinfo(np.int64).max)
    order = np.argsort(often, axis=1, kind="stable").astype(np.int8)
    lead = np.take_along_axis(terms, order[:, :1].astype(np.int64), 1)[:, 0] if len(terms) else np.zeros(0, np.int32)
    by_lead = np.argsort(lead, kind="stable")
    new = np.empty(len(lead), np.int64)
    new[by_lead] = np.arange(len(lead))
    named = np.array([i is not None for i in items.ids], bool)[owner] if len(owner) else np.zeros(0, bool)
    pairs = np.unique(new[phrase[named]] * max(len(items.ids), 1) + owner[named])
    holders, who = np.divmod(pairs, max(len(items.ids), 1))
    ids = np.array([0 if i is None else i for i in items.ids], np.int64)
    return Phrases(terms[by_lead], order[by_lead], length[by_lead], lead[by_lead], ids[who] if len(who) else np.zeros(0, np.int64), np.searchsorted(holders, np.arange(len(lead) + 1)))


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text", shard_words: int = 400_000) -> DataFrame:
    """Postings of the vocabulary's terms in whole texts, a row per shard of at least one document.

    positions: the lists end to end in the order of terms, as differences of little-endian int32.
    Position p of document k is p + k + the words before k: a free place lies between documents.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        kind = np.int16 if len(number) < 32_000 else np.int32
        ids: list[int | None] = []
        parts: list[np.ndarray] = []
        held = 0

        def shard() -> pa.RecordBatch:
            stream = np.concatenate([x for p in parts for x in (p, np.array([-1], kind))])
            order = np.argsort(stream, kind="stable")
            order = order[np.searchsorted(stream[order], 0) :]
            terms, sizes = np.unique(stream[order], return_counts=True)
            arrays = [ids, [len(p) for p in parts], terms.tolist(), sizes.tolist(), np.diff(order, prepend=0).astype("<i4").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(arrays, (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()))], names)

        names = ["doc_ids", "n_words", "terms", "sizes", "positions"]
        for batch in batches:
            texts = batch.column(1)
            for k, doc in enumerate(batch.column(0).to_pylist()):
                words = words_of(texts[k].as_py())
                ids.append(doc)
                parts.append(np.fromiter(map(number.get, words, repeat(-1)), kind, len(words)))
                held += len(words) + 1
                if held >= shard_words:
                    yield shard()
                    ids, parts, held = [], [], 0
        if ids:
            yield shard()

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, INDEX_SCHEMA)


class Shard:
    """One row of the index: the lists of its terms, one after another."""

    def __init__(self, n_words: np.ndarray, terms: np.ndarray, sizes: np.ndarray, positions: bytes):
        self.n_words = n_words.astype(np.int64)
        self.doc_from = np.concatenate([[0], np.cumsum(self.n_words + 1)])
        self.stride = int(self.doc_from[-1]) + 1
        self.terms, self.sizes = terms, sizes
        self.start = np.cumsum(sizes) - sizes
        self.flat = np.cumsum(np.frombuffer(positions, "<i4").astype(np.int64))
        # all lists as one sorted list of (place among the shard's terms, position)
        self.keys = np.repeat(np.arange(len(terms)) * self.stride, sizes) + self.flat

    def slots(self, terms: np.ndarray) -> np.ndarray:
        """Places of terms among those of the shard, -1 for what it does not hold."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def postings(self, term: int) -> np.ndarray:
        slot = int(self.slots(np.array([term]))[0])
        return self.flat[self.start[slot] : self.start[slot] + self.sizes[slot]] if slot >= 0 else np.zeros(0, np.int64)

    def phrase_matches(self, phrases: Phrases, limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(phrase, position) of every exact occurrence, in pieces of bounded size."""
        lo, hi = np.searchsorted(phrases.lead, self.terms, "left"), np.searchsorted(phrases.lead, self.terms, "right")
        many = hi - lo
        alive = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(int(many.sum()))  # those whose rarest term is here
        slot = np.repeat(np.arange(len(self.terms)), many)
        for k in range(1, phrases.terms.shape[1]):  # of which all others have to be here, too
            term = phrases.terms[alive, phrases.order[alive, k]]
            ok = (term < 0) | (self.slots(term) >= 0)
            alive, slot = alive[ok], slot[ok]
        total = np.cumsum(self.sizes[slot])
        a = 0
        while a < len(alive):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + limit, "right")))
            some, n = alive[a:b], self.sizes[slot[a:b]]
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            at = self.flat[np.repeat(self.start[slot[a:b]], n) + inside] - np.repeat(phrases.order[some, 0].astype(np.int64), n)
            which, a = np.repeat(some, n), b
            ok = at >= 0
            which, at = which[ok], at[ok]
            for k in range(1, phrases.terms.shape[1]):  # the next rarer list, adjusted by its offset
                place = phrases.order[which, k].astype(np.int64)
                term = phrases.terms[which, place]
                wanted = self.slots(term) * self.stride + at + place
                found = np.searchsorted(self.keys, wanted)
                ok = (term < 0) | ((at + place < self.stride) & (self.keys[np.minimum(found, len(self.keys) - 1)] == wanted))
                which, at = which[ok], at[ok]
            if len(which):
                yield which, at

    def proximity_matches(self, terms: list[int], within: int) -> list[tuple[int, int]]:
        """(document number, word offset of the rarest term) where all terms lie within so many words of it."""
        terms = sorted(set(terms), key=lambda t: len(self.postings(t)))
        at = self.postings(terms[0])
        doc = np.searchsorted(self.doc_from, at, "right") - 1
        for t in terms[1:]:
            other = self.postings(t)
            lo = np.maximum(at - within, self.doc_from[doc])
            hi = np.minimum(at + within, self.doc_from[doc + 1] - 1)
            ok = np.searchsorted(other, hi, "right") > np.searchsorted(other, lo, "left")
            at, doc = at[ok], doc[ok]
        return list(zip(doc.tolist(), (at - self.doc_from[doc]).tolist()))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, Shard]]:
    for batch in batches:
        for k in range(batch.num_rows):
            ids, n_words, terms, sizes, positions = (batch.column(c)[k].as_py() for c in range(5))
            yield ids, Shard(np.array(n_words, np.int64), np.array(terms, np.int64), np.array(sizes, np.int64), positions)


def term_counts(index: DataFrame, n_terms: int) -> np.ndarray:
    """How often each term is in the whole index; a row per test term reaches the driver."""
    each = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).groupBy("x.terms").agg(F.sum("x.sizes").alias("n")).toArrow()
    out = np.zeros(n_terms, np.int64)
    out[each.column(0).to_numpy()] = each.column(1).to_numpy()
    return out


def search_phrases(index: DataFrame, phrases: Phrases, hits_only: bool = False) -> DataFrame:
    """Per indexed document: (doc_id, n_words, spans, items); spans are merged word ranges [from, to)."""
    sent = index.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for ids, shard in _shards(batches):
            step = np.zeros(shard.stride + 1, np.int32)
            owners: list[np.ndarray] = []
            for which, at in shard.phrase_matches(p):
                np.add.at(step, at, 1)
                np.add.at(step, at + p.lengths[which], -1)
                owners.append(np.unique((np.searchsorted(shard.doc_from, at, "right") - 1) * len(p.lengths) + which))
            covered = np.concatenate([[0], (np.cumsum(step[:-1]) > 0).view(np.int8), [0]])
            edge = np.diff(covered)
            begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            doc = np.searchsorted(shard.doc_from, begins, "right") - 1
            spans: dict[int, list] = {}
            for d, x, y in zip(doc.tolist(), (begins - shard.doc_from[doc]).tolist(), (ends - shard.doc_from[doc]).tolist()):
                spans.setdefault(d, []).append((x, y))
            items: dict[int, set] = {}
            for o in np.unique(np.concatenate(owners)).tolist() if owners else []:
                d, w = divmod(o, len(p.lengths))
                items.setdefault(d, set()).update(p.item_of[p.item_from[w] : p.item_from[w + 1]].tolist())
            rows = sorted(spans) if hits_only else range(len(ids))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": [ids[k] for k in rows], "n_words": [int(shard.n_words[k]) for k in rows], "spans": [[{"from": x, "to": y} for x, y in spans.get(k, [])] for k in rows], "items": [sorted(items.get(k, ())) for k in rows]},
                schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), ("items", pa.list_(pa.int64()))]),
            )

    return index.mapInArrow(run, "doc_id bigint, n_words bigint, spans array<struct<from: bigint, to: bigint>>, items array<bigint>")


def search_proximity(index: DataFrame, vocabulary: dict[bytes, int], terms: list[bytes], within: int) -> DataFrame:
    """(doc_id, at): where all terms lie within so many words of the shard's rarest of them, in any order."""
    wanted = [vocabulary[t] for t in terms]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, shard in _shards(batches):
            found = shard.proximity_matches(wanted, within)
            yield pa.RecordBatch.from_pydict({"doc_id": [ids[d] for d, _ in found], "at": [x for _, x in found]}, schema=pa.schema([("doc_id", pa.int64()), ("at", pa.int64())]))

    return index.mapInArrow(run, "doc_id bigint, at bigint")


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    block_phrases: int = 500_000, block_terms: int = 500_000, block_tokens: int = 32_000_000,
) -> DataFrame:
    """One row per document: (doc_id, n_words, spans, items) of the windows of test items in it.

    Windows are runs of ``window`` words of an item; an item of fewer words, but not none, is one
    window. Null and empty texts have no words. Items with a null id are searched, but not listed.
    Repeated document rows give repeated rows; an empty table gives none, an empty benchmark no
    hits. Columns other than the named ones are not read, so any others may be there.

    Memory does not follow the benchmark: documents are indexed for at most ``block_terms`` test
    terms, of ``block_tokens`` test tokens, at a time, and an index is searched for at most
    ``block_phrases`` windows at a time. Where there is more than one such block, rows are first
    written with a number of their own, by which what the blocks find is put together.
    """
    blocks = read_items(benchmark, item_col, item_text_col, block_terms, block_tokens)
    items = next(blocks)
    later = next(blocks, None)
    if later is None and int(items.window_counts(window).sum()) <= block_phrases:
        index = materialize(build_index(docs, items.vocabulary, id_col, text_col), "decontam-index")
        return search_phrases(index, phrases_of(items, window, term_counts(index, len(items.vocabulary))))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, "decontam-rows")
    hits: list[DataFrame] = []
    base = None
    for items in (x for x in chain([items, later], blocks) if x is not None):
        index = materialize(build_index(rows, items.vocabulary, "row", "text"), "decontam-index")
        counts, total = term_counts(index, len(items.vocabulary)), int(items.window_counts(window).sum())
        for a in range(0, total, block_phrases):
            found = search_phrases(index, phrases_of(items, window, counts, a, min(a + block_phrases, total)), hits_only=True)
            hits.append(materialize(found.withColumnRenamed("doc_id", "row"), "decontam-hits"))
        if base is None:
            each = index.select(F.explode(F.arrays_zip("doc_ids", "n_words")).alias("x"))
            base = materialize(each.select(F.col("x.doc_ids").alias("row"), F.col("x.n_words").cast("bigint").alias("n_words")), "decontam-words")
        release(index)
    named = base.join(rows.select("row", "doc_id").hint("merge"), "row").join(_merged(hits).hint("merge"), "row", "left")
    nothing = {c: F.expr(f"cast(array() as {hits[0].schema[c].dataType.simpleString()})") for c in ("spans", "items")}
    return named.select("doc_id", "n_words", *(F.coalesce(c, nothing[c]).alias(c) for c in ("spans", "items")))


def _merged(hits: list[DataFrame]) -> DataFrame:
    """(row, spans, items) of all blocks: a span begins where no earlier one of its row reaches."""
    every = hits[0]
    for f in hits[1:]:
        every = every.unionByName(f)
    each = every.select("row", F.explode("spans").alias("s")).select("row", F.col("s.from").alias("a"), F.col("s.to").alias("b"))
    before = Window.partitionBy("row").orderBy("a", "b")
    reach = each.withColumn("new", F.coalesce(F.col("a") > F.max("b").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
    runs = reach.withColumn("run", F.sum(F.col("new").cast("int")).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    joined = runs.groupBy("row", "run").agg(F.struct(F.min("a").alias("from"), F.max("b").alias("to")).alias("s")).groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    lists = every.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return joined.join(lists, "row")
