"""Near copies by wide fingerprints, hot buckets, key filters, against plain Python."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import xxhash

from matloom.llm import common, simhash

from .helpers import documents, words
from .test_text_ops import components


def shingles(text, width=5):
    w = text.lower().split(" ") if text.isascii() and "\n" not in text and "\t" not in text else text.encode().lower().decode().split()
    w = [x for x in w if x]
    return [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []


def mixed(h, lane):
    if not lane:
        return h
    z = (h + lane * 0x9E3779B97F4A7C15) % 2**64
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
    return z ^ z >> 31


def brute_wide(text):
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in set(shingles(text))]
    out = 0
    for lane in range(4):
        each = [mixed(h, lane) for h in hashes]
        for b in range(64):
            if 2 * sum(h >> b & 1 for h in each) > len(each):
                out |= 1 << 64 * lane + b
    return (bool(hashes), out)


def near_texts(texts, similarity=0.8):
    """The relation of two texts that near_copies looks for, with its masks."""
    of = {t: brute_wide(t) for t in set(texts)}
    masks = [sum(int(np.uint64(np.int64(m))) << 64 * k for k, m in enumerate(mask)) for mask in simhash.sampled_masks(len(set(of.values())), similarity).tolist()]
    radius = simhash.wide_radius(similarity)

    def near(a, b):
        (wa, fa), (wb, fb) = of[a], of[b]
        if not wa or not wb:
            return wa == wb
        return (fa ^ fb).bit_count() <= radius and any((fa ^ fb) & m == 0 for m in masks)

    return near


def edited(rng, text, share):
    return " ".join(words(rng, 1) if rng.random() < share else w for w in text.split())


def jaccard(a, b):
    x, y = set(shingles(a)), set(shingles(b))
    return len(x & y) / max(len(x | y), 1)


def survivors(spark, rows, **options):
    gone = Counter((r["doc_id"], r["again"]) for r in simhash.near_copies(documents(spark, rows), **options).collect())
    return gone


def test_pairs_of_high_similarity_are_found_and_of_low_are_not(spark):
    rng = random.Random(21)
    texts, pairs = [], []
    for k in range(400):
        a = words(rng, rng.randint(60, 300))
        b = edited(rng, a, rng.choice([0.005, 0.01, 0.02, 0.1, 0.2]))
        pairs.append((2 * k, 2 * k + 1, jaccard(a, b)))
        texts += [a, b]
    dropped = {r["doc_id"] for r in simhash.near_copies(documents(spark, list(enumerate(texts)))).collect()}
    high = [b for _, b, j in pairs if j >= 0.8]
    low = [b for _, b, j in pairs if j < 0.45]
    found = sum(b in dropped for b in high)
    print(len(high), found, len(low))
    assert len(high) > 100 and len(low) > 100
    assert found >= 0.95 * len(high) and not dropped & set(low) and all(d % 2 for d in dropped)


def test_small_tables_are_exact(spark):
    rng = random.Random(22)
    base = words(rng, 200)
    rows = [(k, edited(rng, base, 0.004 * k)) for k in range(30)] + [(k, words(rng, 5)) for k in range(30, 50)]
    rows += [(60, None), (61, ""), (62, " \n"), (None, base), (None, rows[40][1]), (7, rows[7][1])]
    texts = [t or "" for _, t in rows]
    root = components(texts, near_texts(texts))
    got = survivors(spark, rows)
    order = lambda r: (r[0] is None, r[0] or 0)
    firsts = {}
    for row, r in zip(rows, root):
        firsts[r] = min(firsts.get(r, row), row, key=order)
    wanted = {row[0] for row, r in zip(rows, root) if row[0] is not None and row[0] != firsts[r][0]}
    assert {d for d, again in got if not again and d is not None} == wanted
    assert len(wanted) >= 5 and survivors(spark, []) == Counter()


def test_hot_buckets_send_no_quadratic_rows(spark):
    """A family of fingerprints that agree in 44 bits: every shard of one block or more is hot for some keys."""
    rng = random.Random(23)
    head = rng.getrandbits(44) << 20
    values = list({head | rng.getrandbits(20) for _ in range(3000)}) + [rng.getrandbits(64) for _ in range(200)]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    classes = spark.createDataFrame([(v, k) for k, v in enumerate(signed)], "fp bigint, rep bigint")
    edges = simhash.fingerprint_links(classes, 4, 64)
    got = {k: k for k in range(len(values))}

    def find(a):
        while got[a] != a:
            a = got[a]
        return a

    for r in edges.collect():
        assert (values[r["a"]] ^ values[r["b"]]).bit_count() >= 1
        got[find(r["a"])] = find(r["b"])
    expected = {k: k for k in range(len(values))}

    def root(a):
        while expected[a] != a:
            a = expected[a]
        return a

    v = np.array(values, np.uint64)
    for a in range(len(v)):
        for b in np.flatnonzero(np.bitwise_count(v[a + 1 :] ^ v[a]) <= 4).tolist():
            expected[root(a)] = root(a + 1 + b)
    groups = lambda f: Counter(frozenset(x) for x in _parts(f, len(values)))
    assert groups(find) == groups(root)


def _parts(find, n):
    out = {}
    for k in range(n):
        out.setdefault(find(k), []).append(k)
    return out.values()


def test_wide_trees_find_all_within_radius():
    rng = np.random.default_rng(24)
    x = rng.integers(0, 2**64, (300, 4), dtype=np.uint64)
    x[150:] = x[:150] ^ (rng.random((150, 4)) < 0.5) * (np.uint64(1) << rng.integers(0, 64, (150, 4)).astype(np.uint64))
    forest = simhash.BKForest(x, np.zeros(300, np.int64))
    got = {(int(a), int(b)) for q, node in forest.within(x, np.zeros(300, np.int64), 46) for a, b in zip(q, node)}
    assert got == {(a, b) for a in range(300) for b in range(300) if np.bitwise_count(x[a] ^ x[b]).sum() <= 46}


def test_sift_parts(spark):
    df = spark.range(20_000).selectExpr("id", "xxhash64(id) as k")
    keys = spark.range(0, 20_000, 50).selectExpr("xxhash64(id) as x")
    rest, some = common.sift(df, df["k"], keys, "x")
    a, b = {r["id"] for r in rest.collect()}, {r["id"] for r in some.collect()}
    assert len(a) + len(b) == 20_000 and not a & b and b >= set(range(0, 20_000, 50)) and len(b) < 1400
    tight = common.sift(df, df["k"], keys, "x", most_bits=1 << 16)
    assert tight[0].count() + tight[1].count() == 20_000
    none = common.sift(df, df["k"], keys.limit(0), "x")
    assert (none[0].count(), none[1].count()) == (20_000, 0)


def test_scratch_tables_go(spark):
    import os

    with common.scratch_scope() as kept:
        a, b = (common.materialize(spark.range(3), "scope") for _ in range(2))
        kept.append(b)
    path = lambda df: df._matloom_path.removeprefix("file://")
    assert not os.path.exists(path(a)) and os.path.exists(path(b)) and b.count() == 3
    common.release(b)
    assert not os.path.exists(path(b))


def test_masks_follow_size_and_recall():
    assert simhash.wide_radius(0.8) == 51
    assert simhash.sampled_masks(120, 0.8).shape == (1, 4) and not simhash.sampled_masks(120, 0.8).any()
    small, large = simhash.sampled_masks(10_000, 0.8), simhash.sampled_masks(1_000_000, 0.8)
    assert len(large) > len(small) >= 10
    assert {sum(int(np.uint64(np.int64(m))).bit_count() for m in mask) for mask in small.tolist()} == {7}
    assert all(a != b for a, b in combinations(map(tuple, small.tolist()), 2))
    rng = np.random.default_rng(25)
    bits = rng.random((2000, 256)) < 0.2  # the bits in which pairs of similarity 0.8 differ
    hidden = np.array([[int(m) >> b & 1 for m in mask for b in range(64)] for mask in small.view(np.uint64).tolist()], bool)
    met = (bits.astype(int) @ hidden.T.astype(int) == 0).any(1)
    assert met.mean() > 0.85
