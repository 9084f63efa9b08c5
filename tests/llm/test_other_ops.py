"""Archives, scores, embeddings, HTML and the pipeline: round trips, held-out accuracy and brute force."""

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from matloom.llm import html_extract, multi_index, quality, simhash, toxicity, warc
from matloom.llm import queries as llm
from matloom.llm.common import materialize
from tests.oracle import assert_same, duck

from .helpers import awkward, documents, words

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in llm.queries()] == [f"op{k}" for k in range(1, 11)]


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_matches_sql(spark, name):
    got = llm.queries()[name](spark, MEDIUM).toPandas()
    expected = duck(MEDIUM).sql(llm.oracle_sql()[name]).df()
    if "refers_to" in got:
        got, expected = got.astype({"refers_to": float}), expected.astype({"refers_to": float})
    assert_same(got, expected)


# --- WARC -------------------------------------------------------------------------------------

PAGES = [(5, "http://a", "<p>x</p>"), (2, None, "<p>x</p>"), (9, "http://b\r\nEvil: 1", "<p>x</p>"), (1, "u", None), (3, "u", ""), (4, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n"), (None, "n", "<p>x</p>"), (7, "u", "é" * 70_000), (8, "u", "tail\r\n\r\n"), (8, "u", "tail\r\n\r\n")]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, block string")


def test_warc_round_trip(spark, tmp_path):
    got = warc.round_trip(pages(spark, PAGES), f"file://{tmp_path}/w").collect()
    assert all(r["gap"] is None for r in got)
    least = {}
    for i, _, h in PAGES:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    expected = Counter()
    for i, _, h in PAGES:
        data = (h or "").encode()
        again = i != least[h or ""]
        expected[(i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", least[h or ""] if again else None, None if again else data)] += 1
    number = lambda s: int(s.removeprefix(warc.RECORD_URN)) if s and s != warc.RECORD_URN else None
    assert Counter((number(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], number(r["refers_to"]), None if r["payload"] is None else bytes(r["payload"])) for r in got) == expected
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_small_payloads_are_no_revisits(spark):
    got = warc.round_trip(pages(spark, [(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")]), least_bytes=4)
    assert sorted((r["page_id"], r["record_type"]) for r in got.select(warc.page_of(F.col("record_id")).alias("page_id"), "record_type").collect()) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("warc")
    warc.write_warc(pages(spark, [(i, "u", f"<p>{i}</p>" * (i * 7 + 1)) for i in range(40)]).coalesce(1), f"file://{path}/w")
    (file,) = (p for p in (path / "w").iterdir() if p.name.startswith("part"))
    return file.read_bytes()


def covered(whole, found):
    at = 0
    for x in found:
        if x.start < at:  # several records of one member
            continue
        assert x.start == at
        at = x.end
    assert at == len(whole)


def test_salvage_of_plain_archives(archive):
    clean = list(warc.salvage(archive))
    assert len(clean) == 40 and not any(isinstance(x, warc.Gap) for x in clean)
    rng = np.random.default_rng(0)
    for _ in range(60):
        hurt = rng.choice(40, rng.integers(1, 5), replace=False)
        data = bytearray(archive)
        for k in hurt:
            data[int(rng.integers(clean[k].start, clean[k].end - 4))] ^= 0xFF
        found = list(warc.salvage(bytes(data)))
        covered(data, found)
        ids = {x.headers.get("warc-record-id") for x in found if isinstance(x, warc.Record)}
        assert ids >= {r.headers["warc-record-id"] for k, r in enumerate(clean) if k not in hurt}
    cut = archive[: clean[20].start + 50] + archive[clean[22].end - 20 :]
    found = list(warc.salvage(cut))
    assert sum(isinstance(x, warc.Record) for x in found) == 37 and sum(isinstance(x, warc.Gap) for x in found) == 1


def test_salvage_of_gzip_members(archive):
    clean = list(warc.salvage(archive))
    members = [gzip.compress(archive[r.start : r.end]) for r in clean]
    assert len(list(warc.salvage(b"".join(members)))) == 40
    hurt = b"".join(members[:3] + [members[3][:-9]] + members[4:9] + [b"junk"] + members[9:])
    found = list(warc.salvage(hurt))
    covered(hurt, found)
    assert sum(isinstance(x, warc.Record) for x in found) == 39 and sum(isinstance(x, warc.Gap) for x in found) == 2
    big = gzip.compress(archive * 30)
    assert sum(isinstance(x, warc.Record) for x in warc.salvage(big)) == 1200
    assert [type(x) for x in warc.salvage(big[:-1])] == [warc.Gap]
    assert [(type(x), x.start, x.end) for x in warc.salvage(big + b"junk")][-2:] == [(warc.Record, 0, len(big)), (warc.Gap, len(big), len(big) + 4)]
    assert list(warc.salvage(b"")) == []


def test_a_large_member_is_not_held(archive):
    import tracemalloc

    one = gzip.compress(archive * 400)
    tracemalloc.start()
    assert sum(1 for _ in warc.salvage(one)) == 16_000
    assert tracemalloc.get_traced_memory()[1] < len(archive) * 400 / 5 > 4 << 20
    tracemalloc.stop()


def test_files_are_cut(spark, tmp_path):
    rows = [(i, "u", f"{i:05d}" * 100) for i in range(100)]
    warc.write_warc(pages(spark, rows).coalesce(1), f"file://{tmp_path}/w", file_bytes=20_000)
    sizes = [p.stat().st_size for p in (tmp_path / "w").glob("part*")]
    assert len(sizes) > 4 and max(sizes) < 40_000 and warc.read_warc(spark, f"file://{tmp_path}/w").where("gap is null").count() == 100


def test_too_large_archives_are_gaps(spark, archive, tmp_path):
    (tmp_path / "a.warc").write_bytes(archive)
    (tmp_path / "b.warc").write_bytes(archive * 2)
    got = warc.read_warc(spark, f"file://{tmp_path}", most_bytes=len(archive)).collect()
    large = [r for r in got if r["gap"] == "archive too large"]
    assert [(r["file"].rpartition("/")[2], r["start"], r["end"], r["payload"]) for r in large] == [("b.warc", 0, 2 * len(archive), None)]
    assert sum(r["gap"] is None for r in got) == 40


def test_gaps_are_logged(spark, archive, tmp_path):
    (tmp_path / "a.warc").write_bytes(archive[:1000] + b"\0" * 30 + archive[1030:])
    (tmp_path / "b.warc").write_bytes(b"nothing at all")
    got = warc.read_warc(spark, f"file://{tmp_path}").where("gap is not null").collect()
    assert {r["file"].rpartition("/")[2] for r in got} == {"a.warc", "b.warc"} and all(r["end"] > r["start"] and r["payload"] is None for r in got)


# --- scores -----------------------------------------------------------------------------------


def ranked(score, label):
    order = np.argsort(np.argsort(score)) + 1.0
    for v in np.unique(score):
        order[score == v] = order[score == v].mean()
    p = label.sum()
    return (order[label == 1].sum() - p * (p + 1) / 2) / (p * (len(label) - p))


@pytest.mark.parametrize("name,column,mod,held,least", [("op6_toxicity", "toxic", 4, 2, 0.75), ("op7_quality", "quality", 5, 0, 0.95)])
def test_held_out_accuracy(spark, name, column, mod, held, least):
    got = llm.queries()[name](spark, MEDIUM).toPandas()
    assert len(got) == 1000 and got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3)).all()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % mod == held)).all()
    met = got[got["held_out"]].merge(spark.read.parquet(f"{MEDIUM}/labels.parquet").toPandas(), on="doc_id")
    assert ranked(met["score"].to_numpy(), met[column].to_numpy()) > least


def test_held_out_labels_change_nothing(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    wrong = lambda mod, held: F.expr(f"crc32(cast(doc_id as string)) % {mod} = {held}")
    a = quality.fit_quality(docs, labels)
    b = quality.fit_quality(docs, labels.withColumn("quality", F.when(wrong(5, 0), 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert a == b
    c = toxicity.fit_toxicity(docs, labels)
    d = toxicity.fit_toxicity(docs, labels.withColumn("toxic", F.when(wrong(4, 2), 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert c == d


def test_scores_of_awkward_rows(spark):
    docs = documents(spark, awkward(11))
    labels = spark.createDataFrame([(i, None if i == 3 else i % 2, i % 3 // 2) for i in range(60)] + [(None, 1, 1), (4, 1, 0), (999, 0, 1)], "doc_id bigint, quality int, toxic int")
    a = quality.score_quality(docs, quality.fit_quality(docs, labels)).collect()
    b = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()
    assert len(a) == len(b) == docs.count() and all(0 <= r["score"] <= 1 for r in a + b)
    none = documents(spark, [])
    assert quality.score_quality(none, quality.fit_quality(none, labels.limit(0))).count() == 0
    assert toxicity.score_toxicity(none, toxicity.fit_toxicity(none, labels.limit(0))).count() == 0


def test_compiled_rules_equal_numpy(spark):
    docs = documents(spark, [r for r in awkward(12) if r[0] is not None])
    rows = quality.with_statistics(docs, "text", "").toPandas()
    x = rows[list(quality.STATISTICS)].to_numpy(float)
    y = (x[:, 0] > np.median(x[:, 0])).astype(int)
    model = quality.fit_rules(x, y, list(quality.STATISTICS))
    assert 0 < len(model.rules) and all(1 <= len(r) <= 3 for r, _ in model.rules)
    total = np.full(len(x), model.bias)
    for rule, w in model.rules:
        total += w * quality._holds(x, [(quality.STATISTICS.index(n), low, cut) for n, low, cut in rule])
    got = quality.score_quality(docs, model).toPandas()
    assert np.allclose(np.sort(got["score"]), np.sort(1 / (1 + np.exp(-total))))


def test_accepted_rows_are_those_of_the_score(spark):
    docs = documents(spark, awkward(16))
    model = quality.RuleModel([((("log_chars", True, 5.0),), 1.0), ((("distinct_words", False, 0.9), ("pipes", True, 0.1)), -2.0)], 0.2)
    low = quality.score_quality(docs.drop("score"), model).where("score < 0.5").count()
    kept = quality.accepted(docs, model, 0.5)
    assert 0 < low < docs.count() and kept.count() == docs.count() - low and kept.columns == docs.columns
    assert {r["score"] for r in kept.select("score").collect()} == {"y"}
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in next(x for x in plan.splitlines() if "Filter" in x)


def test_nnpu_beats_plain_positive_against_unlabelled():
    rng = np.random.default_rng(1)
    word = lambda n: {f"w{k}" for k in rng.integers(0, 400, n)}
    bad = [word(30) | {f"bad{rng.integers(3)}"} for _ in range(150)]
    mixed = [word(30) | ({f"bad{rng.integers(3)}"} if rng.random() < 0.3 else set()) for _ in range(500)]
    model = toxicity.nnpu_fit(bad, mixed, 0.3)
    score = lambda s: model.bias + sum(sum(model.weights.get(f, 0) for f in toxicity.features_of(w)) for w in s)
    new_bad, new_clean = [score(word(30) | {"bad1"}) for _ in range(100)], [score(word(30)) for _ in range(100)]
    assert np.mean(np.array(new_bad) > 0) > 0.95 and np.mean(np.array(new_clean) < 0) > 0.95


# --- embeddings -------------------------------------------------------------------------------


def brute_links(rows, threshold=0.9):
    good = {}
    for k, (i, v) in enumerate(rows):
        if v and not any(c is None or not np.isfinite(c) for c in v) and any(v) and len(v) == 16:
            x = np.array(v, float)
            good[k] = x / np.linalg.norm(x)
    keys = list(good)
    s = np.array([good[k] for k in keys]) @ np.array([good[k] for k in keys]).T >= threshold
    root = {k: k for k in range(len(rows))}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    n = {k: 0 for k in range(len(rows))}
    for a, k in enumerate(keys):
        for b, j in enumerate(keys):
            if a != b and s[a, b]:
                n[k] += 1
                root[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, n[k], least.get(find(k))) for k, (i, _) in enumerate(rows))


def vectors(seed, n):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16))
    x[n // 2 :] = x[rng.integers(0, n // 8, n - n // 2)] + rng.normal(size=(n - n // 2, 16)) * rng.choice([0, 0.05, 0.3], (n - n // 2, 1))
    rows = [(i, [float(np.float32(c)) for c in r]) for i, r in enumerate(x)]
    odd = [(9001, None), (9002, []), (9003, [0.0] * 16), (9004, [float("nan")] + [1.0] * 15), (9005, [1.0, None] + [1.0] * 14), (9006, [float("inf")] * 16), (9007, [1.0] * 4), (None, rows[0][1]), (3, rows[3][1])]
    return rows + odd


def test_multi_index_small(spark):
    rows = vectors(1, 300)
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<float>, h int")
    got = multi_index.embedding_links(df, block_rows=16)
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect()) == brute_links(rows)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got.collect())
    assert multi_index.embedding_links(df.limit(0)).count() == 0


def test_multi_index_recall(spark, monkeypatch):
    fit = multi_index.fit_index
    monkeypatch.setattr(multi_index, "fit_index", lambda *a, **k: fit(*a, **k, list_size=8))  # a fine grid
    rows = vectors(2, 1500)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {r["vec_id"]: r["n_links"] for r in multi_index.embedding_links(df, block_rows=64).collect()}
    exact = {i: n for i, n, _ in brute_links(rows)}
    assert all(got[i] <= exact[i] for i in exact if i not in (None, 3))
    assert sum(v for k, v in got.items()) >= 0.95 * sum(exact.values())


def test_traversal_order_is_by_distance():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 8))
    index = multi_index.fit_index(x / np.linalg.norm(x, axis=1)[:, None], 200 * 256, 0.9, list_size=256)
    index.margin = 0.4
    p, q = index.costs(x[:5])
    for a, b in zip(p, q):
        cells = index.traverse(a, b)
        cost = (a[:, None] + b[None]).ravel()
        assert sorted(cells) == np.flatnonzero(cost <= cost.min() + 0.4 + 1e-15).tolist()
        assert np.all(np.diff(cost[cells]) >= 0)


# --- HTML -------------------------------------------------------------------------------------


def labelled_text(page):
    nodes = html_extract.parse(page)
    marks = [html_extract._MARK.search(n.attributes) for n in nodes]
    kept = np.array([(m is None and n.tag in ("", "html", "body")) or (m is not None and m[1] == "1") for n, m in zip(nodes, marks)])
    return "\n".join(html_extract.blocks(nodes, kept))


def test_extraction_of_unseen_made_pages():
    same = 0
    for k in range(120):
        page = html_extract.made_page(77_000_000 + k)
        same += html_extract.extract(re.sub(r' data-k="[01]"', "", page)) == labelled_text(page)
    assert same >= 110


def test_extraction_by_hand():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><header><a href=/>Site</a><p>A slogan.</p></header>
    <nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav><div class="cookie-notice">We use cookies, as all do.</div>
    <article><h1>Big &amp; bold</h1><p>First   line
    goes <b>on</b>&nbsp;here, and on, and on. It has a second sentence.</p><p>Second &lt;tag&gt; paragraph, which is as long as the first one, or more.
    <div class="ad">Buy now!</div><script>var x = "<p>no</p>";</script><p>Third paragraph, with an <a href=x>anchor</a> inside of it, ends here.</article>
    <section class="comments"><h3>Comments</h3><div class="comment"><p>I read this article twice, and still I do not agree with it.</p></div></section>
    <aside class="sidebar"><p>Related things that nobody reads.</p></aside><form><label>Mail</label><input name=q><button>Send</button></form><footer>&copy; me</footer></body></html>"""
    assert html_extract.extract(page) == "Big & bold\nFirst line goes on here, and on, and on. It has a second sentence.\nSecond <tag> paragraph, which is as long as the first one, or more.\nThird paragraph, with an anchor inside of it, ends here."


def test_extraction_of_given_pages(spark):
    from html import unescape

    def reference(page):
        x = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", page, re.S)[1]
        x = re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", re.sub(r"</?(p|h1)>", "\n", x)))
        return "\n".join(y for y in (re.sub(r"\s+", " ", unescape(s)).strip() for s in x.split("\n")) if y)

    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{MEDIUM}/pages.parquet").collect()}
    got = llm.op9_html_extraction(spark, MEDIUM).collect()
    assert len(got) == len(html) and all(r["text"] == reference(html[r["page_id"]]) and r["n_chars"] == len(r["text"]) for r in got)


def test_labels_agree_along_the_tree():
    rng = np.random.default_rng(2)
    for k in range(20):
        nodes = html_extract.parse(html_extract.made_page(k))
        kept = html_extract.decode(nodes, rng.normal(size=len(nodes)) * 3)
        assert all(kept[n.parent] for n, y in zip(nodes, kept) if y and n.parent >= 0)


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!--", "plain text, no tags", "<p>" * 3000 + "x", "</div></div>", "<script>never ends", "&#0;&bogus;&#x110000;", "<div class=>" * 500])
def test_broken_pages(spark, page):
    rows = spark.createDataFrame([(1, "u", page, "c"), (None, None, page, "c")], "page_id bigint, url string, html string, text string")
    got = html_extract.main_text(rows).collect()
    assert len(got) == 2 and all(r["n_chars"] == len(r["text"]) for r in got)


# --- pipeline ---------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = docs.columns
    sizes = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = materialize(stage(spark, docs, SMALL), "test")
        if k < 4:
            assert out.columns == names and {r[0] for r in out.select("doc_id").collect()} <= {r[0] for r in docs.select("doc_id").collect()}
            sizes.append(out.count())
            docs = out
    assert sizes == sorted(sizes, reverse=True) and sizes[3] > 100
    kept = {r[0] for r in docs.select("doc_id").collect()}
    assert {r["doc_id"] for r in out.collect()} == kept
    ran = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(repr, ran.select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(repr, out.select("doc_id", "piece", "ids_crc32").collect()))


def test_pipeline_stages_by_brute_force(spark):
    from .test_near_copies import near_texts
    from .test_text_ops import brute_contamination, brute_lines, components

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows += [(i + 10_000, t) for i, t in awkward(13) if i is not None and i >= 100]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, docs, SMALL).collect()}
    assert got == {d: t for d, t, n, gone in brute_lines(rows) if n == 0 or gone < n}
    rows = [(i, t) for i, t in got.items()]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs.schema)
    root = components([t or "" for _, t in rows], near_texts([t or "" for _, t in rows]))
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min(i, least.get(r, i))
    assert {r["doc_id"] for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, SMALL).collect()} == set(least.values())
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = {d for d, _, _, _, hit in brute_contamination(rows, items) if not hit}
    assert {r["doc_id"] for r in corpus_pipeline.drop_contaminated(spark, docs, SMALL).collect()} == clean


def test_one_row_of_each_group_stays_when_ids_repeat(spark):
    from .test_near_copies import near_texts
    from .test_text_ops import components

    rows = awkward(15) + [(3, "another text with the id of three " * 3), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, SMALL).collect()]
    root = components([t or "" for _, t in rows], near_texts([t or "" for _, t in rows]))
    group = {row: r for row, r in zip(rows, root)}
    assert sorted(group[k] for k in kept) == sorted(set(root))


def test_every_group_keeps_one_row_when_one_id_is_null(spark):
    from .test_near_copies import near_texts
    from .test_text_ops import components

    rng = random.Random(16)
    texts = [words(rng, 40) for _ in range(400)]
    rows = [(2 * k + copy, t) for k, t in enumerate(texts) for copy in (0, 1)] + [(None, "one row without an id")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = Counter(r["text"] for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, SMALL).collect())
    group = dict(zip([t for _, t in rows], components([t for _, t in rows], near_texts([t for _, t in rows]))))
    assert sorted(group[t] for t in kept.elements()) == sorted(set(group.values()))


def test_components_of_the_largest_ids(spark):
    big = (1 << 63) - 1
    rows = [(big, "a b c d e"), (big - 1, "a b c d e"), (None, "f g h i j"), (-big, "k l m n o")]
    got = {(r["doc_id"], r["component_id"]) for r in simhash.simhash_components(documents(spark, rows)).collect()}
    assert got == {(big, big - 1), (big - 1, big - 1), (None, None), (-big, -big)}


def test_pipeline_stages_on_awkward_tables(spark):
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for rows in (awkward(14), []):
        docs = spark.createDataFrame([(i, t, None, None, len(t or "")) for i, t in rows], columns)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = materialize(stage(spark, docs, SMALL), "test")
            assert k == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert bool(rows) == bool(docs.count())


#: Names that the stages use, or used, themselves.
CLASHING = "k1 k2 spans n_lines n_removed _key key score h text_ kept row again hit d j1 nth items n_words log_chars _row".split()


@pytest.mark.parametrize("k", range(4))
def test_pipeline_stages_leave_clashing_columns_alone(spark, k):
    rows = awkward(18) + [(3, "the id of three again " * 4)]
    plain = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    stage = corpus_pipeline.STAGES[k][1]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    bare = stage(spark, spark.createDataFrame(docs, plain), SMALL).collect()
    more = [(*d, *(f"{c}-{n}" for c in CLASHING)) for n, d in enumerate(docs)]
    out = stage(spark, spark.createDataFrame(more, ", ".join([plain, *(f"`{c}` string" for c in CLASHING)])), SMALL)
    assert out.columns == [*"doc_id text lang source n_chars".split(), *CLASHING]
    got = out.collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(tuple(r) for r in bare)
    source = {tuple(m[5:]): m for m in more}
    assert all(tuple(r)[5:] in source and source[tuple(r)[5:]][0] == r["doc_id"] for r in got)
    assert len({tuple(r)[5:] for r in got}) == len(got)


def test_a_row_without_id_changes_no_survivor(spark):
    rng = random.Random(19)
    texts = [words(rng, 30) for _ in range(12)]
    rows = [(10 * g + c, t) for g, t in enumerate(texts) for c in range(3)]
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    kept = []
    for extra in ([], [(None, "a text unlike all others")]):
        docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows + extra], columns)
        kept.append({r["doc_id"] for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, SMALL).collect()})
    assert kept[0] == {10 * g for g in range(12)} and kept[1] == kept[0] | {None}
