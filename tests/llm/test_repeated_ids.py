"""Decontamination against a benchmark of several blocks, with ids that repeat or are null."""

from collections import Counter

from matloom.llm import decontam

from .helpers import awkward, documents
from .test_text_ops import brute_contamination


def test_blocks_keep_every_row(spark):
    docs = awkward(17)
    # equal ids and equal lengths, but other texts
    docs += [(500, "aa bb cc dd"), (500, "ee ff gg hh"), (None, "aa bb cc ii"), (None, "jj kk ll mm"), (500, "aa bb cc dd")]
    items = [(1, "bb cc"), (2, "ff gg hh"), (3, docs[0][1] or "x"), (None, "kk ll")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontam.find_contamination(documents(spark, docs), bench, block_phrases=1).collect()
    got = Counter((r["doc_id"], r["n_words"], sum(s["to"] - s["from"] for s in r["spans"]), tuple(r["items"]), bool(r["spans"])) for r in found)
    assert got == Counter(brute_contamination(docs, items))
