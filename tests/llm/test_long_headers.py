"""WARC records whose header is very long."""

from matloom.llm import warc


def test_a_very_long_url_comes_back(spark):
    url = "https://example.org/?q=" + "x" * 200_000
    pages = spark.createDataFrame([(1, url, "<p>one</p>"), (2, "https://example.org/2", "<p>two</p>")], "page_id bigint, url string, html string")
    got = {r["url"]: (r["gap"], bytes(r["payload"])) for r in warc.round_trip(pages).collect()}
    assert got == {url: (None, b"<p>one</p>"), "https://example.org/2": (None, b"<p>two</p>")}
