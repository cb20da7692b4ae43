import pytest
from pyspark.sql import functions as F

from tarnweave import session
from tarnweave.operators import merge
from tarnweave.plans import pipeline
from tarnweave.plans.crawl import crawl
from tarnweave.sources import fetch, files


def site(n):
    return {f"https://s.test/{k}": f'<html><body><main>page {k}<a href="/{2 * k + 1}">a</a><a href="/{2 * k + 2}">b</a></main><nav><a href="/hidden">h</a></nav></body></html>' for k in range(n)}


def test_fetch_and_crawl(spark):
    pages = site(20)

    def get(url, timeout, most):
        if url.endswith("/3"):
            raise TimeoutError
        return 200, "text/html", pages[url]

    urls = spark.createDataFrame([(u,) for u in [*pages, "https://s.test/0"]] + [(None,)], "url string")
    snapshot = session.cut(fetch.fetch_pages(urls, get=get))
    assert snapshot.count() == 20 and snapshot.where("status is null").first()["url"] == "https://s.test/3"
    found = crawl(snapshot, "  https://s.test/0 ", 100)
    depths = {r.url: r.depth for r in found.visited.collect()}
    # every second address is known from its parent; the children of the failed page are not
    assert depths["https://s.test/19"] == 4 and "https://s.test/7" not in depths and "https://s.test/hidden" not in depths
    assert found.statistics().first().asDict() == {"visited": len(depths), "indexed": found.pages.count(), "urls": found.url_ids.count(), "edges": found.url_edges.count()}
    assert {r.depth for r in crawl(snapshot, "https://s.test/0", 4).visited.collect()} == {0, 1, 2}
    with pytest.raises(ValueError):
        crawl(snapshot, "ftp://s.test/")


def test_fetch_failures():
    assert fetch.http_get("http://127.0.0.1:9/", 0.2, 10) == (None, None, None) == fetch.http_get("no url", 0.2, 10)


def test_envelopes(spark):
    snapshot = spark.createDataFrame([(u, 200, "text/html", h) for u, h in site(5).items()], "url string, status long, content_type string, html string")
    out = pipeline.rank_envelope(pipeline.rank_site(snapshot, "https://s.test/0", 10, 3), "https://s.test/0").first()
    assert (out.start_url, out.page_count, out.edge_count, len(out.pages)) == ("https://s.test/0", 5, 10, 3) and [p["rank"] for p in out.pages] == [1, 2, 3]
    assert len(out.nodes) == 11 and sorted(out.edges[0].asDict()) == ["from", "to"]
    assert pipeline.file_envelope(pipeline.rank_file(spark.createDataFrame([(0, 1), (1, 0)], "src long, dst long"))).first().top[0].node == 0
    assert pipeline.file_envelope(spark.createDataFrame([], "node long, score double")).first().error


def test_build_corpus(spark, tmp_path):
    snapshot = spark.createDataFrame([(u, 200, "text/html", h) for u, h in site(5).items()], "url string, status long, content_type string, html string")
    total = pipeline.build_corpus(snapshot, "https://s.test/0", str(tmp_path)).first()
    assert abs(total.score_sum - 1) < 1e-9
    pages, ranks = files.read_pages(spark, str(tmp_path / "pages.json")), files.read_pagerank(spark, str(tmp_path / "pagerank.json"))
    assert pages.count() == 5 == ranks.count() and files.read_edges(spark, str(tmp_path / "edges.txt")).count() == 10


def test_json_array(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n {"id": 1, "url": "u", "text": "a"},\n {"id": 2, "url": null, "text": "b\\nc"}\n]\n')
    assert [tuple(r) for r in files.read_pages(spark, str(tmp_path / "a.json")).orderBy("id").collect()] == [(1, "u", "a"), (2, None, "b\nc")]


def test_longest_page(spark):
    rows = [(1, "https://A.test/x", "ab"), (2, "https://a.test/x/", "abc"), (3, "https://a.test/x#f", "abd"), (3, "https://a.test/x#f", "abd"), (4, "https://b.test", None), (5, None, "z")]
    got = {tuple(r) for r in merge.longest_page(spark.createDataFrame(rows, "id long, url string, text string")).collect()}
    assert got == {("https://a.test/x", 2, "abc"), ("https://b.test/", 4, "")}


def test_sized_by_bytes(spark, monkeypatch):
    table = spark.range(1000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(session.sized(table)) and not hinted(session.sized(table, 999))
    monkeypatch.setattr(session, "BROADCAST_BYTES", 1000)
    assert not hinted(session.sized(table))
    kept = session.cut(table)
    session.discard(kept)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(kept._tarnweave_folder)
