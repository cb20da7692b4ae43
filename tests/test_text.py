import json

import pytest
from pyspark.sql import functions as F

from tarnweave.functions import html as H
from tarnweave.functions import text as T
from tarnweave.functions import urls as U
from tarnweave.operators import index, merge, search
from tarnweave.plans import pipeline
from tarnweave.plans.crawl import crawl
from tarnweave.sources import sinks

HTML = """<html lang="en-US"><body><nav><a href="/nav">n</a></nav>
<main><p>Hello&amp;bye</p><a href="/a/">A</a><a href="#top">T</a><a href="https://other.net/x">X</a></main>
<footer><a href="/f">f</a></footer></body></html>"""


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_tokenizer(spark):
    texts = ["_a-b c'd", "日本語 テスト", "x²y ½ a‿b", "İs", "dét", "", None]
    assert column(spark, texts, T.tokenize) == [["_a", "b", "c", "d"], ["日本語", "テスト"], ["x²y", "½", "a", "b"], ["i̇s"], ["de", "t"], [], None]


def test_urls(spark):
    pairs = {
        "HTTP://EX.com/A//": "http://ex.com/A", "https://x.org": "https://x.org/", "https://x.org?": "https://x.org/", "https://x.org/?#": "https://x.org/", "https://x.org/a/#top": "https://x.org/a",
        "https://x.org/a/?q=1": "https://x.org/a?q=1", "https://x.org/a/;p": "https://x.org/a;p",
    }
    assert column(spark, list(pairs), U.normalize_url) == list(pairs.values())
    assert column(spark, list(pairs.values()), U.normalize_url)[:6] == list(pairs.values())[:6]
    hosts = ["en.wikipedia.org", "localhost", "", "x.co.uk", "h.com:8080"]
    assert column(spark, hosts, U.base_domain) == ["wikipedia.org", "localhost", "", "co.uk", "h.com:8080"]
    assert column(spark, ["https://u@A.b.C:80/x", None, "nothing", "//x.y/z"], U.site) == ["b.c", None, None, "x.y"]


def test_snippet(spark):
    long = "x" * 100 + " Needle " + "y" * 300
    got = column(spark, [long, "a" * 300, "", None], lambda c: T.snippet(c, "needle"))
    assert (len(got[0]), got[0][:3], got[0][-3:], got[0].index("Needle")) == (224, "… x", "y …", 75)
    assert got[1:] == ["a" * 220 + "…", "", ""]


def test_index_and_search(spark):
    docs = spark.createDataFrame([("d1", "Graph graph node"), ("d2", "node edge"), ("d3", "")], "doc_id string, text string")
    ix = index.build(docs)
    assert {r.term: round(r.idf, 10) for r in ix.terms.collect()} == {"graph": 1.4054651081, "node": 1.0, "edge": 1.4054651081}
    assert {r.doc_id: round(r.norm, 10) for r in ix.docs.collect()} == {"d1": 2.9835094571, "d2": 1.7249151197}
    assert [tuple(r) for r in search.tfidf_search(ix, "graph node unknown").collect()] == [("d1", 0.961985075), ("d2", 0.336096927)]
    for q in ("unknown", ""):
        assert search.tfidf_search(ix, q).count() == search.tfidf_search(ix, q, include_zero=True).count() == 0
    assert search.tfidf_search(ix, "edge", include_zero=True).count() == 2


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string")
    index.build(docs).save(str(tmp_path / "ix"), buckets=2)
    again = index.load(spark, str(tmp_path / "ix"))
    assert [r.doc_id for r in search.tfidf_search(again, "a").collect()] == [1]


def test_merging_and_hybrid(spark):
    pages = spark.createDataFrame([(1, "https://x.org/a", "abc"), (2, "https://X.org/a/", "graph"), (3, "https://x.org/b", "graph node"), (4, None, "z")], "id long, url string, text string")
    scores = spark.createDataFrame([(2, "https://x.org/a", 0.1), (2, "https://x.org/a/", 0.3), (3, "https://x.org/c", None)], "id long, url string, score double")
    assert {(r.url, r.id, r.text) for r in merge.longest_page(pages).collect()} == {("https://x.org/a", 2, "graph"), ("https://x.org/b", 3, "graph node")}
    assert {(r.url, r.score) for r in merge.best_score(scores).collect()} == {("https://x.org/a", 0.3), ("https://x.org/c", 0.0)}
    found = pipeline.search_tables(pages, scores).search("graph", 2)
    rows = found.collect()
    assert [r.url for r in rows] == ["https://x.org/a", "https://x.org/b"]
    assert rows[0].combined_score == pytest.approx(1.0) and rows[1].pagerank_score == 0.0
    envelope = json.loads(sinks.search_envelope(found, "graph").toJSON().first())
    assert envelope["query"] == "graph" and envelope["count"] == 2 and [r["url"] for r in envelope["results"]] == [r.url for r in rows]
    with pytest.raises(ValueError):
        search.hybrid_search(None, pages, scores, "", 5)
    with pytest.raises(ValueError):
        search.hybrid_search(None, pages, scores, "x", 51)
    kept = merge.join_ranks(spark.createDataFrame([(0, 0.5), (1, 0.3), (2, 0.2)], "id long, score double"), spark.createDataFrame([(0, "a"), (2, "b")], "id long, url string"))
    assert {r.id: round(r.score, 6) for r in kept.collect()} == {0: 0.714286, 2: 0.285714}


def test_html():
    root = H.parse(HTML)
    assert H.page_language(root) == "en"
    H.without_boilerplate(root)
    assert H.main_text(root) == "Hello&bye A T X"
    assert H.links(root) == ["/a/", "#top", "https://other.net/x"]
    meta = H.parse('<html><head><meta name="Language" content="DE, en"></head><body class="x">a<p>b<div class="nav top">c</div><script>s</script></body>')
    assert H.page_language(meta) == "de"
    assert H.main_text(H.without_boilerplate(meta)) == "a b"
    assert H.main_text(H.parse(None)) == "" and H.page_language(H.parse("")) is None


def test_native_html(spark):
    assert column(spark, [HTML, None, ""], H.text_native) == ["Hello&bye A T X", None, ""]
    assert column(spark, [HTML, ""], H.lang_native) == ["en", None]
    assert column(spark, [HTML], H.links_native)[0][0] == "/nav"


def snapshot(spark):
    def page(url, body, lang="en", status=200, kind="text/html"):
        return (url, status, kind, f'<html lang="{lang}"><body>{body}</body></html>')

    rows = [
        page("https://s.example.com/p", '<nav><a href="/nav">n</a></nav><main>P <a href="/a/">A</a><a href="#top">T</a><a href="https://other.net/x">X</a><a href="mailto:x@example.com">m</a><a href="/de">d</a><a href="/gone">g</a></main>'),
        page("https://s.example.com/a", '<a href="../p">back</a><a href="//t.example.com/b?q=1#f">b</a>'),
        page("https://t.example.com/b?q=1", "end"), page("https://s.example.com/de", '<a href="/never">n</a>', lang="de"), page("https://s.example.com/gone", "", status=404),
    ]
    return spark.createDataFrame(rows, "url string, status long, content_type string, html string")


def test_crawl(spark):
    out = crawl(snapshot(spark), "https://s.example.com/p", 10, "en")
    ids = {r.url: r.id for r in out.url_ids.collect()}
    assert ids["https://s.example.com/p"] == 0 and sorted(ids.values()) == list(range(len(ids)))
    assert {r.url for r in out.visited.collect()} == set(ids)
    assert {r.url for r in out.pages.collect()} == {"https://s.example.com/p", "https://s.example.com/a", "https://t.example.com/b?q=1"}
    links = {(r.source_url[-2:], r.target_url.rsplit("/", 1)[1]) for r in out.url_edges.collect()}
    assert links == {("/p", "a"), ("/p", "p"), ("/p", "de"), ("/p", "gone"), ("/a", "p"), ("/a", "b?q=1")}
    assert out.edges().count() == 6
    assert out.statistics().first().asDict() == {"visited": 5, "indexed": 3, "urls": 5, "edges": 6}
    assert crawl(snapshot(spark), "https://s.example.com/p", 2).visited.count() == 2
    with pytest.raises(ValueError):
        crawl(snapshot(spark), "ftp://x")


def test_corpus_pipeline(spark, tmp_path):
    total = pipeline.build_corpus(snapshot(spark), "https://s.example.com/p", str(tmp_path), max_pages=10).first()["score_sum"]
    assert total == pytest.approx(1.0)
    ranked = pipeline.rank_site(snapshot(spark), "https://s.example.com/p", top_k=3)
    assert [r["rank"] for r in ranked["pages"].collect()] == [1, 2, 3]
