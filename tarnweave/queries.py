"""Queries of the core operators over the test tables, and their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnweave.functions import html as H
from tarnweave.functions import text as T
from tarnweave.functions import urls as U
from tarnweave.operators import graph, index, merge, search
from tarnweave.operators.pagerank import pagerank, rank_report, top_ranks
from tarnweave.plans import pipeline
from tarnweave.plans.crawl import acceptable, assign_ids, crawl, map_edges, wanted_language
from tarnweave.session import cut, shared_dir
from tarnweave.sources import files, sinks

QUERY = "graph index harbour of the quiet engine"
UNKNOWN = "zzqx unfindable"
PARSED_QUERY = "la page graph"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with the SQL that gives the same rows."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.clean_edges(_table(spark, sf_dir, "edges"))


def _reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to part: nearly all nodes are dangling."""
    return _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))


# graph

EDGES = "with e as (select src, dst from edges where src is not null and dst is not null)"
NODES = f"{EDGES}, n as (select max(greatest(src, dst)) + 1 as n from e), nodes as (select unnest(range(n)) as id from n)"


@query(f"{EDGES} select distinct src, dst from e")
def edges_distinct(spark, sf_dir):
    return graph.distinct_edges(_edges(spark, sf_dir))


@query(f"{EDGES} select src, dst, count(*) as multiplicity from e group by all")
def edge_multiplicity(spark, sf_dir):
    return graph.edge_multiplicity(_edges(spark, sf_dir))


@query(f"{EDGES} select src, count(*) as out_degree from e group by src")
def out_degree(spark, sf_dir):
    return graph.out_degree(_edges(spark, sf_dir))


@query(f"{EDGES} select dst, count(*) as in_degree from e group by dst")
def in_degree(spark, sf_dir):
    return graph.in_degree(_edges(spark, sf_dir))


@query(f"{NODES}, d as (select id, count(dst) as in_degree from nodes left join e on dst = id group by id) select id, in_degree, (sum(in_degree) over (order by id) - in_degree)::bigint as row_offset from d")
def in_degree_prefix_sum(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return graph.in_degree_prefix_sum(edges, graph.node_count(edges))


@query(f"{NODES} select n as nodes, (select count(*) from e) as edges, n - (select count(distinct src) from e) as dangling from n")
def graph_summary(spark, sf_dir):
    return graph.summary(_edges(spark, sf_dir))


@query(f"{NODES} select id from nodes where id not in (select src from e)")
def dangling_nodes(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return graph.dangling_nodes(edges, graph.node_count(edges))


@query(f"{EDGES}, o as (select src, count(*) as d from e group by src) select src, dst, round(count(*)::double / any_value(d), 12) as weight from e join o using (src) group by src, dst")
def transition_matrix(spark, sf_dir):
    return graph.transition_matrix(_edges(spark, sf_dir)).withColumn("weight", F.round("weight", 12))


def _pagerank_sql(edges: str, iterations: int, leak: bool = False, normalize: bool = True, trace: bool = False, damping: float = 0.85) -> str:
    parts = [
        f"with e as ({edges}), n as (select max(greatest(src, dst)) + 1 as n from e), nodes as materialized (select unnest(range(n)) as id, n::double as n from n)",
        "o as materialized (select src, count(*) as d from e group by src)",
        "w as materialized (select e.src, e.dst, count(*)::double / any_value(d) as w from e join o on o.src = e.src group by e.src, e.dst)",
        "r0 as materialized (select id, n, 1.0::double / n as r, id not in (select src from o) as loose from nodes)",
    ]
    for k in range(iterations):
        spread = "0.0::double" if leak else f"coalesce((select sum(r) from r{k} where loose), 0.0::double) / r.n"
        parts.append(f"y{k} as materialized (select dst, sum(w * r) as y from w join r{k} on id = src group by dst)")
        parts.append(f"r{k + 1} as materialized (select r.id, r.n, {damping}::double * (coalesce(y, 0.0::double) + {spread}) + {1 - damping}::double / r.n as r, r.loose, r.r as old from r{k} r left join y{k} on dst = r.id)")
    if trace:
        steps = " union all ".join(f"select {k}::bigint as iteration, round(sum(abs(r - old)), 9) as l1, round(max(abs(r - old)), 9) as linf from r{k}" for k in range(1, iterations + 1))
        return ", ".join(parts) + " " + steps
    total = f"(select sum(r) from r{iterations})" if normalize else "1.0::double"
    return ", ".join(parts) + f" select id, round(r / {total}, 10) as rank from r{iterations}"


RAW = "select src, dst from edges where src is not null and dst is not null"
DISTINCT = "select distinct src, dst from edges where src is not null and dst is not null"
REVERSED = "select l_suppkey as src, l_partkey as dst from lineitem"


def _ranks(edges: DataFrame, iterations: int = 20, **options) -> DataFrame:
    return pagerank(edges, tol=0.0, max_iter=iterations, **options).ranks.withColumn("rank", F.round("rank", 10))


@query(_pagerank_sql(RAW, 1))
def pagerank_step1(spark, sf_dir):
    return _ranks(_edges(spark, sf_dir), 1)


@query(_pagerank_sql(RAW, 20))
def pagerank_20_multi(spark, sf_dir):
    return _ranks(_edges(spark, sf_dir))


@query(_pagerank_sql(DISTINCT, 20))
def pagerank_20_distinct(spark, sf_dir):
    return _ranks(_edges(spark, sf_dir), dedup=True)


@query(_pagerank_sql(REVERSED, 20))
def pagerank_20_dangling(spark, sf_dir):
    return _ranks(_reversed(spark, sf_dir))


@query(_pagerank_sql(RAW, 20, leak=True, normalize=False))
def pagerank_leak_20(spark, sf_dir):
    return _ranks(_edges(spark, sf_dir), dangling="leak", norm="linf", normalize=False)


@query(_pagerank_sql(RAW, 20, normalize=False))
def pagerank_distribute_20(spark, sf_dir):
    return _ranks(_edges(spark, sf_dir), norm="linf", normalize=False)


@query(_pagerank_sql(RAW, 10, trace=True))
def pagerank_delta_trace(spark, sf_dir):
    deltas = pagerank(_edges(spark, sf_dir), tol=0.0, max_iter=10).deltas
    rows = spark.createDataFrame([(k + 1, a, b) for k, (a, b) in enumerate(deltas)], "iteration long, l1 double, linf double")
    return rows.select("iteration", F.round("l1", 9).alias("l1"), F.round("linf", 9).alias("linf"))


@query(f"with p as ({_pagerank_sql(RAW, 60)}) select id, round(rank, 8) as rank, row_number() over (order by round(rank, 8) desc, id) as place from p order by 3 limit 20")
def pagerank_converged_topk(spark, sf_dir):
    ranks = pagerank(_edges(spark, sf_dir), tol=1e-8, max_iter=100).ranks
    return top_ranks(ranks.withColumn("rank", F.round("rank", 8)), 20).withColumn("place", F.col("place").cast("long"))


# URLs and merging: the patterns are those of functions/urls.py, written for SQL

_RFC = U.RFC3986.replace("'", "''")


def _norm_sql(url: str) -> str:
    def part(g: int) -> str:
        return f"regexp_extract({url}, '{_RFC}', {g})"

    path = f"regexp_extract({part(5)}, '^(.*?)(;[^/]*)?$', 1)"
    params = f"regexp_extract({part(5)}, '^(.*?)(;[^/]*)?$', 2)"
    return (
        f"case when {url} is null then null else concat(case when {part(2)} <> '' then lower({part(2)}) || ':' else '' end, case when {part(4)} <> '' then '//' || lower({part(4)}) else '' end, "
        f"case when {path} in ('', '/') then '/' else regexp_replace({path}, '/+$', '') end, case when length({params}) > 1 then {params} else '' end, case when {part(7)} <> '' then '?' || {part(7)} else '' end) end"
    )


_NETLOC = f"lower(regexp_extract(url, '{_RFC}', 4))"
_BASE = f"array_to_string(string_split({_NETLOC}, '.')[-2:], '.')"


@query(f"select id, {_norm_sql('url')} as url from pages")
def url_normalised(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("id", U.normalize_url(F.col("url")).alias("url"))


@query(f"select id, {_BASE} as base from pages where url is not null")
def url_base_domain(spark, sf_dir):
    return _table(spark, sf_dir, "pages").where("url is not null").select("id", U.base_domain(U.netloc(F.col("url"))).alias("base"))


@query(f"select id, coalesce({_BASE} = 'roroth.example', false) as same from pages")
def url_same_domain(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("id", U.same_domain(F.col("url"), F.lit("roroth.example")).alias("same"))


LONGEST = f"select url, id, text from (select {_norm_sql('url')} as url, id, coalesce(text, '') as text, row_number() over (partition by {_norm_sql('url')} order by length(coalesce(text, '')) desc, id) as k from pages where url is not null) where k = 1"
BEST = f"select {_norm_sql('url')} as url, max(coalesce(score, 0.0::double)) as score from pagerank where url is not null group by 1"


@query(LONGEST)
def page_dedup_longest(spark, sf_dir):
    return merge.longest_page(_table(spark, sf_dir, "pages"))


@query(BEST)
def score_dedup_max(spark, sf_dir):
    return merge.best_score(_table(spark, sf_dir, "pagerank"))


@query(f"with b as ({BEST}), m as (select min(score) as lo, max(score) as hi from b) select url, score as raw, round(case when hi > lo then (score - lo) / (hi - lo) else 0.0::double end, 12) as norm from b, m")
def pagerank_minmax(spark, sf_dir):
    return search.scaled_ranks(merge.best_score(_table(spark, sf_dir, "pagerank"))).withColumn("norm", F.round("norm", 12))


_LAST = "select id, max(url) as url from pages group by id"
_SCORES = "select id, max(score) as score from pagerank where score is not null group by id"


def _scores(spark, sf_dir):
    return _table(spark, sf_dir, "pagerank").where("score is not null").groupBy("id").agg(F.max("score").alias("score"))


@query(f"with k as (select id, p.url, score from ({_SCORES}) join ({_LAST}) p using (id)) select id, url, round(score / (select sum(score) from k), 12) as score from k")
def rank_join_renormalise(spark, sf_dir):
    return merge.join_ranks(_scores(spark, sf_dir), _table(spark, sf_dir, "pages")).withColumn("score", F.round("score", 12))


@query(f"select id, score from ({_SCORES}) where id not in (select id from pages)")
def rank_dropped(spark, sf_dir):
    return merge.dropped_ranks(_scores(spark, sf_dir), _table(spark, sf_dir, "pages"))


@query("select id, 'ranks' as missing_from from (select id from pages except select id from pagerank) union all select id, 'pages' from (select id from pagerank except select id from pages)")
def id_reconciliation(spark, sf_dir):
    return merge.reconcile_ids(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "pagerank"))


@query("select round(sum(score), 3) as score_sum, count(*) as rows, count(score) as scored from pagerank")
def rank_sum_check(spark, sf_dir):
    return _table(spark, sf_dir, "pagerank").agg(F.round(F.sum("score"), 3).alias("score_sum"), F.count(F.lit(1)).alias("rows"), F.count("score").alias("scored"))


@query("select (select count(*) from pages) as pages, (select count(*) from pagerank) as ranks")
def status_counts(spark, sf_dir):
    return pipeline.status(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "pagerank"))


@query("select id, score from (select id, max(score) as score from pagerank where score is not null group by id) order by score desc, id limit 5")
def rank_preview(spark, sf_dir):
    return _scores(spark, sf_dir).orderBy(F.desc("score"), "id").limit(5)


_ROUNDED = "select id::bigint as id, round(score, 9) as score from (select id, max(score) as score from pagerank where score is not null and id is not null group by id)"


def _report_lines(spark, sf_dir):
    return _scores(spark, sf_dir).where("id is not null").select("id", F.round("score", 9).alias("score")).withColumn("value", F.format_string("  node %d : %.9f", "id", "score"))


@query(_ROUNDED)
def rank_report_parse(spark, sf_dir):
    head = spark.createDataFrame([("N (nodes): 3",), ("Dangling nodes: 1",)], "value string")
    return files.parse_report(_report_lines(spark, sf_dir).select("value").unionByName(head))


@query(f"select id, score from ({_ROUNDED}) order by score desc, id limit 1000")
def rank_report_parse_anchored(spark, sf_dir):
    """A whole report of the 1,000 best; what stands above its header, or beside a rank, doesn't count."""
    top = _report_lines(spark, sf_dir).orderBy(F.desc("score"), "id").limit(1000)
    text = top.agg(F.concat(F.lit("Graph summary:\n  node 7 : 0.5\n\nTop 1000 nodes by PageRank:\n"), F.array_join(F.collect_list("value"), "\n"), F.lit("\n  node 8 : 0.5 or so\n")).alias("value"))
    return files.parse_report(text, anchored=True)


# files: written, read again

def _written(spark, write, read):
    path = f"{shared_dir(spark)}/file-{uuid.uuid4().hex}"
    write(path)
    return read(path)


@query(RAW)
def edge_file(spark, sf_dir):
    return _written(spark, lambda p: sinks.write_edges(_table(spark, sf_dir, "edges"), p), lambda p: files.read_edges(spark, p))


@query(DISTINCT)
def edge_file_distinct(spark, sf_dir):
    return _written(spark, lambda p: sinks.write_edges(_table(spark, sf_dir, "edges"), p, dedup=True), lambda p: files.read_edges(spark, p))


@query("select '/p/' || src as source, dst as target_id from edges where src is not null and dst is not null")
def edge_csv(spark, sf_dir):
    rows = _edges(spark, sf_dir).select(F.concat(F.lit("/p/"), F.col("src").cast("string")).alias("source"), F.col("dst").alias("target_id"))
    return _written(spark, lambda p: sinks.write_edge_csv(rows, p), lambda p: spark.read.schema("source string, target_id long").option("header", True).csv(p))


@query("select id, url, text from pages")
def page_file(spark, sf_dir):
    return _written(spark, lambda p: sinks.write_json(_table(spark, sf_dir, "pages").select("id", "url", "text"), p), lambda p: files.read_pages(spark, p))


@query("select id, url, score from pagerank")
def rank_file(spark, sf_dir):
    return _written(spark, lambda p: sinks.write_pagerank(_table(spark, sf_dir, "pagerank"), p), lambda p: files.read_pagerank(spark, p))


# text and search

_TOKENS = "list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda x: lower(x))"
_TF = f"select doc_id, term, count(*) as tf from (select doc_id, unnest({_TOKENS}) as term from documents) group by all"
_LEN = f"select doc_id, len({_TOKENS})::bigint as n_tokens from documents where len({_TOKENS}) > 0"


def _index_sql(docs: str) -> str:
    return (
        f"with d as materialized ({docs}), l as materialized (select doc_id, len({_TOKENS})::bigint as n_tokens from d where len({_TOKENS}) > 0), tf as materialized (select doc_id, term, count(*) as tf from (select doc_id, unnest({_TOKENS}) as term from d) group by all), "
        "t as materialized (select term, count(*) as df, ln((1.0::double + (select count(*) from l)) / (1.0::double + count(*))) + 1.0::double as idf from tf group by term), "
        "po as materialized (select term, doc_id, tf, tf * idf as weight from tf join t using (term)), norms as materialized (select doc_id, n_tokens, sqrt(sum(weight * weight)) as norm from po join l using (doc_id) group by all)"
    )


_DOCS = "select doc_id, text from documents"
_INDEX = _index_sql(_DOCS)


def _search_sql(text: str, k: int, zero: bool = False, docs: str = _DOCS) -> str:
    terms = T.tokenize_query(text)
    values = ", ".join(f"('{t}', {terms.count(t)})" for t in sorted(set(terms)))
    return (
        f"{_index_sql(docs)}, q as (select term, freq * idf as qw from (values {values}) v(term, freq) join t using (term)), qn as (select sqrt(sum(qw * qw)) as qn from q having count(*) > 0), "
        f"dots as (select doc_id, sum(qw * weight) as dot from po join q using (term) group by doc_id), found as (select doc_id, round(coalesce(dot, 0.0::double) / (norm * qn), 9) as score from norms {'left' if zero else ''} join dots using (doc_id), qn order by score desc, doc_id limit {k})"
    )


def _index(spark, sf_dir):
    return index.build(_table(spark, sf_dir, "documents"))


@query(f"select doc_id, {_TOKENS} as tokens from documents")
def tokens(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.tokenize(F.col("text")).alias("tokens"))


@query(_TF)
def term_freq(spark, sf_dir):
    return index.term_freq(_table(spark, sf_dir, "documents"))


@query(f"select term, count(*) as df from ({_TF}) group by term")
def doc_freq(spark, sf_dir):
    return _index(spark, sf_dir).terms.select("term", "df")


@query(f"{_INDEX} select term, round(idf, 9) as idf from t")
def idf(spark, sf_dir):
    return _index(spark, sf_dir).terms.select("term", F.round("idf", 9).alias("idf"))


@query(_LEN)
def doc_len(spark, sf_dir):
    return index.doc_len(_table(spark, sf_dir, "documents"))


@query(f"{_INDEX} select doc_id, round(norm, 8) as norm from norms")
def doc_norms(spark, sf_dir):
    return _index(spark, sf_dir).docs.select("doc_id", F.round("norm", 8).alias("norm"))


@query(f"{_INDEX} select term, doc_id, tf, round(weight, 8) as weight from po")
def postings_weight(spark, sf_dir):
    return _index(spark, sf_dir).postings.withColumn("weight", F.round("weight", 8))


@query(f"{_search_sql(QUERY, 30)} select doc_id, score from found")
def tfidf_search(spark, sf_dir):
    return search.tfidf_search(_index(spark, sf_dir), QUERY, 30)


@query(f"{_search_sql(QUERY, 30)} select doc_id, score from found")
def tfidf_search_saved(spark, sf_dir):
    """The same over an index that was written and loaded: only the postings of the query's terms are read."""
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    _index(spark, sf_dir).save(path)
    return search.tfidf_search(index.load(spark, path), QUERY, 30)


@query(f"{_search_sql(PARSED_QUERY, 1000000000, True)} select doc_id, score from found")
def tfidf_search_include_zero(spark, sf_dir):
    return search.cosine_scores(_index(spark, sf_dir), PARSED_QUERY, include_zero=True).withColumn("score", F.round("score", 9))


@query(f"{_search_sql(UNKNOWN, 10)} select doc_id, score from found")
def tfidf_search_unknown_term(spark, sf_dir):
    return search.tfidf_search(_index(spark, sf_dir), UNKNOWN, 10)


def _snippet_sql(text: str, words: str, n: int = T.SNIPPET_LENGTH) -> str:
    hits = ", ".join(f"nullif(instr(lower({text}), '{w}'), 0)" for w in words.lower().split())
    space = T.SPACE.replace("\\x{85}", "\\x{0085}")
    start = f"greatest(0, least({hits}) - 1 - {n // 3})"
    strip = f"regexp_replace(substring({text}, {start} + 1, {n}), '^{space}+|{space}+$', '', 'g')"
    return (
        f"case when coalesce({text}, '') = '' then '' when least({hits}) is null then substring({text}, 1, {n}) || case when length({text}) > {n} then '…' else '' end "
        f"else concat(case when {start} > 0 then '… ' else '' end, {strip}, case when least(length({text}), {start} + {n}) < length({text}) then ' …' else '' end) end"
    )


@query(f"select doc_id, {_snippet_sql('text', QUERY)} as snippet from documents")
def snippets(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text"), QUERY).alias("snippet"))


@query(
    _search_sql(QUERY, 30, docs=f"select url as doc_id, text from ({LONGEST})")
    + f", b as ({BEST}), m as (select min(score) as lo, max(score) as hi from b), s as (select f.doc_id as url, f.score as tfidf_score, coalesce(b.score, 0.0::double) as raw, coalesce(case when hi > lo then (b.score - lo) / (hi - lo) else 0.0::double end, 0.0::double) as norm from found f left join b on b.url = f.doc_id, m), "
    f"top as (select *, round(0.8::double * tfidf_score + (1 - 0.8::double) * norm, 9) as combined_score from s order by combined_score desc, url limit 10) select top.url, {_snippet_sql('d.text', QUERY)} as snippet, tfidf_score, round(raw, 12) as pagerank_score, combined_score from top join d on d.doc_id = top.url"
)
def hybrid_search(spark, sf_dir):
    return pipeline.search_tables(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "pagerank")).search(QUERY, 10)


# HTML: pages of the test tables carry text only, so each is wrapped into a document with links to the pages it points to

_HTML = (
    "concat('<!DOCTYPE html><html lang=\"', coalesce(lang, ''), '\"><head><title>t</title><style>p {{}}</style></head><body><nav><a href=\"/start?p=', id, '\">n</a></nav><main><!-- c --><p>', "
    "replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '\n', '</p><p>'), '</p><a class=\"l\" href=\"/n/', id % 97, '/\">A</a><a href=\"#top\">T</a></main><footer><a href=\"mailto:x\">f</a></footer></body></html>')"
).replace("{{}}", "{}")
_WRAPPED = f"select id, url, {_HTML} as html, case when id % 31 = 0 then 404 else 200 end::bigint as status, case when id % 29 = 0 then 'application/pdf' else 'Text/HTML; charset=utf-8' end as content_type from pages"


def _wrapped(spark, sf_dir):
    html = F.expr(_HTML.replace("\n", "\\n"))
    status = F.when(F.col("id") % 31 == 0, 404).otherwise(200).cast("long")
    kind = F.when(F.col("id") % 29 == 0, "application/pdf").otherwise("Text/HTML; charset=utf-8")
    return _table(spark, sf_dir, "pages").select("id", "url", html.alias("html"), status.alias("status"), kind.alias("content_type"))


_LANG = "nullif(split_part(split_part(lower(trim(coalesce(nullif(regexp_extract(html, '(?is)<html\\b[^>]*?\\blang=\"([^\"]*)\"', 1), '')))), ',', 1), '-', 1), '')"


@query(f"with w as ({_WRAPPED}) select id, {_LANG} as lang from w")
def page_lang(spark, sf_dir):
    return _wrapped(spark, sf_dir).select("id", H.lang_native(F.col("html")).alias("lang"))


@query(f"with w as ({_WRAPPED}) select id from w where {_LANG} is null or starts_with({_LANG}, 'de')")
def page_lang_filter(spark, sf_dir):
    return _wrapped(spark, sf_dir).where(wanted_language(H.lang_native(F.col("html")), "de")).select("id")


@query(f"with w as ({_WRAPPED}) select id from w where status = 200 and lower(content_type) like '%text/html%' and strlen(html) <= 2000000")
def page_response_filter(spark, sf_dir):
    return acceptable(_wrapped(spark, sf_dir)).select("id")


def _text_sql() -> str:
    out = "html"
    for tag in H.BLOCKS:
        out = f"regexp_replace({out}, '(?is)<{tag}\\b.*?</{tag}>', ' ', 'g')"
    out = f"regexp_extract(regexp_replace({out}, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<main\\b[^>]*>(.*)</main>', 1)"
    out = f"regexp_replace({out}, '(?s)<[^>]*>', ' ', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    space = T.SPACE.replace("\\x{85}", "\\x{0085}")
    return f"trim(regexp_replace({out}, '{space}+', ' ', 'g'), ' ')"


@query(f"with w as ({_WRAPPED}) select id, {_text_sql()} as text from w")
def page_text_native(spark, sf_dir):
    return _wrapped(spark, sf_dir).select("id", H.text_native(F.col("html")).alias("text"))


@query(f"with w as ({_WRAPPED}) select id, {_text_sql()} as text from w")
def page_text_parser(spark, sf_dir):
    return _wrapped(spark, sf_dir).select("id", H.parsed(F.col("html")).alias("p")).select("id", "p.text")


_HREFS = "unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href=\"([^\"]*)\"', 1))"


@query(f"with w as ({_WRAPPED}) select id, {_HREFS} as href from w")
def page_links_raw(spark, sf_dir):
    return _wrapped(spark, sf_dir).select("id", F.explode(H.links_native(F.col("html"))).alias("href"))


_TARGETS = (
    f"w as materialized ({_WRAPPED}), h as (select url, {_HREFS} as href from w where url is not null), "
    f"r as (select {_norm_sql('url')} as source_url, case when href like '/%' then regexp_extract(url, '{_RFC}', 1) || regexp_extract(url, '{_RFC}', 3) || href when href like '#%' then regexp_replace(url, '#.*$', '') || href else href end as u from h where not (lower(href) like 'mailto:%')), "
    f"l as materialized (select source_url, {_norm_sql('u')} as target_url from r), "
    "ids as materialized (select url, row_number() over (order by depth, url) - 1 as id from (select url, min(depth) as depth from (select source_url as url, 0 as depth from l union all select target_url, 1 from l) group by url))"
)


def _links(spark, sf_dir):
    hrefs = _wrapped(spark, sf_dir).where("url is not null").select("url", F.explode(H.links_native(F.col("html"))).alias("href")).where(~U.rejected_scheme(F.col("href")))
    return cut(hrefs.select(U.normalize_url(F.col("url")).alias("source_url"), U.normalize_url(U.resolve_link_native(F.col("url"), F.col("href"))).alias("target_url")))


def _ids(links):
    return assign_ids(links.select(F.col("source_url").alias("url"), F.lit(0).alias("depth")).unionByName(links.select(F.col("target_url").alias("url"), F.lit(1).alias("depth"))))


@query(f"with {_TARGETS} select url, id from ids")
def url_ids(spark, sf_dir):
    return _ids(_links(spark, sf_dir))


@query(f"with {_TARGETS} select s.id as src, t.id as dst from l join ids s on s.url = source_url join ids t on t.url = target_url")
def url_edges_mapped(spark, sf_dir):
    links = _links(spark, sf_dir)
    return map_edges(links, _ids(links))


# crawl: each page of the tables under an address of its own, its links from the edge list, among links that don't count; some pages fail, are no HTML, or in another language

_HOST, _BUDGET, _LEVELS = "https://crawl.example/p/", 300, 12
_CRAWL = (
    "with recursive e as (select distinct src, dst from edges where src is not null and dst is not null), "
    "ok as materialized (select distinct id from pages where id is not null and id % 31 <> 0 and id % 29 <> 0 and (id % 7 <> 0 or id % 5 = 0)), "
    "start as materialized (select ok.id from ok left join e on src = ok.id group by ok.id order by count(dst) desc, ok.id limit 1), "
    f"l as materialized (select '{_HOST}' || src as s, '{_HOST}' || dst as t from e join ok on ok.id = src union all select '{_HOST}' || id, '{_HOST}' || id from ok), "
    f"v0 as materialized (select '{_HOST}' || id as url, 0 as depth from start)"
)
for _k in range(1, _LEVELS):
    _CRAWL += (
        f", f{_k} as materialized (select distinct t as url from l join v{_k - 1} on s = url and depth = {_k - 1} where t not in (select url from v{_k - 1})), "
        f"v{_k} as materialized (select * from v{_k - 1} union all select url, {_k} from (select url, row_number() over (order by url) as k from f{_k}) where k <= {_BUDGET} - (select count(*) from v{_k - 1}))"
    )
_CRAWL += (
    f", v as materialized (select * from v{_LEVELS - 1}), pg as materialized (select v.url, depth, id from v join ok on v.url = '{_HOST}' || id), ue as materialized (select s, t, depth from l join pg on s = pg.url), "
    "ids as materialized (select url, row_number() over (order by min(depth), url) - 1 as id from (select url, depth from pg union all select t, depth + 1 from ue) group by url)"
)
_CRAWL_EDGES = "select a.id as src, b.id as dst from ue join ids a on a.url = s join ids b on b.url = t"


def _crawl_input(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").where("id is not null").select("id").distinct()
    links = graph.distinct_edges(_edges(spark, sf_dir))
    anchors = links.groupBy(F.col("src").alias("id")).agg(F.array_join(F.collect_list(F.concat(F.lit('<a href="/p/'), F.col("dst").cast("string"), F.lit('/">l</a>'))), "").alias("a"), F.count(F.lit(1)).alias("n"))
    rows = pages.join(anchors, "id", "left").withColumns({"a": F.coalesce("a", F.lit("")), "n": F.coalesce("n", F.lit(0))})
    lang = F.when(F.col("id") % 5 == 0, "").when(F.col("id") % 7 == 0, "de-AT").otherwise("en")
    html = F.concat(F.lit('<html lang="'), lang, F.lit('"><body><nav><a href="/nav">n</a></nav><main>'), "a", F.lit('<a href="https://other.example/x">o</a><a href="mailto:a@b.example">m</a><a href="#top">t</a></main><footer><a href="/foot">f</a></footer></body></html>'))
    status, kind = F.when(F.col("id") % 31 == 0, 404).otherwise(200).cast("long"), F.when(F.col("id") % 29 == 0, "application/pdf").otherwise("text/html; charset=utf-8")
    snapshot = cut(rows.select("id", "n", F.concat(F.lit(_HOST), F.col("id").cast("string")).alias("url"), status.alias("status"), kind.alias("content_type"), html.alias("html"), lang.alias("lang")))
    start = snapshot.where("status = 200 and content_type like 'text%' and lang <> 'de-AT'").orderBy(F.desc("n"), "id").first()
    return snapshot.select("url", "status", "content_type", "html"), f" {start['url']}#x "


def _crawled(spark, sf_dir):
    return crawl(*_crawl_input(spark, sf_dir), _BUDGET, "en")


@query(f"{_CRAWL} select url, depth from v")
def crawl_bfs(spark, sf_dir):
    """Breadth first from the page of most links, until _BUDGET pages are visited."""
    return _crawled(spark, sf_dir).visited


@query(f"{_CRAWL} select ids.id, pg.url, repeat('l ', (select count(*) from e where src = pg.id)::bigint) || 'o m t' as text from pg join ids on ids.url = pg.url")
def crawl_pages(spark, sf_dir):
    return _crawled(spark, sf_dir).pages


@query(f"{_CRAWL} {_CRAWL_EDGES}")
def crawl_edges(spark, sf_dir):
    return _crawled(spark, sf_dir).edges()


@query(f"{_CRAWL} select (select count(*) from v) as visited, (select count(*) from pg) as indexed, (select count(*) from ids) as urls, (select count(*) from ue) as edges")
def crawl_statistics(spark, sf_dir):
    return _crawled(spark, sf_dir).statistics()


@query(_pagerank_sql(f"{_CRAWL} {_CRAWL_EDGES}", 90).replace("select id, round(r /", "select node_id, url, rank, score from (select p.id as node_id, url, row_number() over (order by score desc, p.id) as rank, score from (select id, round(r /").replace("10) as rank from r90", f"7) as score from r90) p join ({_CRAWL} select id, url from ids) using (id)) where rank <= 20"))
def rank_site_top(spark, sf_dir):
    snapshot, start = _crawl_input(spark, sf_dir)
    found = pipeline.rank_site(snapshot, start, _BUDGET, 1000, "en")["pages"]
    top = found.withColumn("score", F.round("score", 7)).orderBy(F.desc("score"), "node_id").limit(20)
    return top.select("node_id", "url", F.row_number().over(Window.orderBy(F.desc("score"), "node_id")).cast("long").alias("rank"), "score")


# hand-made graphs

_REGION = "select 'r' || r_regionkey as id from region union all select 'n' || n_nationkey from nation"
_REGION_EDGES = "select 'n' || n_nationkey as src, 'r' || n_regionkey as dst from nation"


def _small_graph(spark, sf_dir):
    region, nation = _table(spark, sf_dir, "region"), _table(spark, sf_dir, "nation")
    ids = region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name")).unionByName(nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name")))
    return ids, nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst"))


@query(f"with i as ({_REGION}), e as ({_REGION_EDGES}) select a.id as src, b.id as dst, (exists (select 1 from e where e.src = a.id and e.dst = b.id))::int as linked from i a, i b")
def adjacency_matrix(spark, sf_dir):
    ids, edges = _small_graph(spark, sf_dir)
    return graph.adjacency_matrix(ids, edges)


@query(f"with e as ({_REGION_EDGES} union all select 'r0', 'r1') select src, dst from e where src not in ('n3') and dst not in ('n3') and not (src = 'n5' and dst = 'r0') union all select 'r0', 'r1'")
def graph_edit(spark, sf_dir):
    ids, edges = _small_graph(spark, sf_dir)
    edges = graph.add_edge(graph.add_edge(graph.add_edge(edges, "r0", "r1"), "r0", "r1"), "r2", "r2")
    ids, edges = graph.remove_node(ids, edges, "n3")
    return graph.valid_edges(graph.remove_edge(edges, "n5", "r0"), ids)


_REPORT = _pagerank_sql(RAW, 20).replace("select id, round(r /", "select value from (select unnest(['Graph summary:', '  N (nodes) : ' || max(n)::bigint, '  M (edges) : ' || (select count(*) from e), '  Dangling nodes: ' || count(*) filter (loose), '', 'Top 10 nodes by PageRank:']) as value from r0) union all (select printf('  node %d : %.10f', id, rank) from (select id, round(r /") + ") order by rank desc, id limit 10)"


@query(_REPORT)
def rank_report_lines(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return rank_report(edges, pagerank(edges, max_iter=20, tol=0.0).ranks, 10)


@query()
def random_graph(spark, sf_dir):
    n = _table(spark, sf_dir, "supplier").count()
    return graph.random_graph(spark, n, 3 * n, seed=7)
