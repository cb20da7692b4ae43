"""SQL twins of the queries that SQL can state over whole tables."""

from __future__ import annotations

_SITE = "nullif(array_to_string(string_split(trim(regexp_extract(lower(url), '^(?:[^:/?#]+:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1), ' '), '.')[-2:], '.'), '')"
_BLANK = "[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x{0085}\\p{Z}]+"
_LINES = f"string_split(regexp_replace(regexp_replace(lower(text), '{_BLANK}', ' ', 'g'), '\\p{{Nd}}+', '0', 'g'), chr(10))"
_TOKENS = "list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda x: lower(x))"
_WORDS = "list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: lower(x))"

P1 = f"""
with p as (select id, {_SITE} as site, {_LINES} as lines from pages where text is not null and url is not null),
l as materialized (select id, site, unnest(range(len(lines))) as line_no, trim(unnest(lines), ' ') as line from p where site is not null),
n as (select site, count(*) as n from p where site is not null group by site),
c as (select site, line, count(distinct id) as k from l where line <> '' group by site, line)
select id, line_no::bigint as line_no from l join c using (site, line) join n using (site) where k >= 4 and k * 20 >= n
"""

P1_TEMPLATES = f"""
with p as (select row_number() over () as page, {_SITE} as site, {_LINES} as lines from pages where text is not null and url is not null),
l as materialized (select distinct page, site, trim(unnest(lines), ' ') as line from p where site is not null),
t as materialized (select page, site, string_split(line, ' ') as t from l where line <> ''),
n as (select site, count(*) as n from p where site is not null group by site),
c as materialized (select site, len(t) as k, t[1:3] as head, count(distinct page) as pages from t group by all),
w as (select t.site, len(t) as k, t[1:3] as head, unnest(t) as token, unnest(range(len(t))) as slot from t),
s as (select site, k, head, slot, case when min(token) <> max(token) or contains(min(token), '0') then '<*>' else min(token) end as token from w group by all)
select site, string_agg(token, ' ' order by slot) as template, any_value(pages) as pages from s join c using (site, k, head) join n using (site) where pages >= 4 and pages >= n * 0.05::double group by site, k, head
"""

P1_CLEANED = f"""
with found as ({P1.strip()}), g as (select id, list(line_no) as gone from found group by id)
select pages.id, case when gone is null then text else array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: not list_contains(gone, i - 1)), chr(10)) end as text from pages left join g using (id)
"""

P2 = """
with best as (select query_id, node_id, tfidf_score, pagerank_score, combined_score, row_number() over (partition by query_id, node_id order by served_at desc nulls last, tfidf_score desc nulls last, pagerank_score desc nulls last, combined_score desc nulls last) as k from search_results),
c as (select query_id, node_id, unnest(['t', 'p', 'c']) as what, unnest([tfidf_score, pagerank_score, combined_score]) as s from best where k = 1),
m as (select query_id, what, median(s) as m, from c group by all),
d as (select query_id, what, any_value(m) as m, median(case when s > m then s - m end) as u, median(case when s < m then m - s end) as d from c join m using (query_id, what) group by all),
z as (select query_id, node_id, s, coalesce((s - m) / (case when s > m then u when s < m then d end * 1.4826::double), 0.0::double) as z from c left join d using (query_id, what)),
f as (select query_id, node_id, exp(avg(case when s is null then null when z < -30 then z else -ln(1 + exp(-z)) end)) as fused from z group by all)
"""

P3 = f"""
with t as materialized (select id, unnest({_TOKENS}) as term from pages),
tf as materialized (select id, term, count(*) as tf from t group by all), n as (select id, count(*) as n from t group by id),
s as (select term, count(*) as df, sum(tf) as cf from tf group by term), total as (select count(*)::double as total from t),
w as (select tf.id, term, tf, df, (tf + 500.0::double * cf / total) / (n + 500.0::double) as pd, cf / total as pc from tf join s using (term) join n on n.id = tf.id, total)
"""

P4 = f"""
with t as (select id, {_TOKENS} as t from pages where id is not null), k as (select id, t from t where len(t) >= 50),
s as materialized (select distinct id, hash(array_to_string(t[i : i + 2], ' ')) as h from (select id, t, unnest(range(1, len(t) - 1)) as i from k)),
n as (select id, count(*) as n from s group by id),
p as (select a.id as id_a, b.id as id_b, count(*) as shared from s a join s b on a.h = b.h and a.id < b.id group by all)
select id_a, id_b from p join n x on x.id = id_a join n y on y.id = id_b where shared >= 0.4::double * (x.n + y.n - shared)
"""

P4_CLASSES = f"""
with t as (select id, {_TOKENS} as t from pages where id is not null), k as (select id, t, min(id) over (partition by t) as class from t where len(t) >= 50),
s as materialized (select distinct id, hash(array_to_string(t[i : i + 2], ' ')) as h from (select id, t, unnest(range(1, len(t) - 1)) as i from k where id = class)),
n as (select id, count(*) as n from s group by id),
p as (select a.id as a, b.id as b, count(*) as shared from s a join s b on a.h = b.h and a.id <> b.id group by all),
l as (select a as class, count(*) as links from p join n x on x.id = a join n y on y.id = b where shared >= 0.4::double * (x.n + y.n - shared) group by a)
select id, class, coalesce(links, 0)::bigint as links from k left join l using (class)
"""

P9 = f"""
with d as (select doc_id, {_WORDS} as w from documents), b as (select item_id, {_WORDS} as w from benchmark),
bw as materialized (select distinct item_id, array_to_string(w[i : i + 11], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 10)) as i from b)),
dw as (select doc_id, array_to_string(w[i : i + 11], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from d))
select distinct doc_id, item_id from dw join bw using (g)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_cleaned": P1_CLEANED,
        "p1_found": P1,
        "p1_templates": P1_TEMPLATES,
        "p2_fused": P2 + "select query_id, node_id, round(fused, 9) as fused from f",
        "p2_found": P2 + "select query_id, node_id from (select query_id, node_id, row_number() over (partition by query_id order by fused desc, node_id) as k from f where fused is not null) where k <= 3",
        "p3_found": P3 + "select id, term from w where tf >= 4 and df between 2 and 12",
        "p3_weights": P3 + "select id, term, round(pd * ln(pd / pc), 9) as weight from w where df >= 2",
        "p4_classes": P4_CLASSES,
        "p4_found": P4,
        "p9_found": P9,
    }
