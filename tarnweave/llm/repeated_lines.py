"""Problem 1: lines that a site repeats on many of its documents.

Lines are parsed into templates by fixed-depth token trees. A tree's path is (site, number of tokens, first DEPTH
tokens); a run of digits is a wildcard slot everywhere. Each partition grows its own trees (Spark's partial
aggregation: one small row per path and partition) and the trees are merged by adding the counts of equal paths.
Only paths that cover enough documents can hold a template that does, so everything else is dropped at that point;
inside the surviving leaves the exact templates (all tokens, numbers as wildcards) are counted the same way.

No line group is ever gathered in one task: all counts are sums that combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnweave.functions.urls import site
from tarnweave.session import sized

#: All of Unicode's white space but the line feed.
BLANK = r"[\t\r\x0b\x0c\x1c-\x1f\x{85}\p{Z}]+"
DEPTH = 3


def normalized_lines(text: Column) -> Column:
    """Array of a text's lines, lower-case, white space collapsed and trimmed, each run of digits as `0`."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(text), BLANK, " "), r"\p{Nd}+", "0")
    return F.transform(F.split(flat, "\n"), lambda x: F.trim(x))


def _leaf(site_name: Column, line: Column, depth: int) -> Column:
    n_tokens = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    return F.xxhash64(site_name, n_tokens, F.substring_index(line, " ", depth))


def _paths(lines: DataFrame, depth: int) -> DataFrame:
    """Adds `leaf`, the tree path, and `exact`, the whole template, as 64-bit hashes."""
    return lines.withColumns(
        {
            "leaf": _leaf(F.col("site"), F.col("line"), depth),
            "exact": F.xxhash64(F.lit("line"), "site", "line"),
        }
    )


def _source(pages: DataFrame, id_col: str, url_col: str, text_col: str) -> DataFrame:
    return pages.select(F.col(id_col).alias("id"), site(F.col(url_col)).alias("site"), F.col(text_col).alias("text")).where("site is not null and text is not null")


def line_templates(pages: DataFrame, *, min_pages: int = 4, min_share: float = 0.05, depth: int = DEPTH, id_col: str = "id", url_col: str = "url", text_col: str = "text") -> DataFrame:
    """Templates on at least `min_pages` pages and `min_share` of the pages of a site.

    Returns `site, leaf, exact, template, pages, site_pages`; `template` has `<*>` for numbers. Each row of `pages` is a page;
    rows with null url (or no host in it) or null text count nowhere; an empty text is a page without lines; copies
    count. An empty table gives no rows. Other columns, whatever their names, are ignored.
    """
    src = _source(pages, id_col, url_col, text_col)
    totals = sized(src.groupBy("site").agg(F.count(F.lit(1)).alias("site_pages")).select("site", "site_pages", F.greatest(F.lit(float(min_pages)), F.ceil(F.col("site_pages") * F.lit(min_share) - F.lit(1e-9)).cast("double")).alias("needed")))
    lines = _paths(src.select("site", F.explode(F.array_distinct(normalized_lines(F.col("text")))).alias("line")).where("line != ''"), depth)
    leaves = lines.groupBy("site", "leaf").agg(F.count(F.lit(1)).alias("n"))
    leaves = sized(leaves.join(totals, "site").where("n >= needed").select("leaf"))
    exact = lines.join(leaves, "leaf", "left_semi").groupBy("site", "leaf", "exact").agg(F.count(F.lit(1)).alias("pages"), F.min("line").alias("line"))
    return exact.join(totals, "site").where("pages >= needed").select("site", "leaf", "exact", F.regexp_replace("line", "0", "<*>").alias("template"), "pages", "site_pages")


def repeated_lines(pages: DataFrame, templates: DataFrame, *, depth: int = DEPTH, id_col: str = "id", url_col: str = "url", text_col: str = "text") -> DataFrame:
    """`id, line_no` of each line that one of the `templates` covers; lines count from 0."""
    src = _source(pages, id_col, url_col, text_col)
    lines = src.select("id", "site", F.posexplode(normalized_lines(F.col("text"))).alias("line_no", "line")).where("line != ''")
    keys = sized(templates.select("leaf", "exact"))
    return _paths(lines, depth).join(keys, ["leaf", "exact"], "left_semi").select("id", F.col("line_no").cast("long"))


def slot_templates(pages: DataFrame, *, min_pages: int = 4, min_share: float = 0.05, depth: int = DEPTH, id_col: str = "id", url_col: str = "url", text_col: str = "text") -> DataFrame:
    """One template per leaf that enough pages reach, with `<*>` at each slot whose token differs between its lines.

    Returns `site, leaf, template, pages`; several lines of a page in one leaf count once. A slot is a wildcard iff its least and greatest token differ: both
    combine before the shuffle, so trees of different partitions merge without meeting in one task. Rows and nulls as in `line_templates`.
    """
    src = _source(pages, id_col, url_col, text_col)
    totals = sized(src.groupBy("site").agg(F.count(F.lit(1)).alias("site_pages")))
    own = src.select("site", F.filter(F.array_distinct(normalized_lines(F.col("text"))), lambda x: x != "").alias("lines"))
    leaves = own.select("site", F.explode(F.array_distinct(F.transform("lines", lambda x: _leaf(F.col("site"), x, depth)))).alias("leaf"))
    leaves = leaves.groupBy("site", "leaf").agg(F.count(F.lit(1)).alias("pages"))
    leaves = sized(leaves.join(totals, "site").where((F.col("pages") >= min_pages) & (F.col("pages") >= F.col("site_pages") * min_share)).select("leaf", "pages"))
    lines = own.select("site", F.explode("lines").alias("line")).withColumn("leaf", _leaf(F.col("site"), F.col("line"), depth))
    slots = lines.join(leaves, "leaf").select("site", "leaf", "pages", F.posexplode(F.split("line", " ")).alias("slot", "token"))
    slots = slots.groupBy("site", "leaf", "pages", "slot").agg(F.min("token").alias("low"), F.max("token").alias("high"))
    slots = slots.withColumn("token", F.when((F.col("low") != F.col("high")) | F.col("low").contains("0"), "<*>").otherwise(F.col("low")))
    joined = slots.groupBy("site", "leaf", "pages").agg(F.sort_array(F.collect_list(F.struct("slot", "token"))).alias("t"))
    return joined.select("site", "leaf", F.array_join("t.token", " ").alias("template"), "pages")


def remove_lines(pages: DataFrame, lines: DataFrame, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """`pages` with the lines `(id, line_no)` taken out of the text; other columns and rows stay as they are."""
    gone = lines.groupBy(F.col("id").alias("__id")).agg(F.collect_set(F.col("line_no").cast("int")).alias("__gone"))
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains(F.col("__gone"), i)), "\n")
    out = pages.join(gone, F.col(id_col) == F.col("__id"), "left")
    return out.withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(kept)).drop("__id", "__gone")
