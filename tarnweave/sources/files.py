"""Readers with fixed schemas: edge lists, page and rank JSON, rank reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave import schemas

#: The format of a report line, and of the header before the ranking.
REPORT_LINE = r"node\s+(\d+)\s*:\s*([0-9.eE+-]+)"
REPORT_HEADER = r"Top[^\n]*nodes by PageRank"
_EDGE = r"^\s*(-?\d+)\s+(-?\d+)\s*$"


def parse_edge_lines(lines: DataFrame) -> DataFrame:
    """`src, dst, bad` of text lines (column value); blank lines are skipped, `bad` holds what is no pair of ids >= 0."""
    text = lines.where("trim(value) != ''")
    src, dst = (F.expr(f"try_cast(regexp_extract(value, '{_EDGE.replace(chr(92), chr(92) * 2)}', {g}) as bigint)") for g in (1, 2))
    pairs = text.select(src.alias("src"), dst.alias("dst"), "value")
    ok = F.coalesce((F.col("src") >= 0) & (F.col("dst") >= 0), F.lit(False))
    return pairs.select(F.when(ok, F.col("src")).alias("src"), F.when(ok, F.col("dst")).alias("dst"), F.when(~ok, F.col("value")).alias("bad"))


def read_edges(spark: SparkSession, path: str, on_error: str = "fail") -> DataFrame:
    """Edge list, `src dst` a line. A bad line raises when it is read; with on_error='skip' it is left out, see `read_bad_edges`."""
    rows = parse_edge_lines(spark.read.text(path))
    if on_error == "skip":
        return rows.where("bad is null").drop("bad")
    if on_error != "fail":
        raise ValueError("on_error is fail or skip")
    checked = F.when(F.col("bad").isNotNull(), F.raise_error(F.concat(F.lit("not an edge: "), F.col("bad"))).cast("bigint")).otherwise(F.col("src"))
    return rows.select(checked.alias("src"), "dst")


def read_bad_edges(spark: SparkSession, path: str) -> DataFrame:
    """The lines that `read_edges` skips."""
    return parse_edge_lines(spark.read.text(path)).where("bad is not null").select("bad")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """JSON array or JSON lines; a missing file is an error."""
    return _read_json(spark, path, schemas.PAGES)


def _read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    first = spark.read.text(path).where("trim(value) <> ''").first()
    array = first is not None and first["value"].lstrip().startswith("[")
    return spark.read.schema(schema).option("multiLine", array).json(path)


def read_pagerank(spark: SparkSession, path: str) -> DataFrame:
    """As `read_pages`; a missing file gives an empty table, so that all ranks count 0."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], schemas.PAGERANK)
    return _read_json(spark, path, schemas.PAGERANK)


def parse_report(reports: DataFrame, anchored: bool = False) -> DataFrame:
    """`id, score` of a rank report.

    `reports` holds a line a row; `anchored`, a whole report a row, of which only the lines below the header count, and only those that hold
    nothing else.
    """
    pattern = rf"^\s*{REPORT_LINE}\s*$" if anchored else REPORT_LINE
    lines = reports
    if anchored:
        below = F.regexp_extract("value", rf"(?s)^(?:.*?\n)?{REPORT_HEADER}[^\n]*\n(.*)$", 1)
        lines = reports.select(F.explode(F.split(below, "\n")).alias("value"))
    rows = lines.where(F.col("value").rlike(pattern))
    score = F.regexp_extract("value", pattern, 2).try_cast("double")
    return rows.select(F.regexp_extract("value", pattern, 1).cast("long").alias("id"), score.alias("score")).where("score is not null")


def read_report(spark: SparkSession, path: str, anchored: bool = False) -> DataFrame:
    return parse_report(spark.read.text(path, wholetext=anchored), anchored)
