"""Schemas of the tables and files this library reads and writes."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType


def _schema(**columns) -> StructType:
    return StructType([StructField(k, v(), True) for k, v in columns.items()])


EDGES = _schema(src=LongType, dst=LongType)
URL_EDGES = _schema(source_url=StringType, target_url=StringType)
PAGES = _schema(id=LongType, url=StringType, text=StringType)
PAGERANK = _schema(id=LongType, url=StringType, score=DoubleType)
RANKS = _schema(id=LongType, rank=DoubleType)
SNAPSHOT = _schema(url=StringType, status=LongType, content_type=StringType, html=StringType)
EDGE_CSV = _schema(source=StringType, target_id=LongType)
