"""Text functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits and underscore of any script; Java's \w is ASCII only.
TOKEN = r"[\p{L}\p{N}_]+"
#: Unicode white space, as Python's `\s` and `strip` see it.
SPACE = r"[\s\x1C-\x1F\x{85}\p{Z}]"
SNIPPET_LENGTH = 220


def tokenize(text: Column) -> Column:
    """Array of tokens, each lower-cased after the split; null for null."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.lower(t))


def tokenize_query(query: str) -> list[str]:
    """The same for a driver-side string."""
    return [t.lower() for t in re.findall(r"\w+", query or "")]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def snippet(text: Column, query: str, max_len: int = SNIPPET_LENGTH) -> Column:
    """`max_len` characters around the earliest hit of a query word (split at white space, matched as substring)."""
    terms = query.lower().split()
    low = F.lower(text)
    hits = [F.when(F.instr(low, t) > 0, F.instr(low, t)) for t in terms]
    pos = (F.least(*hits) if len(hits) > 1 else hits[0]) - 1 if hits else F.lit(None).cast("int")
    start = F.greatest(F.lit(0), pos - max_len // 3)
    end = F.least(F.length(text), start + max_len)
    cut = F.concat(
        F.when(start > 0, "… ").otherwise(""), strip(F.substring(text, start + 1, F.lit(max_len))), F.when(end < F.length(text), " …").otherwise("")
    )
    head = F.concat(F.substring(text, 1, max_len), F.when(F.length(text) > max_len, "…").otherwise(""))
    return F.when(F.coalesce(text, F.lit("")) == "", "").when(pos.isNull(), head).otherwise(cut)


def idf(df: Column, n_docs: Column) -> Column:
    return F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + df)) + F.lit(1.0)


def min_max(score: Column, low: Column, high: Column) -> Column:
    """(score - low) / (high - low); 0 where all scores are equal."""
    return (score - low) / F.when(high > low, high - low).otherwise(F.lit(1.0))
