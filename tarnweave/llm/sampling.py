"""What is learned from pages, balanced by declared language: counts over all pages, and a bounded sample."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnweave.llm.arrow import map_batches
from tarnweave.llm.words import PACKED, Words, unpack

#: Characters of a sampled text that reach the driver, on average over its lines: longer texts give a share of their lines, drawn by hash.
SAMPLE_CHARS = 20_000
#: Pages of a label that count in full: a label of more weighs as much as so many, all of its pages alike.
LABEL_PAGES = 400
#: Entries that a task holds before it hands them on.
HELD = 500_000


def known_label(pages: DataFrame, labels: list[str], label_col: str) -> Column:
    """First two letters of the label if they are among `labels`, else ''."""
    label = F.lower(F.substring(F.trim(F.col(label_col)), 1, 2)) if label_col in pages.columns else F.lit(None).cast("string")
    return F.when(label.isin(*labels), label).otherwise("")


def label_weights(pages: dict[str, int]) -> dict[str, float]:
    """By the numbers of pages of the labels, what one of its pages weighs."""
    return {k: min(1.0, LABEL_PAGES / n) for k, n in pages.items()}


def count_all(rows: DataFrame, count: Callable[[dict[str, Counter], list[str | None], Words], None], expand: Callable[[Counter], dict[str, int]] = Counter) -> dict[str, Counter]:
    """Counters by label, over all pages of an encoded table (`words.encoded`) of the column `label`.

    `count` adds pages to the counters of their labels; `expand` makes of a counter the one that is added up and reaches the driver.
    """

    def run(batches) -> Iterator[list]:
        held: dict[str, Counter] = {}

        def out():
            for label, counter in held.items():
                found = expand(counter)
                yield [[label] * len(found), list(found), list(found.values())]
            held.clear()

        for (labels,), words in unpack(batches):
            count(held, labels, words)
            if sum(map(len, held.values())) > HELD:
                yield from out()
        yield from out()

    counted = map_batches(rows.select("label", *PACKED), run, {"label": "string", "what": "string", "n": "long"}).groupBy("label", "what").agg(F.sum("n").alias("n")).toArrow()
    total: dict[str, Counter] = {}
    for label, what, n in zip(*(counted[c].to_pylist() for c in ("label", "what", "n")), strict=True):
        total.setdefault(label, Counter())[what] = n
    return total


def weighted(counters: dict[str, Counter], weights: dict[str, float]) -> Counter:
    """The sum over labels, in a fixed order, so that the same counts give the same sum."""
    out: Counter = Counter()
    for label in sorted(counters):
        for what, n in counters[label].items():
            out[what] += n * weights[label]
    return out


def balanced_sample(pages: DataFrame, labels: list[str], *, id_col: str, text_col: str, label_col: str, sample_pages: int, others: bool, sample_chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """`(label, text)` of at most `sample_pages` pages with text, as many of each label; with `others`, unknown labels are one more.

    Labels are counted first; a page is drawn if the hash of its id is below its label's share, so no page is moved or ranked
    but those that are drawn. The same table gives the same sample.
    """
    known = known_label(pages, labels, label_col)
    rows = pages.where(F.length(text_col) > 0).select(known.alias("label"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1 << 30)).alias("h"))
    if not others:
        rows = rows.where("label <> ''")
    each = sample_pages // (len(labels) + others)
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    # a tenth more than wanted, for what is drawn varies; the least hashes are kept
    drawn = [(k, int(min(1.0, (1.1 * each + 30) / n) * (1 << 30))) for k, n in counts.items()]
    if not drawn:
        return []
    below = F.lit(0)
    for k, limit in drawn:
        below = F.when(F.col("label") == k, limit).otherwise(below)
    lines = F.split("text", "\n")
    stride = F.ceil(F.length("text") / sample_chars)
    part = F.when(stride <= 1, F.col("text")).otherwise(F.array_join(F.filter(lines, lambda x: F.pmod(F.xxhash64(x), stride) == 0), "\n"))
    found = rows.where(F.col("h") < below).select("label", "h", part.alias("text")).collect()
    out, taken = [], dict.fromkeys(counts, 0)
    for r in sorted(found, key=lambda r: (r["label"], r["h"], r["text"])):
        if taken[r["label"]] < each:
            taken[r["label"]] += 1
            out.append((r["label"], r["text"]))
    return out
