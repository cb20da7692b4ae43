"""Problem 10: documents of keywords, links, tags or product names instead of sentences.

A text is cut into blocks of about BLOCK_WORDS words at line ends. A block is compressed twice: as it is, and as a form in which links,
numbers and all words of more than three letters are one sign each. The first compresses further if words are repeated, the
second if entries are built alike, whatever their words. Each logarithm is normalised by the median of blocks of the same
language and length, in units of their median absolute deviation, from histograms over all blocks of the collection; norms of a language
are drawn towards those of all by PRIOR_BLOCKS blocks.

A block is stuffed if its redundancy is extreme by itself, or with few sentences or few different pairs of words. Blocks of few sentences form
runs: a run is stuffed if the redundancy of its blocks together (their sum over the root of their number) is extreme, or lower
than CONFIRMED and confirmed by its entries, which are short throughout. A document is a case if more than half of its words
are stuffed.

One scan of the texts writes a few numbers for each block; norms and verdicts come from these.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.llm.arrow import map_batches
from tarnweave.llm.language import label_code
from tarnweave.session import cut

#: A block ends at a line end from BLOCK_WORDS // 2 words on, at a blank line from a quarter, inside a line at BLOCK_WORDS.
BLOCK_WORDS = 60
#: Deviations below the median: extreme by itself, with at most PAIRS different pairs of words, and with at most FEW_PAIRS.
ALONE, EXTREME, REPEATING = -6.0, -3.0, -1.5
PAIRS, FEW_PAIRS = 0.66, 0.5
#: Share of words in sentences up to which blocks form runs; redundancy of a run that short entries confirm: -1 finds nineteen of twenty, the rest reads like prose.
SENTENCES, CONFIRMED = 0.3, 2.0
#: Words of a sentence at least, and of an entry on average at most.
SENTENCE_WORDS, ENTRY_WORDS = 5, 9
MIN_WORDS = 25
PRIOR_BLOCKS = 200.0
CLASSES, BINS = 60, 600

_WORD = re.compile(r"[^\W_]+")
_LONG = re.compile(r"[^\W\d_]{4,}")
_DIGITS = re.compile(r"\d+")
_LINK = re.compile(r"<a\s[^>]*>|</a>|\]\([^)\s]*\)|https?://\S+|\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}(?:/\S*)?\b")
_DOT = re.compile(r"[^\W_][.:][a-z/]")  # in every link
_END = re.compile(r"(?<=[^\W\d_])[.!?…]+[\"”»)\]]*(?=\s+[^\d\s]|\s*$)")
_STOP = re.compile(r"[.!?…][\"”»)\]]*\s*$")
_QUOTE = (">", "|", " ", "\t")
_MARKS = ",;|•·#:=/–"


def unwrapped(text: str) -> list[str]:
    """Lines, lower case; a quoted or indented sentence that goes on in the next line is joined again."""
    out: list[str] = []
    quoted = False
    for raw in text.split("\n"):
        line, here = raw.lstrip(">| \t"), raw[:1] in _QUOTE
        if (here or quoted) and line[:1].islower() and " " in out[-1] and not _STOP.search(out[-1]):
            out[-1] += " " + line.lower()
        else:
            out.append(line.lower())
        quoted = here and bool(line)
    return out


def blocks(text: str) -> list[list[str]]:
    """Lists of lines, lower case and with single spaces."""
    out: list[list[str]] = []
    block: list[str] = []
    n = 0
    for line in unwrapped(text):
        words = line.split()
        if not words and n < BLOCK_WORDS // 4:
            continue
        if block and (not words or n + len(words) > BLOCK_WORDS * 4 // 3 and n >= BLOCK_WORDS // 3):
            out.append(block)
            block, n = [], 0
        for k in range(0, len(words), BLOCK_WORDS):
            part = words[k : k + BLOCK_WORDS]
            block.append(" ".join(part))
            n += len(part)
            if n >= BLOCK_WORDS:
                out.append(block)
                block, n = [], 0
        if n >= BLOCK_WORDS // 2:
            out.append(block)
            block, n = [], 0
    if block:
        out.append(block)
    return out


class Measure:
    """Reads blocks; one compressor, emptied after each block, serves all."""

    def __init__(self) -> None:
        self.deflate = zlib.compressobj(1, zlib.DEFLATED, -12, 8)

    def size(self, text: str) -> int:
        return len(self.deflate.compress(text.encode())) + len(self.deflate.flush(zlib.Z_FULL_FLUSH))

    def __call__(self, block: list[str]) -> tuple[float, ...]:
        """`words, length class, log compression ratio, form class, log size of the form by word, words in sentences by word, share of different pairs of words, words by entry`."""
        raw = "\n".join(block)
        words = _WORD.findall(raw)
        n = len(words)
        if not n:
            return (0.0,) * FIELDS
        tokens = raw.count(" ") + len(block)
        form = _DIGITS.sub("0", _LONG.sub("x", _LINK.sub("9", raw) if _DOT.search(raw) else raw)).replace(" ", "").replace("[", "")
        in_sentences = 0
        for line in block:
            for piece in _END.split(line)[:-1]:
                k = piece.count(" ") + (piece[:1] != " ")
                if k >= SENTENCE_WORDS:
                    in_sentences += k
        length = len(raw.encode())
        entries = len(block) + sum(map(raw.count, _MARKS))
        pairs = len(set(zip(words, words[1:], strict=False))) / max(1, n - 1)
        return (float(n), _class(length), math.log(self.size(raw) / length), _class(tokens), math.log(self.size(form) / tokens), in_sentences / n, pairs, n / entries)


#: Numbers of a block, as `Measure` gives them.
FIELDS = 8


def _class(n: int) -> float:
    """Three classes to the doubling."""
    return float(min(CLASSES - 1, int(3 * math.log2(max(8, n)))))


def measured(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """`<id_col>, code, blocks` with FIELDS numbers for each block of a text."""

    def read(batches):
        measure = Measure()
        for ids, codes, texts in batches:
            yield [ids, codes, [[x for b in blocks(t) for x in measure(b)] if t else [] for t in texts]]

    code = label_code(F.col(label_col)).alias("code") if label_col in documents.columns else F.lit(None).cast("string").alias("code")
    return map_batches(documents.select(F.col(id_col).cast("long").alias(id_col), code, text_col), read, {id_col: "long", "code": "string", "blocks": "doubles"})


Norms = dict[tuple[str, int], tuple[float, float, float]]


def compression_norms(rows: DataFrame) -> Norms:
    """Per language (and '' for all) and channel (0: text, 1: form): expected value as a line over the length classes, `(offset, slope, deviation)`.

    From all blocks of `measured`; at most languages * 2 * CLASSES * BINS counts reach the driver.
    """

    def count(batches):
        seen: Counter = Counter()
        for codes, found in batches:
            for c, b in zip(codes, found, strict=True):
                for k in range(0, len(b), FIELDS):
                    if b[k]:
                        seen[(c or "", 0, int(b[k + 1]), _bin(b[k + 2]))] += 1
                        seen[(c or "", 1, int(b[k + 3]), _bin(b[k + 4]))] += 1
        keys = list(seen)
        yield [*([key[j] for key in keys] for j in range(4)), list(seen.values())]

    parts = map_batches(rows.select("code", "blocks"), count, {"code": "string", "channel": "int", "class": "int", "bin": "int", "n": "long"})
    tables: dict[tuple[str, int, int], np.ndarray] = {}
    for r in parts.groupBy("code", "channel", "class", "bin").agg(F.sum("n").alias("n")).collect():
        for code in {r["code"], ""}:
            tables.setdefault((code, r["channel"], r["class"]), np.zeros(BINS))[r["bin"]] += r["n"]
    return fit_norms(tables)


def _bin(value: float) -> int:
    return min(BINS - 1, max(0, int((3 - value) * 100)))


def fit_norms(tables: dict[tuple[str, int, int], np.ndarray]) -> Norms:
    """Lines through the class medians, weighted by the classes' blocks: classes that few sound texts reach don't bend them."""
    out: Norms = {}
    for code, channel in sorted({(c, ch) for c, ch, _ in tables}):
        classes = [(k, h) for (c, ch, k), h in tables.items() if (c, ch) == (code, channel)]
        weight = np.array([h.sum() for _, h in classes])
        x = np.array([float(k) for k, _ in classes])
        fits = np.array([_robust(h) for _, h in classes])
        mean = (weight * x).sum() / weight.sum()
        level = (weight * fits[:, 0]).sum() / weight.sum()
        spread = (weight * (x - mean) ** 2).sum()
        slope = (weight * (x - mean) * (fits[:, 0] - level)).sum() / spread if spread > 0 else 0.0
        main = int(weight.argmax())
        own = np.array([fits[main, 0] - slope * x[main], slope, fits[main, 1]])
        if code:  # '' comes first
            own = (weight.sum() * own + PRIOR_BLOCKS * np.array(out["", channel])) / (weight.sum() + PRIOR_BLOCKS)
        out[code, channel] = tuple(own.tolist())
    return out


def _robust(hist: np.ndarray) -> tuple[float, float]:
    at = 3 - (np.arange(len(hist)) + 0.5) / 100
    mid = at[np.searchsorted(np.cumsum(hist), hist.sum() / 2)]
    off = np.abs(at - mid)
    order = np.argsort(off, kind="stable")
    dev = off[order][np.searchsorted(np.cumsum(hist[order]), hist.sum() / 2)]
    return float(mid), max(0.035, 1.4826 * float(dev))


def stuffed_words(found: list[float], code: str | None, norms: Norms) -> tuple[int, int]:
    """`(stuffed, all)` words of a text, from the numbers of its blocks."""
    rows = np.array(found).reshape(-1, FIELDS)
    rows = rows[rows[:, 0] > 0]
    if not len(rows):
        return 0, 0
    words = rows[:, 0]
    fit = [norms.get((code or "", ch)) or norms["", ch] for ch in (0, 1)]
    z = np.stack([(rows[:, 2 + 2 * ch] - fit[ch][0] - fit[ch][1] * rows[:, 1 + 2 * ch]) / fit[ch][2] for ch in (0, 1)])
    raw, pairs = z[0], rows[:, 6]
    stuffed = (raw <= ALONE) | ((raw <= EXTREME) & ((pairs <= PAIRS) | (rows[:, 5] <= FEW_PAIRS))) | ((raw <= REPEATING) & (pairs <= FEW_PAIRS))
    few = (rows[:, 5] <= SENTENCES) & ~stuffed
    k = 0
    while k < len(few):
        j = k
        while j < len(few) and few[j]:
            j += 1
        if j > k:
            together = z[:, k:j].sum(axis=1).min() / math.sqrt(j - k)
            entries = (rows[k:j, 7] <= ENTRY_WORDS).all()
            stuffed[k:j] = together <= EXTREME or (together <= CONFIRMED and bool(entries))
        k = max(j, k + 1)
    return int(words[stuffed].sum()), int(words.sum())


def stuffed_documents(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """`<id_col>, stuffed, words` of documents more than half of whose words are stuffed.

    Texts of fewer than MIN_WORDS words are none, null and empty ones among them. A null or unknown label takes the norms
    of all languages. Each row is judged by itself; repeated rows repeat, null ids are kept, other columns are
    ignored, an empty table gives no rows.
    """
    rows = cut(measured(documents, id_col=id_col, text_col=text_col, label_col=label_col))
    norms = compression_norms(rows)

    def judge(batches):
        for ids, codes, found in batches:
            out = ([], [], [])
            for i, c, b in zip(ids, codes, found, strict=True):
                bad, n = stuffed_words(b, c, norms)
                if n >= MIN_WORDS and 2 * bad > n:
                    for col, x in zip(out, (i, bad, n), strict=True):
                        col.append(x)
            yield list(out)

    return map_batches(rows, judge, {id_col: "long", "stuffed": "long", "words": "long"})
