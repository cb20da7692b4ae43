"""Problem 7: the main body of a page among what its site puts around it.

Pages come as text, so the tree is rebuilt from it: the page is the body, runs of lines between blank lines are its
sections, lines are the leaves, and a line's pieces (labels of a menu, items of a tag list) are its tags. What a DOM
knows as link text is a line's graded link share. No phrases are listed; four signals strengthen each other: the form of the line
(arrows, ranks), labels between separators, the share of its site's pages that have the line, and the share of those
that have its opening (what stands before a colon or a separator) as an opening, a label or a line. Shares are counted by a grouped aggregation.
Bylines and editors' notes are text of their own however often they are repeated.

Each node gets the composite text density: link-adjusted characters per tag. Densities of lines are summed, and the least
density on the way from the section with the greatest sum to the body is the threshold. A line is kept if its own
density reaches it; of a line shorter than that node's mean the part is asked that its length is of the mean, as
headings and bylines are short. No signal keeps or drops a line by itself.

One scan of the texts encodes their words, one of these writes hashes and sizes of the lines; counts and verdicts come from these.
"""

from __future__ import annotations

import math
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.functions.urls import site
from tarnweave.llm import residue
from tarnweave.llm.arrow import Memo, flat, map_batches, ragged
from tarnweave.llm.furniture import form, may_open
from tarnweave.llm.words import PACKED, Words, encoded, unpack
from tarnweave.session import BROADCAST_ROWS, cut, cut_counted

#: Density a character that a line needs on any page, even if nothing on it is denser.
LEAST = 0.1
#: Link share that form, labels, and repetition on FULL or more of the site's pages give by themselves.
FORM, LABELS, REPEATED = 0.8, 0.8, 0.9
FULL = 0.1
#: What floating point may take from a bound.
SLACK = 1e-12
KINDS = ("text", "byline", "repeated", "menu", "form")
#: Lines and openings on fewer pages of their site, or on a smaller share of them, count as not repeated: copies of a page share lines too.
MIN_PAGES, MIN_SHARE = 10, 0.01
#: Characters of an opening or a label at most; words of an opening before a dash at least, as names stand there, too.
OPENING, DASH_WORDS = 24, 3
_PIECES, _MORE_PIECES = (",", ";", " – ", " - "), ("|", "·", "•", "›", "»", "/")
_SEPARATOR = re.compile(r"[|·•›»>:/]")
_LABELS = re.compile(r"[|·•›»]|\s[/>]\s")
_OPENINGS = re.compile(r"[|·•›»>:]|\s/\s")
_DASH = re.compile(r"\s[–-]\s")
_DIGITS = re.compile(r"\d+")


def densities(chars: np.ndarray, tags: np.ndarray, link_chars: np.ndarray, link_tags: np.ndarray, body_chars: np.ndarray, body_link_chars: np.ndarray) -> np.ndarray:
    """Composite text density of each node; 0 for a node that is all link text."""
    base = np.log(chars / np.maximum(1.0, chars - link_chars) * link_chars + body_link_chars / np.maximum(1.0, body_chars) * chars + math.e)
    value = chars / np.maximum(0.5, link_chars) * tags / np.maximum(1.0, link_tags)
    found = chars / tags * np.log(np.maximum(1.0, value)) / np.log(np.maximum(base, 1.0001))
    return np.where((chars <= 0) | (link_chars >= chars), 0.0, found)


def labels(line: str) -> float:
    """Share of a line's characters in labels of at most three words, if separators cut it into three pieces or more."""
    found = [x for x in map(str.strip, _LABELS.split(line)) if x]
    if len(found) < 3:
        return 0.0
    return sum(len(x) for x in found if len(x.split()) <= 3) / sum(map(len, found))


def pieces(line: str) -> tuple[str, list[str]]:
    """Of a normalised line: its opening, or '', and its labels, short ones only."""
    if _SEPARATOR.search(line):
        found = [x for x in map(str.strip, _OPENINGS.split(line)) if x]
        if len(found) > 1:
            return found[0] if len(found[0]) <= OPENING else "", [x for x in found if len(x) <= OPENING]
    dash = _DASH.search(line, 0, OPENING + 2)
    if dash and line.count(" ", 0, dash.start()) >= DASH_WORDS - 1:
        return line[: dash.start()], [line[: dash.start()]]
    return "", []


#: Numbers of a line: number, section, characters, tags, and its link share by itself: twice the thousandths, one more if labels say most, -1 for a byline.
FIELDS = 5
LINES = {"lines": "ids", "hashes": "longs", "openings": "longs", "labels": "longs"}


def _clean(word: str) -> str:
    return _DIGITS.sub("0", word.lower())


def _odd(word: str) -> bool:
    """Whether a line with the word may have pieces, or be a byline, for what isn't in its first word."""
    return _SEPARATOR.search(word) is not None or word in ("–", "-") or word.lower() == "staff"


class Reader:
    """Reads the lines of texts. Most are plain: their numbers are sums over their words. What is known of the others, and of words, is kept, in bounds."""

    def __init__(self) -> None:
        self.line = Memo(self._line, 50_000)
        self.hash = Memo(lambda w: xxhash.xxh3_64_intdigest(_clean(w)))
        self.odd, self.first, self.tags = Memo(_odd), Memo(may_open), Memo(lambda w: sum(map(w.count, ",;")))
        self.pieces: dict[str, int] = {}

    @staticmethod
    def _line(line: str) -> tuple[int, int, str, list[str]]:
        """Of a line: tags, link share, opening and labels."""
        share, kind = form(line)
        low = _clean(line)
        parted = _SEPARATOR.search(line)
        opening, short = pieces(low) if parted or " – " in line or " - " in line else ("", [])
        shape, menu = FORM * share, LABELS * labels(line) if parted else 0.0
        link = -1 if kind == "byline" else 2 * round(1000 * (1.0 - (1.0 - shape) * (1.0 - menu))) + (menu > shape)
        return 1 + sum(map(line.count, _PIECES)) + (sum(map(line.count, _MORE_PIECES)) if parted else 0), link, opening, short

    def _hashed(self, found: set[str]) -> dict[str, int]:
        """Of openings and labels, the hashes that they have as lines."""
        if len(self.pieces) > 300_000:
            self.pieces = {}
        new = [x for x in found if x not in self.pieces]
        if new:
            self.pieces.update(zip(new, Words.of(new).hashes(xxhash.xxh3_64_intdigest).tolist(), strict=True))
        return self.pieces

    def read(self, words: Words) -> list[pa.Array]:
        """The columns LINES names, a row per page."""
        each = np.bincount(words.page, minlength=words.pages)
        first = np.cumsum(each) - each
        blank = words.number - np.arange(len(words.page)) + first[words.page]  # blank lines of the page before it
        hashes = words.hashes(self.hash.__getitem__)
        chars = words.by_line(words.told(len, np.int64)) + words.size - 1
        tags, link, openings = 1 + words.by_line(words.told(self.tags.__getitem__, np.int64)), np.zeros(len(chars), np.int64), np.zeros(len(chars), np.int64)
        special = words.by_line(words.told(self.odd.__getitem__, np.int64)) > 0
        special |= words.told(self.first.__getitem__, bool)[words.tokens[words.start]]
        at = np.flatnonzero(special)
        # lines of one hash may differ in the case of letters and in numbers
        texts = words.hashes(xxhash.xxh3_64_intdigest)[at]
        lines, of = np.unique(texts, return_index=True, return_inverse=True)[1:]
        found = [self.line[words.text(words.start[k], words.end[k])] for k in at[lines].tolist()]
        known = self._hashed({x for got in found for x in (got[2], *got[3]) if x})
        tags[at], link[at], openings[at] = (np.array(x, np.int64)[of] for x in ([got[0] for got in found], [got[1] for got in found], [known[got[2]] if got[2] else 0 for got in found]))
        short = [[known[x] for x in got[3]] for got in found]
        names = np.fromiter(chain.from_iterable(short[k] for k in of.tolist()), np.int64)
        named = np.bincount(words.page[at], np.array(list(map(len, short)), np.int64)[of], words.pages)
        return [ragged(np.column_stack([words.number, blank, chars, tags, link]), FIELDS * each, np.int32), ragged(hashes, each, np.int64), ragged(openings, each, np.int64), ragged(names, named, np.int64)]

    def __call__(self, text: str | None) -> tuple[list[int], list[int], list[int], list[int]]:
        return tuple(column[0].as_py() for column in self.read(Words.of([text])))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first, axis=0) if len(first) else values[:0]


def verdicts(page: np.ndarray, lines: np.ndarray, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per line, of pages one after another: is it main body, and its kind in KINDS; `lines` has FIELDS columns, `repeated` is the share of the site's pages that have the line, or its opening if that is more."""
    _, section, chars, tags, link = lines.T
    plain = (link < 0) | ((link == 0) & (repeated == 0))
    again, own = REPEATED * np.minimum(1.0, repeated / FULL) ** 0.5, (link >> 1) / 1000
    share = np.where(plain, 0.0, 1.0 - (1.0 - own) * (1.0 - again))
    kind = np.where(plain, np.where(link < 0, 1, 0), np.where(again > own, 2, np.where(link & 1, 3, 4)))
    tags = np.where(plain, 1, tags)
    leaves = np.column_stack([chars, tags, chars * share, tags * share])
    starts = np.diff(page, prepend=-1) != 0
    first = np.flatnonzero(starts | (np.diff(section, prepend=-1) != 0))
    nodes, of = _sums(leaves, first), page[first]
    pages = np.flatnonzero(np.diff(of, prepend=-1))
    whole = _sums(nodes, pages)
    tree = np.concatenate([leaves, nodes, whole])
    rank = np.cumsum(starts) - 1  # of the line's page among those that have lines
    total, linked = (np.concatenate([x[rank], x[rank[first]], x]) for x in (whole[:, 0], whole[:, 2]))
    d = densities(*tree.T, total, linked)
    d, in_nodes, in_whole = np.split(d, [len(leaves), len(leaves) + len(nodes)])
    sums = _sums(d, first)
    order = np.lexsort((np.arange(len(first)), -sums, of))
    best = order[pages]  # the first one of a page's greatest sum
    size_best, size_whole = nodes[best, 0] / nodes[best, 1], whole[:, 0] / whole[:, 1]
    lower = (in_nodes[best] < in_whole) | ((in_nodes[best] == in_whole) & (size_best < size_whole))
    threshold, mean = np.where(lower, in_nodes[best], in_whole), np.where(lower, size_best, size_whole)
    size = chars / tags
    least = np.maximum(threshold[rank] * np.minimum(1.0, size / mean[rank]), LEAST * size)
    return (whole[rank, 2] == 0) | (d >= least * (1 - SLACK)), kind


def body_lines(lines: list[int], repeated: list[float] | None = None) -> list[tuple[int, bool, str]]:
    """`(line number, is main body, kind)` of each line of a page, from what `Reader` gives; `repeated` as in `verdicts`."""
    rows = np.array(lines, np.int64).reshape(-1, FIELDS)
    main, kind = verdicts(np.zeros(len(rows), np.int64), rows, np.array(repeated or [0.0] * len(rows)))
    return [(k, m, KINDS[x]) for k, m, x in zip(rows[:, 0].tolist(), main.tolist(), kind.tolist(), strict=True)]


def _judged(lines: pa.Array, repeated: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per line: its page, its number, is it main body, and its kind."""
    values, sizes = flat(lines)
    shares, given = flat(repeated)
    page = np.repeat(np.arange(len(sizes)), sizes // FIELDS)
    share = np.zeros(len(page))
    share[np.repeat(given > 0, sizes // FIELDS)] = shares.to_numpy(zero_copy_only=False)
    rows = values.to_numpy(zero_copy_only=False).reshape(-1, FIELDS).astype(np.int64)
    return page, rows[:, 0], *verdicts(page, rows, share)


def _measured(pages: DataFrame, model: residue.ResidueModel | None, skip_residue: bool, id_col: str, url_col: str, text_col: str, keep_text: bool) -> DataFrame:
    """One row per page: `<id_col>, site, skip`, the numbers of its lines, and the shares of its site's pages that have them and their openings."""
    at = F.coalesce(site(F.col(url_col)), F.lit("")) if url_col in pages.columns else F.lit("")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), at.alias("site"), residue.labelled(pages, text_col, "lang").alias("label"), F.col(text_col).alias("text"))
    schema = {id_col: "long", "site": "string", "skip": "boolean", **LINES} | ({"text": "string"} if keep_text else {})
    if not keep_text:
        rows = encoded(rows, {"id": "long", "site": "string", "label": "string"})
        if skip_residue and model is None:
            model = residue.learn(rows)
    shared = pages.sparkSession.sparkContext.broadcast(model if skip_residue else None)

    def read(reader, ids, sites, words, *more):
        m = shared.value
        skip = m.judge_words(words)[0] if m else np.zeros(words.pages, bool)
        return [ids, sites, skip, *reader.read(words), *more]

    def read_texts(batches):
        reader = Reader()
        for ids, sites, texts in batches:
            yield read(reader, ids, sites, Words.of(texts), texts)

    def read_words(batches):
        reader = Reader()
        for (ids, sites), words in unpack(batches):
            yield read(reader, ids, sites, words)

    rows = cut(map_batches(rows.select("id", "site", "text"), read_texts, schema) if keep_text else map_batches(rows.select("id", "site", *PACKED), read_words, schema))
    totals = rows.groupBy("site").agg(F.count(F.lit(1)).alias("of")).where(F.col("of") >= MIN_PAGES)
    each = rows.select("site", F.explode(F.array_union("hashes", "labels")).alias("hash"))
    counts = each.groupBy("site", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_PAGES)
    often, seen = cut_counted(counts.join(totals, "site").where(F.col("n") >= MIN_SHARE * F.col("of")).select("site", "hash", (F.col("n") / F.col("of")).alias("share")))
    # at most (lines and labels of a page) / MIN_SHARE entries a site
    known = often.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("hash", "share"))).alias("known"))
    rows = rows.join(F.broadcast(known) if seen["rows"] <= BROADCAST_ROWS else known, "site", "left")
    share = lambda x: F.coalesce(F.element_at("known", x), F.lit(0.0))
    repeated = F.when(F.col("known").isNotNull(), F.zip_with("hashes", "openings", lambda x, y: F.greatest(share(x), F.when(y != 0, share(y)))))
    return rows.select(id_col, "skip", "lines", repeated.alias("repeated"), *(["text"] if keep_text else []))


def furniture_lines(pages: DataFrame, model: residue.ResidueModel | None = None, *, skip_residue: bool = True, id_col: str = "id", url_col: str = "url", text_col: str = "text") -> DataFrame:
    """`<id_col>, line_no, kind` of lines that aren't main body; lines count from 0, blank lines never come out.

    Pages that are cases of problem 5 are left out unless `skip_residue` is false; they count where lines are counted. Null and empty texts
    give no rows; repeated rows repeat; null ids are kept; other columns are ignored; an empty table gives no rows. Pages without a
    URL, and all without `url_col`, count as one site.
    """
    def find(batches):
        for ids, lines, repeated in batches:
            page, number, main, kind = _judged(lines, repeated)
            out = np.flatnonzero(~main)
            yield [ids.take(pa.array(page[out])), number[out], [KINDS[k] for k in kind[out].tolist()]]

    rows = _measured(pages, model, skip_residue, id_col, url_col, text_col, False).where("not skip").drop("skip")
    return map_batches(rows, find, {id_col: "long", "line_no": "long", "kind": "string"}, (id_col, "lines", "repeated"))


def main_body(pages: DataFrame, *, id_col: str = "id", url_col: str = "url", text_col: str = "text") -> DataFrame:
    """`<id_col>, text`: each page's text with only the lines of the main body; null stays null, one row per row."""

    def keep(batches):
        for ids, _, lines, repeated, texts in batches:
            page, number, main, _ = _judged(lines, repeated)
            numbers = np.split(number[main], np.cumsum(np.bincount(page[main], minlength=len(texts)))[:-1])
            out = []
            for kept, t in zip(numbers, texts, strict=True):
                raw = t.split("\n") if t is not None else None
                out.append(None if raw is None else "\n".join([raw[k] for k in kept.tolist()]))
            yield [ids, out]

    return map_batches(_measured(pages, None, False, id_col, url_col, text_col, True), keep, {id_col: "long", text_col: "string"}, ("lines", "repeated"))
