"""Texts as numbers: each text is split into lines and words once, and what reads all pages reads the numbers.

A row of the encoded table holds the pages of about `arrow.SLICE_BYTES` of text: their distinct words, the number of each of their words
among these, and page, line number and size of each line that isn't blank. What is told of a word is told once a row, what is
told of lines and pages are sums over arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tarnweave.llm.arrow import flat, map_batches
from tarnweave.session import cut

#: Columns of the encoded table besides those of the pages, which become lists.
PACKED = {"vocabulary": "string", "tokens": "binary", "lines": "binary"}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Pages' words, split at blanks: `vocabulary`, the number in it of each word (`tokens`), and by line `page`, `number` (of all lines, blank ones too), `size`, `start` and `end`."""

    def __init__(self, pages: int, vocabulary: list[str], tokens: np.ndarray, lines: np.ndarray):
        self.pages, self.vocabulary, self.tokens = pages, vocabulary, tokens
        self.page, self.number, self.size = lines
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size

    @classmethod
    def of(cls, texts: Iterable[str | None]) -> Words:
        flat, page, number, size = [], [], [], []
        p = -1
        for p, text in enumerate(texts):
            for k, line in enumerate(text.split("\n") if text else ()):
                words = line.split()
                if words:
                    flat += words
                    page.append(p)
                    number.append(k)
                    size.append(len(words))
        index = dict.fromkeys(flat)
        vocabulary = list(index)
        index = {w: k for k, w in enumerate(vocabulary)}
        tokens = np.fromiter(map(index.__getitem__, flat), np.int64, len(flat))
        return cls(p + 1, vocabulary, tokens, np.array([page, number, size], np.int64).reshape(3, -1))

    @classmethod
    def of_column(cls, texts: pa.Array) -> Words:
        """`of`, by Arrow's functions, which know the same blanks."""
        lines, of_page = flat(pc.split_pattern(texts, "\n"))
        words, of_line = flat(pc.utf8_split_whitespace(lines))
        some = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # beside blanks at the ends stand empty words
        coded = words.filter(pa.array(some)).dictionary_encode()
        size = np.bincount(np.repeat(np.arange(len(of_line)), of_line)[some], minlength=len(of_line))
        page = np.repeat(np.arange(len(of_page)), of_page)
        number = np.arange(len(page)) - np.repeat(np.cumsum(of_page) - of_page, of_page)
        kept = size > 0
        return cls(len(of_page), coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), np.array([page[kept], number[kept], size[kept]], np.int64))

    def packed(self) -> list:
        kind = np.uint16 if len(self.vocabulary) <= 1 << 16 else np.uint32
        return ["\n".join(self.vocabulary), self.tokens.astype(kind).tobytes(), np.array([self.page, self.number, self.size], np.int32).tobytes()]

    @classmethod
    def unpacked(cls, pages: int, vocabulary: str, tokens: bytes, lines: bytes) -> Words:
        names = vocabulary.split("\n") if vocabulary else []
        kind = np.uint16 if len(names) <= 1 << 16 else np.uint32
        return cls(pages, names, np.frombuffer(tokens, kind).astype(np.int64), np.frombuffer(lines, np.int32).astype(np.int64).reshape(3, -1))

    def told(self, of: Callable, kind: type) -> np.ndarray:
        """What `of` tells of each word of the vocabulary."""
        return np.fromiter(map(of, self.vocabulary), kind, len(self.vocabulary))

    def by_line(self, values: np.ndarray) -> np.ndarray:
        """Sums over the lines' words of `values` of the vocabulary."""
        return np.add.reduceat(values[self.tokens], self.start, axis=0) if len(self.size) else values[:0]

    def by_page(self, values: np.ndarray) -> np.ndarray:
        """Sums over the pages' lines of `values` of the lines."""
        out = np.zeros((self.pages, *values.shape[1:]), values.dtype)
        if len(self.page):
            first = np.flatnonzero(np.diff(self.page, prepend=-1))
            out[self.page[first]] = np.add.reduceat(values, first, axis=0)
        return out

    def line(self) -> np.ndarray:
        """The line of each word."""
        return np.repeat(np.arange(len(self.size)), self.size)

    def text(self, start: int, end: int) -> str:
        return " ".join(map(self.vocabulary.__getitem__, self.tokens[start:end].tolist()))

    def hashes(self, of: Callable) -> np.ndarray:
        """A hash of each line's words in their order, from the hashes of 64 bits, without a sign, that `of` gives of words."""
        if not len(self.size):
            return np.zeros(0, np.int64)
        weights = _mixed(np.arange(1, int(self.size.max()) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        place = np.arange(len(self.tokens)) - np.repeat(self.start, self.size)
        return _mixed(np.add.reduceat(self.told(of, np.uint64)[self.tokens] * weights[place], self.start)).view(np.int64)

    def tally(self, tokens: np.ndarray, codes: np.ndarray, n: int) -> Iterator[tuple[int, str, int]]:
        """`code, word, times` of words that come with a code of 0 to `n` - 1."""
        size = len(self.vocabulary)
        counts = np.bincount(codes * size + tokens, minlength=n * size)
        found = np.flatnonzero(counts)
        for key, times in zip(found.tolist(), counts[found].tolist(), strict=True):
            yield key // size, self.vocabulary[key % size], times


def codes(labels: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The distinct labels, and the number of each one among these; null is -1."""
    names = sorted({x for x in labels if x is not None})
    index = {x: k for k, x in enumerate(names)} | {None: -1}
    return names, np.fromiter(map(index.__getitem__, labels), np.int64, len(labels))


def encoded(pages: DataFrame, columns: dict[str, str]) -> DataFrame:
    """`pages` (`columns` of these kinds, and `text`), written once in the shared folder."""

    def run(batches):
        for *rest, texts in batches:
            yield [*([x] for x in rest), *([x] for x in Words.of_column(texts).packed())]

    return cut(map_batches(pages.select(*columns, "text"), run, {k: f"{kind}s" for k, kind in columns.items()} | PACKED, ("text",)))


def unpack(batches: Iterable[list]) -> Iterator[tuple[list[list], Words]]:
    """The pages' columns and words, from batches of an encoded table of one such column at least."""
    for batch in batches:
        for *rest, vocabulary, tokens, lines in zip(*batch, strict=True):
            yield rest, Words.unpacked(len(rest[0]), vocabulary, tokens, lines)
