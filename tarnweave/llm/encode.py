"""Problem 8: encode a corpus with a public byte-level BPE vocabulary.

All words of the corpus are counted (partial sums per task); the most frequent ones are compiled with their ids into
a minimal acyclic transducer, which executors fetch once and memory-map. A word outside of the lexicon is merged
exactly, so the ids never depend on the lexicon. Null and empty texts get an empty list.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from collections import Counter
from functools import lru_cache

import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.llm.arrow import Memo, map_batches
from tarnweave.llm.transducer import Transducer, compile_words
from tarnweave.session import publish

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokenisation of the byte-level BPE vocabulary (fixed value of the public tokenizer).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEXICON_WORDS = 60_000
WORD_BYTES = 48
FLUSH = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merging: again and again the leftmost pair of lowest rank. O(n log n), so long runs are no problem."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n = len(word)
    start, after, before = list(range(n)), [*range(1, n + 1)], [*range(-1, n - 1)]
    end = [*range(1, n + 1)]
    alive = [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (r := ranks.get(word[start[i] : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[i], end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or end[i] != mid or j >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i], after[i] = stop, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[start[i] : end[i]]])
        i = after[i]
    return out


def frequent_words(texts: DataFrame, text_col: str, limit: int) -> list[str]:
    """The `limit` most frequent pre-tokens of all texts, ties by the word; longer than WORD_BYTES never."""

    def count(batches):
        split, seen = regex.compile(PATTERN).findall, Counter()
        for (column,) in batches:
            for t in column:
                if t:
                    seen.update(split(t))
            if len(seen) > FLUSH:
                yield [list(seen), list(seen.values())]
                seen = Counter()
        yield [list(seen), list(seen.values())]

    parts = map_batches(texts.select(text_col), count, {"word": "string", "n": "long"})
    words = parts.where(F.octet_length("word") <= WORD_BYTES).groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in words.orderBy(F.desc("n"), "word").limit(limit).select("word").collect()]


@lru_cache(maxsize=4)
def _open(name: str) -> Transducer:
    return Transducer(SparkFiles.get(name))


def encode_corpus(texts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """`<id_col>, ids`: one row per row of `texts`, ids without special tokens (their strings are ordinary text).

    Null and empty texts give []. Repeated rows and null ids are kept; other columns are ignored; an empty table gives
    an empty result. `vocabulary` is read on the driver only.
    """
    spark = texts.sparkSession
    ranks = read_ranks(vocabulary)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    lexicon = [(w.encode(), merge(w.encode(), ranks)) for w in frequent_words(texts, text_col, lexicon_words)]
    spark.sparkContext.addFile(publish(spark, compile_words(lexicon), name))
    shared = spark.sparkContext.broadcast(ranks)  # its size is the vocabulary's

    def encode(batches):
        split, known = regex.compile(PATTERN).findall, _open(name)

        def ids_of(word: str) -> list[int]:
            raw = word.encode("utf-8", "surrogatepass")
            found = known.get(raw) if len(raw) <= WORD_BYTES else None
            return merge(raw, shared.value) if found is None else found

        memo = Memo(ids_of)
        for keys, column in batches:
            out = []
            for t in column:
                ids: list[int] = []
                for w in split(t) if t else ():
                    ids += memo[w] if len(w) <= WORD_BYTES else ids_of(w)
                out.append(ids)
            yield [keys, out]

    return map_batches(texts.select(F.col(id_col).cast("long").alias(id_col), text_col), encode, {id_col: "long", "ids": "ids"})
