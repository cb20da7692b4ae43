"""Problem 9: passages of evaluation items inside training documents.

Spaced seeds: each fixed mask keeps some of SPAN consecutive words and ignores the others; the hash of the kept words
is a seed. Documents and items with an equal seed are compared along that diagonal, tolerating substituted words.
Any SPAN consecutive equal words hit with every mask, so exact passages of min_words >= SPAN words are never missed.
With substitutions the masks keep whole blocks of the SPAN words, in every choice of as many blocks as no substitution
can reach (`covering_masks`): wherever the substitutions stand, one mask avoids them all, so nothing is missed either.

A benchmark of at most MAX_LOCAL_BYTES bytes of text (added up first) is looked up inside the scan: a sorted seed array per
worker, no shuffle at all. A larger one is joined by seed hash: a bitmap of FILTER_BITS bits of the items' seeds goes to all workers, so that of the documents'
seeds only those that some item may have are shuffled; both ways give the same rows.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.llm.arrow import Memo, map_batches
from tarnweave.session import cut, sized

#: For passages with SPAN consecutive equal words.
MASKS = ("110110101101", "101101110011")
SPAN = 12
MAX_LOCAL_BYTES = 8_000_000
FILTER_BITS = 1 << 27
_WORD = re.compile(r"[^\W_]+")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9], dtype=np.uint64)


def _hashes(text: str | None, memo: Memo) -> np.ndarray:
    """64-bit hashes of the words (runs of letters and digits, composed, lower case)."""
    if not text:
        return np.empty(0, np.uint64)
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return np.array([memo[w] for w in _WORD.findall(text.lower())], dtype=np.uint64)


def _memo() -> Memo:
    return Memo(lambda w: xxhash.xxh3_64_intdigest(w))


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """One seed per window of SPAN words; empty for fewer words."""
    n = len(words) - SPAN + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, keep in enumerate(mask):
        if keep == "1":
            out += words[k : k + n] * _ODD[k]
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def overlap(doc: np.ndarray, item: np.ndarray, shift: int, min_words: int, max_subs: int) -> int:
    """Most equal words in a stretch of the diagonal doc[j + shift] = item[j] all of whose windows of `min_words` words differ in at most `max_subs`; 0 if none."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    if hi - lo < min_words:
        return 0
    equal = (doc[lo + shift : hi + shift] == item[lo:hi]).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(equal)])
    good = total[min_words:] - total[:-min_words] >= min_words - max_subs
    if not good.any():
        return 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], good.astype(np.int8), [0]])))
    return int(max(total[b - 1 + min_words] - total[a] for a, b in zip(edges[::2], edges[1::2], strict=True)))


def covering_masks(min_words: int, max_subs: int) -> tuple[str, ...]:
    """Masks of which one at least hits in any `min_words` words with at most `max_subs` substitutions.

    Of the min_words // SPAN disjoint windows one has at most `subs` substitutions, its share of them rounded down.
    The window is cut into subs + 2 blocks (SPAN at most); substitutions touch at most `subs` of these, and each choice
    of the number that is left has its mask. For 2 of 12 words: the six masks that keep two of four blocks of three words.
    """
    subs = max_subs // (min_words // SPAN)
    if subs == 0:
        return MASKS
    blocks = min(subs + 2, SPAN)
    kept = combinations(range(blocks), blocks - subs)
    return tuple("".join("01"[k * blocks // SPAN in keep] for k in range(SPAN)) for keep in kept)


def _best(doc: np.ndarray, item: np.ndarray, pairs: set[int], min_words: int, max_subs: int) -> int:
    return max((overlap(doc, item, s, min_words, max_subs) for s in pairs), default=0)


def leaked_items(documents: DataFrame, items: DataFrame, *, min_words: int = 12, max_subs: int = 0, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", max_local_bytes: int = MAX_LOCAL_BYTES) -> DataFrame:
    """`<id_col>, <item_col>, words`: each document that holds at least `min_words` consecutive words of an item, at most `max_subs` of any `min_words` of them substituted.

    `min_words` is SPAN or more, and `max_subs` less than SPAN for each SPAN words of it. No placement of the
    substitutions is missed (`covering_masks`). Letter case and all that lies between words don't count. Null, empty and short texts
    match nothing. A document and item come out once, however often they meet; repeated document rows repeat. Other
    columns are ignored.
    """
    if min_words < SPAN:
        raise ValueError(f"min_words must be at least {SPAN}")
    if not 0 <= max_subs < min_words // SPAN * SPAN:
        raise ValueError(f"max_subs must be at least 0 and less than {min_words // SPAN * SPAN} for {min_words} words")
    masks = covering_masks(min_words, max_subs)
    docs = documents.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"))
    held = items.select(F.col(item_col).cast("long").alias(item_col), F.col(text_col).alias("text")).where("text is not null")
    schema = {id_col: "long", item_col: "long", "words": "long"}
    if (held.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) <= max_local_bytes:
        memo = _memo()
        ids, texts = [], []
        for r in held.collect():
            if len(h := _hashes(r["text"], memo)) >= SPAN:
                ids.append(r[item_col])
                texts.append(h)
        return map_batches(docs, _scan(ids, texts, masks, min_words, max_subs), schema) if ids else map_batches(docs.limit(0), lambda b: iter(()), schema)
    item_seeds = cut(_seed_rows(held, item_col, masks))
    hits = _seed_rows(docs, id_col, masks, _bitmap(item_seeds)).join(item_seeds, "seed").select(id_col, item_col).distinct()
    both = docs.where("text is not null").join(sized(hits), id_col).withColumnRenamed("text", "doc_text").join(held.withColumnRenamed("text", "item_text"), item_col)

    def verify(batches):
        memo = _memo()
        for keys, its, doc_texts, item_texts in batches:
            out = ([], [], [])
            for k, i, d, t in zip(keys, its, doc_texts, item_texts, strict=True):
                dw, iw = _hashes(d, memo), _hashes(t, memo)
                shifts = set()
                for m in masks:
                    a, b = seeds(dw, m), seeds(iw, m)
                    order = np.argsort(a, kind="stable")
                    low, high = (np.searchsorted(a[order], b, side) for side in ("left", "right"))
                    for j in np.flatnonzero(high > low).tolist():
                        shifts.update((order[low[j] : high[j]] - j).tolist())
                if n := _best(dw, iw, shifts, min_words, max_subs):
                    for c, x in zip(out, (k, i, n), strict=True):
                        c.append(x)
            yield list(out)

    return map_batches(both.select(id_col, item_col, "doc_text", "item_text"), verify, schema)


def _bitmap(seed_rows: DataFrame) -> np.ndarray:
    """One bit for each seed's remainder modulo FILTER_BITS, put together by a grouped aggregation of at most FILTER_BITS // 64 rows."""
    at = F.pmod("seed", F.lit(FILTER_BITS))
    words = seed_rows.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(seed, {FILTER_BITS}) & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def _seed_rows(df: DataFrame, key: str, masks: tuple[str, ...], only: np.ndarray | None = None) -> DataFrame:
    """`key, seed`: the distinct seeds of each text; with `only`, those whose bit is set."""
    shared = df.sparkSession.sparkContext.broadcast(only)

    def rows(batches):
        memo, bits = _memo(), shared.value
        for keys, texts in batches:
            ks, out = [], []
            for k, t in zip(keys, texts, strict=True):
                w = _hashes(t, memo)
                own = np.unique(np.concatenate([seeds(w, m) for m in masks]))
                if bits is not None:
                    at = (own % np.uint64(FILTER_BITS)).astype(np.int64)
                    own = own[(bits[at >> 6] >> (at & 63)) & 1 == 1]
                own = own.view(np.int64)
                out += own.tolist()
                ks += [k] * len(own)
            yield [ks, out]

    return map_batches(df, rows, {key: "long", "seed": "long"})


def _scan(ids: list[int], texts: list[np.ndarray], masks: tuple[str, ...], min_words: int, max_subs: int):
    tables = []
    for m in masks:
        parts = [seeds(t, m) for t in texts]
        seed = np.concatenate(parts)
        order = np.argsort(seed, kind="stable")
        owner = np.concatenate([np.full(len(p), k) for k, p in enumerate(parts)])[order]
        at = np.concatenate([np.arange(len(p)) for p in parts])[order]
        tables.append((m, seed[order], owner, at))

    def scan(batches):
        memo = _memo()
        for keys, column in batches:
            out = ([], [], [])
            for key, t in zip(keys, column, strict=True):
                words = _hashes(t, memo)
                if len(words) < SPAN:
                    continue
                shifts: dict[int, set[int]] = {}
                for m, seed, owner, at in tables:
                    own = seeds(words, m)
                    lo = np.searchsorted(seed, own, "left")
                    for pos in np.flatnonzero((lo < len(seed)) & (seed[np.minimum(lo, len(seed) - 1)] == own)).tolist():
                        k = lo[pos]
                        while k < len(seed) and seed[k] == own[pos]:
                            shifts.setdefault(int(owner[k]), set()).add(pos - int(at[k]))
                            k += 1
                for k, s in shifts.items():
                    if n := _best(words, texts[k], s, min_words, max_subs):
                        for c, x in zip(out, (key, ids[k], n), strict=True):
                            c.append(x)
            yield list(out)

    return scan
