"""Operators with an exact definition: against brute force on fixtures, against SQL on the smallest tables."""

import base64
import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnweave.llm import contamination, distinctive_terms, encode, near_duplicates, queries, repeated_lines, score_fusion, sql
from tarnweave.llm.transducer import Transducer, compile_words
from tests.differential import DATA, compare, connection

VOCABULARY = encode.VOCABULARY


@pytest.mark.parametrize("name", list(sql.oracle_sql()))
def test_against_sql(spark, name):
    compare(spark, connection(), queries.queries()[name], sql.oracle_sql()[name])


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "id long, url string, text string, line string, site int")


# problem 1


def test_repeated_lines(spark):
    rows = [(i, f"https://{'WWW' if i % 2 else 'a'}.Site.test/{i}", f"Own line {chr(97 + i)}\r\n\n Share  it {i} times\t\nShare it 7 times\nfooter") for i in range(5)]
    rows += [(10, "https://other.test/", "footer"), (11, None, "footer"), (12, "https://site.test/", None), (13, "https://site.test/x", ""), (14, "not a url", "footer")]
    table = pages(spark, rows)
    found = repeated_lines.repeated_lines(table, repeated_lines.line_templates(table))
    got = {tuple(r) for r in found.collect()}
    assert got == {(i, k) for i in range(5) for k in (2, 3, 4)}
    text = {r.id: r.text for r in repeated_lines.remove_lines(table, found).collect()}
    assert text[0] == "Own line a\r\n" and text[10] == "footer" and text[12] is None and len(text) == len(rows)
    templates = {r.template for r in repeated_lines.line_templates(table).collect()}
    assert templates == {"share it <*> times", "footer"}
    assert any("<*>" in r.template for r in repeated_lines.slot_templates(table).collect())


def test_repeated_lines_share(spark):
    rows = [(i, "https://s.test/", "rare" if i < 4 else "own " + chr(97 + i % 26) * (i + 1)) for i in range(81)]
    table = pages(spark, rows)
    assert repeated_lines.line_templates(table).count() == 0  # 4 pages are less than 5 % of 81
    assert repeated_lines.line_templates(pages(spark, rows[:80])).count() == 1
    assert repeated_lines.line_templates(pages(spark, [])).count() == 0


# problem 2


def test_fused_scores(spark):
    rng = random.Random(1)
    rows = []
    for q in range(4):
        for i in range(9 + q):
            rows.append((q, i, rng.random(), math.exp(20 * rng.random()), None if i == 3 else rng.gauss(5, 1), 1))
            rows.append((q, i, 0.0, 0.0, 0.0, 0))
    rows += [rows[0], (9, 1, 0.5, 0.5, 0.5, None), (9, 2, None, None, float("nan"), None), (None, None, 1.0, 2.0, 3.0, 1)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "q long, i long, a double, b double, c double, at long, fused string")
    got = {(r.q, r.i): r.fused for r in score_fusion.fused_scores(table, "q", "i", {"a": 1.0, "b": 2.0, "c": 1.0}, at="at").collect()}
    for q in range(4):
        mine = {r[1]: r[2:5] for r in rows if r[0] == q and r[5] == 1}
        for i, scores in mine.items():
            num = den = 0.0
            for k, w in enumerate((1.0, 2.0, 1.0)):
                column = np.array([v[k] for v in mine.values() if v[k] is not None])
                med = np.median(column)
                if scores[k] is not None:
                    side = [abs(x - med) for x in column if (x - med) * (scores[k] - med) > 0]
                    z = (scores[k] - med) / (1.4826 * np.median(side)) if side else 0.0
                    num += w * math.log(1 / (1 + math.exp(-z)))
                    den += w
            assert got[q, i] == pytest.approx(math.exp(num / den))
    assert got[9, 1] == pytest.approx(0.5) and got[9, 2] is None and got[None, None] == pytest.approx(0.5)
    top = score_fusion.top_fused(score_fusion.fused_scores(table, "q", "i", {"a": 1.0}, at="at"), "q", "i", 2)
    assert max(Counter(r.q for r in top.collect()).values()) == 2
    assert score_fusion.fused_scores(table.limit(0), "q", "i", {"a": 1.0}).count() == 0


# problem 3


def test_distinctive_terms(spark):
    texts = {1: "Apple apple_x apple tree", 2: "apple tree", 3: "tree İs", 4: None, 5: "", 6: "٣ rare"}
    table = spark.createDataFrame([(k, v, 7) for k, v in texts.items()], "id long, text string, term int")
    got = {(r.id, r.term): r for r in distinctive_terms.distinctive_terms(table).collect()}
    assert set(got) == {(1, "apple"), (2, "apple"), (1, "tree"), (2, "tree"), (3, "tree")}
    p_c, n = 3 / 10, 4
    p_d = (2 + 500 * p_c) / (n + 500)
    assert got[1, "apple"].weight == pytest.approx(p_d * math.log(p_d / p_c))
    assert {r.term for r in distinctive_terms.distinctive_terms(table, min_tf=2, max_df=2).collect()} == {"apple"}
    assert distinctive_terms.distinctive_terms(table.limit(0)).count() == 0


def test_distinctive_terms_without_broadcast(spark, monkeypatch):
    table = spark.read.parquet(f"{DATA}/pages.parquet")
    key = lambda df: {(r.id, r.term, r.df, round(r.weight, 9)) for r in df.collect()}
    small = key(distinctive_terms.distinctive_terms(table))
    monkeypatch.setattr(distinctive_terms, "BROADCAST_ROWS", 10)
    assert key(distinctive_terms.distinctive_terms(table)) == small


# problem 4


def brute_pairs(texts, threshold=0.4):
    sets = {}
    for i, t in texts:
        words = [w for w in re.findall(r"\w+", (t or "").lower())]
        if i is not None and len(words) >= 50:
            sets[i] = {tuple(words[k : k + 3]) for k in range(len(words) - 2)}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def test_near_duplicates(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    texts = []
    for g in range(12):
        lines = [" ".join(rng.choice(words) for _ in range(14)) for _ in range(9)] + ["one line that every record of this table has at its very end"]
        for k in range(4):
            own = [x if rng.random() > 0.15 * k else " ".join(rng.choice(words) if rng.random() < 0.15 else w for w in x.split()) for x in lines]
            rng.shuffle(own)
            texts.append((10 * g + k, "\n".join(own if k else lines)))
        texts.append((10 * g + 8, "\n".join(lines)))
    texts += [(900, "short text"), (901, None), (902, ""), (None, texts[0][1]), texts[0], (903, "a b " * 40), (904, "A b\n" * 40)]
    table = spark.createDataFrame([(*t, "u") for t in texts], "id long, text string, line string")
    members, links = near_duplicates.near_duplicate_classes(table)
    got = {tuple(r) for r in near_duplicates.expand_pairs(members, links).collect()}
    assert got == brute_pairs(dict(texts).items())
    assert {r["class"] for r in members.where("id = 8").collect()} == {0}
    assert near_duplicates.near_duplicate_classes(table.limit(0))[1].count() == 0


def test_low_threshold_keeps_its_pairs(spark):
    """Pairs just above a low threshold that share two of their five lines: the sketch must not end them."""
    line = lambda *key: " ".join(f"w{x}" for x in random.Random(repr(key)).sample(range(5000), 20))
    texts = [(10 * g + k, "\n".join(line(g, 0 if j < 2 else k + 1, j) for j in range(5))) for g in range(15) for k in range(2)]
    members, links = near_duplicates.near_duplicate_classes(spark.createDataFrame(texts, "id long, text string"), threshold=0.2)
    assert {(r.class_a, r.class_b) for r in links.collect()} == {(10 * g, 10 * g + 1) for g in range(15)}


@pytest.mark.parametrize("threshold", [0.1, 0.2, 0.4, 0.45, 0.7, 0.9])
def test_sketch_loss(threshold):
    p = threshold + (1 - threshold) / (2**near_duplicates.PLANES - 1)
    for n in (20, 64, near_duplicates.BINS):
        least = math.ceil(near_duplicates.sketch_match(threshold, n))
        assert sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(max(0, least))) < 1e-4


def test_sketches():
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 2**64, 300, dtype=np.uint64), rng.integers(0, 2**64, 300, dtype=np.uint64)
    rows = near_duplicates.sketches(np.concatenate([a, np.concatenate([a[:200], b[:100]]), b]), [300, 300, 300])
    bins = [sum(np.unpackbits(r.reshape(near_duplicates.PLANES, -1)[j].view(np.uint8)).astype(int) << j for j in range(near_duplicates.PLANES)) for r in rows]
    for x, hashes in ((bins[0], a), (bins[2], b)):
        for k in range(near_duplicates.BINS):
            own = [h % 2**47 for h in hashes.tolist() if h >> 57 == k]
            assert x[k] == (min(own) % 255 + 1 if own else 0)
    assert 0.35 < (bins[0] == bins[1]).mean() < 0.75 > 0.1 > (bins[0] == bins[2]).mean()


def test_anchors_alone_find_the_pairs(spark):
    """Copies with other line breaks and an edit in every line meet; what is compared grows no faster than the records."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]

    def table(n):
        texts = []
        for g in range(n):
            base = [rng.choice(words) for _ in range(150)]
            other = [rng.choice(words) if k % 25 == 24 else w for k, w in enumerate(base)]
            texts += [(2 * g, "\n".join(" ".join(base[k : k + 15]) for k in range(0, 150, 15))), (2 * g + 1, "\n".join(" ".join(other[k : k + 25]) for k in range(0, 150, 25)))]
        return spark.createDataFrame(texts, "id long, text string")

    compared = []
    for n in (100, 1000):
        src = table(n)
        _, heads, blocks, _ = near_duplicates._classes(src)
        compared.append(near_duplicates.compared(near_duplicates.kept_parts(heads, 0.4, blocks).cache(), blocks).count())
    assert compared[1] <= 12 * compared[0]
    links = {(r.class_a, r.class_b) for r in near_duplicates.near_duplicate_classes(src)[1].collect()}
    assert links <= {(2 * g, 2 * g + 1) for g in range(1000)} and len(links) >= 990, len(links)


def test_frequent_lines_joined_or_shared(spark, monkeypatch):
    body = [" ".join(f"w{(i * 7 + k * k) % 97}x{i}" for k in range(60)) for i in range(60)]
    table = spark.createDataFrame([(i, b + "\nthe same words at the end of each one") for i, b in enumerate(body)] + [(70, "\n".join(["the same words at the end of each one", *body[3].split("\n")]))], "id long, text string")
    run = lambda: {tuple(r) for r in near_duplicates.expand_pairs(*near_duplicates.near_duplicate_classes(table)).collect()}
    first = run()
    monkeypatch.setattr(near_duplicates, "BROADCAST_ROWS", 0)
    assert run() == first == {(3, 70)}


def test_covering_codes():
    rng = np.random.default_rng(2)
    for parts in (0, 1, 2**16, 2**16 + 1, 10**6, 10**7, 10**8, 10**9, 10**13):
        blocks = near_duplicates.cover(parts)
        bits = 12 * blocks[0] + 4 * blocks[1]
        assert 12 <= bits <= 32 and (2**bits >= parts or bits == 32) and near_duplicates.width(blocks) <= 62
        codes = near_duplicates._codes(blocks)
        words = rng.integers(0, 2 ** near_duplicates.width(blocks), 200)
        homes = near_duplicates.home_anchors(words, codes)
        for at, code in codes:
            own = (homes >> at) & (2**code.n - 1)
            assert not code.syndrome(own).any()
            assert max(bin(x).count("1") for x in (own ^ ((words >> at) & (2**code.n - 1))).tolist()) <= code.radius
        flipped = words ^ (np.int64(1) << rng.integers(0, near_duplicates.width(blocks), 200))
        reached = defaultdict(set)
        for k, a in zip(*(x.tolist() for x in near_duplicates.near_anchors(flipped, codes)), strict=True):
            reached[k].add(a)
        assert all(h in reached[k] or h == near_duplicates.home_anchors(flipped[k : k + 1], codes)[0] for k, h in enumerate(homes.tolist()))


# problem 8


def test_encoding(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    reference = tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = ["", None, " ", "Hello  world\n\n!", "a" * 4000, "ab" * 3000, "é ½ ٣٤", "<|endoftext|> it's we'LL", "日本語テスト 😀", "﻿ x\r\n\t", "".join(chr(rng.choice([*range(32, 127), *range(160, 1200), 0x1F600])) for _ in range(3000)), "x" * 70 + " y"]
    table = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)] + [(0, "", 3), (None, "null id", 3)], "doc_id long, text string, ids int")
    for words in (0, 5, 1000):
        rows = encode.encode_corpus(table, lexicon_words=words).collect()
        assert len(rows) == len(texts) + 2
        for r in rows:
            if r.doc_id is not None:
                assert list(r.ids) == reference.encode_ordinary(texts[r.doc_id] or "")
    assert encode.encode_corpus(table.limit(0)).count() == 0


def test_transducer(tmp_path):
    rng = random.Random(7)
    words = {bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 7))): [rng.randrange(50_000) for _ in range(rng.randint(1, 4))] for _ in range(800)}
    (tmp_path / "t").write_bytes(compile_words(words.items()))
    t = Transducer(str(tmp_path / "t"))
    assert all(t.get(w) == ids for w, ids in words.items())
    assert all((t.get(w) is None) == (w not in words) for w in (bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 8))) for _ in range(2000)))
    (tmp_path / "empty").write_bytes(compile_words([]))
    assert Transducer(str(tmp_path / "empty")).get(b"a") is None


# problem 9


def brute_leaks(docs, items, n=12):
    split = lambda t: [w.lower() for w in re.findall(r"[^\W_]+", t or "")]
    grams = lambda w: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    held = [(i, grams(split(t))) for i, t in items]
    return {(d, i) for d, t in docs for i, g in held if g & grams(split(t))}


@pytest.mark.parametrize("local", [1000, 0])
def test_leaks(spark, local):
    rng = random.Random(9)
    word = lambda: rng.choice("red blue green one two three four five six seven".split())
    items = [(i, " ".join(word() for _ in range(30))) for i in range(6)] + [(90, "short item"), (91, None), (92, "")]
    docs = []
    for d in range(24):
        source = items[d % 6][1].split()
        k, n = rng.randrange(18), rng.choice([11, 12, 20])
        docs.append((d, " ".join(word() for _ in range(40)) + ".\n" + ", ".join(source[k : k + n]).upper() + " _ " + " ".join(word() for _ in range(5))))
    docs += [(50, None), (51, ""), (52, "few words")]
    a = spark.createDataFrame([(*x, "t") for x in docs], "doc_id long, text string, words string")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = contamination.leaked_items(a, b, max_local_bytes=local)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == brute_leaks(docs, items)
    assert contamination.leaked_items(a, b.limit(0), max_local_bytes=local).count() == 0
    assert contamination.leaked_items(a.limit(0), b, max_local_bytes=local).count() == 0


@pytest.mark.parametrize("local", [1000, 0])
def test_leaks_with_substitutions(spark, local):
    item = [f"w{k}" for k in range(24)]
    doc = [w if k % 9 != 4 else "other" for k, w in enumerate(item)]
    a = spark.createDataFrame([(1, "x y z " + " ".join(doc)), (2, " ".join(reversed(item)))], "doc_id long, text string")
    b = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert contamination.leaked_items(a, b, max_local_bytes=local).count() == 0
    rows = contamination.leaked_items(a, b, max_subs=2, max_local_bytes=local).collect()
    assert [(r.doc_id, r.item_id, r.words) for r in rows] == [(1, 7, 21)]
    with pytest.raises(ValueError):
        contamination.leaked_items(a, b, min_words=5)


@pytest.mark.parametrize("local", [1000, 0])
@pytest.mark.parametrize("words", [12, 14, 16])
def test_leaks_with_substitutions_anywhere(spark, local, words):
    """All placements of up to 4 substitutions; found are those with at most 2 in any 12 words, and no others."""
    item = [f"w{k}" for k in range(words)]
    docs, expected = [], set()
    for subs in range(5):
        for at in combinations(range(words), subs):
            docs.append((len(docs), "x y z " + " ".join("other" if k in at else w for k, w in enumerate(item)) + " x y"))
            stretches = [[k for k in range(words) if a <= k < b] for a in range(words) for b in range(a + 12, words + 1) if all(sum(s <= k < s + 12 for k in at) <= 2 for s in range(a, b - 11))]
            if stretches:
                expected.add((len(docs) - 1, max(sum(k not in at for k in s) for s in stretches)))
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    rows = contamination.leaked_items(a, b, max_subs=2, max_local_bytes=local).collect()
    assert len(expected) > 70 and sorted((r.doc_id, r.words) for r in rows) == sorted(expected)


def test_masks_cover_all_placements():
    for min_words, subs in [*((12, s) for s in range(12)), (24, 5), (30, 9)]:
        masks = contamination.covering_masks(min_words, subs)
        share = subs // (min_words // 12)
        assert all(any(all(m[k] == "0" for k in at) for m in masks) for at in combinations(range(12), share))
    assert len(contamination.covering_masks(12, 2)) == 6


def test_long_texts_come_in_slices(spark):
    import pyarrow as pa

    from tarnweave.llm.arrow import SLICE_BYTES, _slices

    batch = pa.RecordBatch.from_pydict({"t": ["x" * (SLICE_BYTES // 4)] * 30})
    parts = list(_slices(batch))
    assert sum(p.num_rows for p in parts) == 30 and len(parts) >= 7
    assert [p.num_rows for p in _slices(batch.slice(0, 0))] == []


def test_entry_point_has_all(spark):
    import __spark_entry__ as e

    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 7, 9, 10)} | {"p8_ids"} <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert F is not None


def test_no_pair_is_left_out(spark, monkeypatch):
    """Copies on one line, edited in every part: few meet at anchors, all are found."""
    rng = random.Random(17)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    texts = []
    for g in range(100):
        base = [rng.choice(words) for _ in range(200)]
        texts += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(rng.choice(words) if k % 8 == 7 else w for k, w in enumerate(base)))]
    table = spark.createDataFrame([*texts, texts[0]], "id long, text string")
    pairs = lambda **options: {(r.class_a, r.class_b) for r in near_duplicates.near_duplicate_classes(table, **options)[1].collect()}
    truth = brute_pairs(texts)
    assert len(truth) == 100 and pairs() == truth > pairs(exact=False)
    monkeypatch.setattr(near_duplicates, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(near_duplicates, "FREQUENT", 0)
    monkeypatch.setattr(near_duplicates, "ORDERED", 50)
    assert pairs() == truth


def test_leading_runs_are_shuffled_once(spark):
    """Both sides of the meeting are one plan: the second one takes the first one's shuffle."""
    texts = [(k, " ".join(f"w{j}" for j in range(k % 7, 60 + k % 7))) for k in range(40)]
    src = spark.createDataFrame(texts, "id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        met = near_duplicates._met(near_duplicates._leading(src, near_duplicates._run_counts(src), 0.4), 0.4)
        assert met.collect()
        assert "ReusedExchange" in met._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_chunks_of_a_column_are_those_of_the_texts():
    """Columns of Arrow are split as they are, slices too; short and empty texts are left out, and a chunk may hold nothing else."""
    texts = ["", "ΑΣ o'clock a-b\x1c… don't \u00a0 " * 20, "too short", "one two " * 30 + "_", " \n ", "word " * 49 + "w", "word " * 48 + "w"] + ["few"] * near_duplicates.CHUNK + ["x y z " * 20]
    column = pa.array(["left out", *texts]).slice(1)
    chunks = list(near_duplicates._chunks([(list(range(len(texts))), column)]))
    memo = near_duplicates._hash_memo()
    assert [ids for ids, *_ in chunks] == [[1, 3, 5], [len(texts) - 1]]
    for ids, words, sizes, runs, owner, n in chunks:
        expected = [near_duplicates._words(texts[k], memo) for k in ids]
        assert sizes == list(map(len, expected)) and np.array_equal(words, np.concatenate(expected))
        own = [np.unique(near_duplicates._runs(w) >> np.uint64(10)) for w in expected]
        assert n.tolist() == list(map(len, own)) and np.array_equal(runs, np.concatenate(own)) and owner.tolist() == np.repeat(range(len(ids)), n).tolist()


@pytest.mark.parametrize("most", [1, 40, 2**31])
def test_order_of_runs(most):
    """Whether the numbers fit in one or not, the order is that of a stable sort."""
    rng = np.random.default_rng(1)
    owner, times = np.sort(rng.integers(0, 2**20 if most > 40 else 30, 5000)), rng.integers(0, most, 5000)
    assert near_duplicates._order(owner, times).tolist() == np.lexsort((times, owner)).tolist()
    assert near_duplicates._order(owner[:0], times[:0]).tolist() == []


def test_words_of_chunks_are_those_of_the_whole_text():
    """Words are hashed by what stands between blanks; the words and runs are those of the text in lower case."""
    texts = ["ΑΣ ΟΔΟΣ. İstanbul o'clock don't\x1ca-b c_d \u00a0 - " * 20, "word’s ΑΣ’ " * 40, "… " * 90, "x y " * 24]
    (ids, words, sizes, runs, owner, n), *others = near_duplicates._chunks([([1, 2, 3, 4], texts)])
    memo = near_duplicates._hash_memo()
    expected = [near_duplicates._words(t, memo) for t in texts[:2]]
    assert not others and ids == [1, 2] and sizes == list(map(len, expected)) and np.array_equal(words, np.concatenate(expected))
    own = [np.unique(near_duplicates._runs(w) >> np.uint64(10)) for w in expected]
    assert n.tolist() == list(map(len, own)) and np.array_equal(runs, np.concatenate(own)) and owner.tolist() == np.repeat([0, 1], n).tolist()
