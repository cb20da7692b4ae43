"""Operators that judge texts: written cases of each kind, and held-out accuracy."""

import random
import tempfile
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tarnweave.llm import body, language, residue, stuffing
from tarnweave.llm.arrow import Memo
from tarnweave.llm.furniture import form
from tarnweave.llm.sampling import balanced_sample
from tarnweave.llm.words import Words

PROSE = {
    "en": "The old harbour keeps the remote garden in the morning. Nobody in the village closes the small museum before the storm. Since the winter every boat has a new sail and a quiet crew. The bridge was broken and the road became very long.",
    "de": "Der alte Hafen bewahrt den Garten am frühen Morgen. Niemand im Dorf schließt das kleine Museum vor dem Gewitter. Seit dem Winter hat jedes Boot ein neues Segel und eine stille Mannschaft. Die Brücke war kaputt und der Weg wurde sehr lang.",
    "fr": "Le vieux port garde le jardin au petit matin. Personne dans le village ne ferme le petit musée avant l'orage. Depuis l'hiver chaque bateau possède une nouvelle voile et un équipage silencieux. Le pont était cassé et la route devenait très longue.",
    "es": "El viejo puerto guarda el jardín por la mañana temprano. Nadie en el pueblo cierra el pequeño museo antes de la tormenta. Desde el invierno cada barco tiene una vela nueva y una tripulación tranquila. El puente estaba roto y el camino era muy largo.",
    "it": "Il vecchio porto conserva il giardino di buon mattino. Nessuno nel paese chiude il piccolo museo prima del temporale. Dall'inverno ogni barca possiede una vela nuova e un equipaggio silenzioso. Il ponte era rotto e la strada diventava molto lunga.",
    "nl": "De oude haven bewaart de tuin in de vroege ochtend. Niemand in het dorp sluit het kleine museum voor het onweer. Sinds de winter heeft elke boot een nieuw zeil en een stille bemanning. De brug was kapot en de weg werd erg lang.",
    "pt": "O velho porto guarda o jardim de manhã cedo. Ninguém na aldeia fecha o pequeno museu antes da tempestade. Desde o inverno cada barco tem uma vela nova e uma tripulação calma. A ponte estava partida e o caminho ficava muito longo.",
    "ru": "Старый порт хранит сад ранним утром. Никто в деревне не закрывает маленький музей перед грозой. С зимы каждая лодка имеет новый парус и тихую команду. Мост был сломан и дорога стала очень длинной.",
}


def corpus(spark, extra=()):
    rows = [(100 + 10 * k + j, f"https://{code}.site.test/{j}", f"A title {j}\n{text}", code if j else None) for k, (code, text) in enumerate(PROSE.items()) for j in range(4)]
    return spark.createDataFrame([*rows, *extra], "id long, url string, text string, lang string")


def once(spark, operator, tmp_path):
    """The rows of `operator`, whose pages come from a scan that leaves a file a time that a page is read; each is read once."""
    table = corpus(spark, [(k, None, t, None) for k, t in enumerate(CASES + NO_CASES)])
    folder = str(tmp_path)

    def note(batches):
        for batch in batches:
            for _ in range(batch.num_rows):
                tempfile.mkstemp(dir=folder)
            yield batch

    rows = operator(table.mapInArrow(note, table.schema)).collect()
    assert len(list(tmp_path.iterdir())) == table.count()
    return rows


# problem 5

CASES = [
    "Error 404: the page you asked for could not be found.\nBack", "ACCESS DENIED\n\nYou do not have permission to view /x/12.", "Bitte aktivieren Sie JavaScript, um diese Seite zu nutzen.\nRef. 7", "Home | News | Shop\nЗапрошенная страница не найдена.\n© 2020 Site",
    "A real title\nThis is dummy copy for layout only.\nLorem ipsum dolor sit amet, consectetur adipiscing elit.", "Title\nBy {{ author }}\n" + PROSE["en"], "Title – %SITE_NAME%\n" + PROSE["de"], "Title\nBy undefined – NaN\n" + PROSE["fr"], "Hello [Insert name here], " + PROSE["en"],
]
NO_CASES = [
    PROSE["en"], "", None, " \n ", "Short title", PROSE["en"] + ' The phrase "access denied" appeared 404 times in the log.', PROSE["en"] + " A tag such as `{{ author }}` is swapped for its value.", 'In our manual the mark "${event.date}" stands for a variable. ' + PROSE["en"],
    "The score is undefined in the old paper, and null in the new one. " + PROSE["en"], "Home | News | Shop\n" + PROSE["it"] + "\nWe use cookies to keep Site running and to count visits. Accept all or choose settings.",
]


def test_residue(spark):
    rows = [(k, None, t, None) for k, t in enumerate(CASES + NO_CASES)]
    rows += [(50 + k, None, f"Title\n{PROSE['en']}\nBy {mark} {PROSE['de']}", None) for k, mark in enumerate(["${line1}", "%FIELD_2%", "@@name1@@", "{item2}", "{{ " + "very_" * 12 + "long }}", "[[some name]]", "<%= x %>"])]
    found = residue.residue_pages(corpus(spark, rows)).where("id < 50 or id >= 57")
    marked = residue.residue_pages(corpus(spark, rows)).where("id >= 50 and id < 57")
    assert marked.count() == 7
    assert {r.id for r in found.collect()} == set(range(len(CASES)))
    assert residue.residue_pages(corpus(spark).limit(0)).count() == 0


def all_pages(n=1200):
    """More pages than a language counts in full; each has a word of its own, the last three share two lines, the first is long and ends in one more word."""
    word = lambda k: "q" + "".join("abcdefghij"[int(d)] for d in f"{k:04}")
    rows = [(k, None, f"Title {word(k)}\n{PROSE['en']} The {word(k)} of the quiet village keeps a very small garden.", "en") for k in range(n)]
    rows[0] = (0, None, (PROSE["en"] + "\n") * 200 + "The zyxwv of the quiet village keeps a very small garden.", "en")
    return rows[:-3] + [(k, i, f"Intro {word(k)}\nShared by wvuts pages\nMore {word(k)}\nAlso on wvuts pages\n{t}", lang) for k, i, t, lang in rows[-3:]]


def test_residue_is_learned_from_all_pages(spark):
    rows = all_pages()
    table = spark.createDataFrame([*rows, (5000, None, PROSE["ru"], "ru"), (5001, None, "", "en"), (5002, None, None, None)], "id long, url string, text string, lang string").repartition(5)
    model = residue.fit(table)
    grams = model.natural.grams[residue.ORDER - 1]
    assert all(grams["q" + "".join("abcdefghij"[int(d)] for d in f"{k:04}"[:3])] > 0 for k in range(len(rows))) and grams["zyxw"] > 0
    assert model.furniture("wvuts") > 0
    again = residue.fit(table.repartition(3))
    assert again.natural.heads == model.natural.heads and again.natural.grams == model.natural.grams and again.shapes[1].grams == model.shapes[1].grams and again.furniture.odds == model.furniture.odds


def test_residue_reads_each_text_once(spark, tmp_path):
    found = {r.id for r in once(spark, residue.residue_pages, tmp_path)}
    assert found and found <= set(range(len(CASES)))


def test_residue_of_a_few_pages(spark):
    """Counted in Spark or of a list of texts, the models are the same."""
    table = corpus(spark, [(k, None, t, None) for k, t in enumerate(CASES + NO_CASES)])
    counted, listed = residue.fit(table), residue.ResidueModel([r.text for r in table.collect() if r.text])
    words = {w for t in CASES + list(PROSE.values()) for w in t.lower().split()}
    for w in words:
        assert counted._rows[counted._index[w]] == pytest.approx(listed._rows[listed._index[w]])
    assert counted.furniture.odds == pytest.approx(listed.furniture.odds)
    assert all(counted._mark(residue.shape(w)) == listed._mark(residue.shape(w)) for t in CASES for w in t.split())


# problem 6


def test_languages(spark):
    mixed = PROSE["en"].replace(". ", ".\n") + "\n" + PROSE["de"].split(". ")[0] + ".\n" + PROSE["ru"].split(". ")[1] + "."
    extra = [(1, "https://en.site.test/", mixed, "de"), (2, None, PROSE["es"], "zxx"), (3, None, None, "en"), (4, None, "few words", None), (5, None, PROSE["nl"], " NL-be")]
    rows = language.languages(corpus(spark, extra), skip_residue=False).collect()
    main = {r.id: r for r in rows if r.line_no == -1}
    assert {main[100 + 10 * k + j].lang == code for k, code in enumerate(PROSE) for j in range(4)} == {True}
    assert (main[1].lang, main[1].label, main[2].lang, main[2].label, main[5].label) == ("en", "de", "es", None, "nl")
    assert 3 not in main and 4 not in main and all(0 < r.confidence <= 1 for r in rows)
    assert {(r.line_no, r.lang) for r in rows if r.id == 1 and r.line_no >= 0} == {(4, "de"), (5, "ru")}
    assert language.languages(corpus(spark).limit(0)).count() == 0


def test_languages_leave_out_all_cases_of_residue(spark):
    """Those with the right label as well."""
    rows = [(k, None, "Error 404: the page you asked for could not be found. Access denied. You do not have permission to view this page. Internal server error. Service unavailable. Please try again.", lang) for k, lang in enumerate(["en", None])]
    found = {r.id for r in language.languages(corpus(spark, rows)).collect()}
    assert found == {r.id for r in corpus(spark).collect()}


def test_languages_are_learned_from_all_pages(spark):
    rows = all_pages()
    table = spark.createDataFrame([*rows, *((5000 + k, None, PROSE["ru"], "ru") for k in range(3)), (6000, None, None, "en")], "id long, url string, text string, lang string")
    model = language.fit(table)
    assert {language.words_of(r[2].split(". The ")[-1])[0] for r in rows} <= model.words.keys() and "zyxwv" in model.words
    assert language.fit(table.repartition(7)).total.tolist() == model.total.tolist()


def test_languages_read_each_text_once(spark, tmp_path):
    assert {r.id for r in once(spark, language.languages, tmp_path)} >= {100, 170}


def test_words_are_those_of_the_lines():
    texts = ["One two\r\n\n  two\x1cthree \u00a0 four. ", None, "", " \n ", "ΟΔΟΣ x"]
    words = Words.of(texts)
    again = Words.unpacked(words.pages, *words.packed())
    for w in (words, again):
        lines = [(p, k, w.text(a, b)) for p, k, a, b in zip(w.page.tolist(), w.number.tolist(), w.start, w.end, strict=True)]
        assert lines == [(p, k, " ".join(x.split())) for p, t in enumerate(texts) for k, x in enumerate((t or "").split("\n")) if x.split()]
        assert w.by_page(w.by_line(w.told(len, np.int64))).tolist() == [len("".join((t or "").split())) for t in texts]
    of = lambda texts: Words.of(texts).hashes(lambda w: hash(w) % 2**64).tolist()
    assert of(["a b", "x\na  b", "b a"]) == [of(["a b"])[0], of(["x"])[0], of(["z", "a b"])[1], of(["b a"])[0]] and of(["a b"]) != of(["b a"])
    empty = Words.of([None, ""])
    assert Words.unpacked(2, *empty.packed()).vocabulary == [] == residue.ResidueModel([]).prose("") and empty.hashes(hash).tolist() == []


def test_words_of_a_column_are_those_of_the_texts():
    """Arrow's functions and Python's split alike, at every blank there is."""
    blanks = "".join(chr(c) for c in range(0x3100) if chr(c).isspace() or not chr(c).isprintable())
    for texts in (["One two\r\n\n  two\x1cthree \u00a0 four. ", None, "", " \n ", "ΟΔΟΣ x", *PROSE.values()], [None], [], [f"a{c}b {c} c" for c in blanks]):
        expected = Words.of(texts)
        for column in (pa.array(texts, pa.string()), pa.array(["left out", *texts, None], pa.string()).slice(1, len(texts))):
            words = Words.of_column(column)
            assert words.pages == expected.pages and words.packed() == expected.packed()


@pytest.mark.parametrize("rows", [1, 3])
def test_furniture_is_counted_over_batches(spark, rows):
    """A line's surroundings may come in several batches."""
    table = spark.createDataFrame([r for r in all_pages(40) for _ in range(2)], "id long, url string, text string, lang string").repartition(3)
    encoded = residue.encoded(table.select(residue.labelled(table, "text", "lang").alias("label"), "text"), {"label": "string"}).cache()
    model = residue.learn(encoded)
    whole = residue._furniture(encoded, model, 80).odds
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        assert residue._furniture(encoded, model, 80).odds == whole and whole["wvuts"] > 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_priors_decide_where_words_say_little(spark):
    """The same names on a German and on a French host: the host, counted over its other pages, turns the verdict."""
    names = "Zk " + " ".join(map(str, range(30)))
    rows = [(10 * j + k, f"https://{code}host.test/{k}", PROSE[code], code) for j, code in enumerate(("de", "fr")) for k in range(8)] + [(100, "https://dehost.test/x", names, None), (101, "https://frhost.test/x", names, None)]
    found = {r.id: r for r in language.languages(corpus(spark, rows), skip_residue=False).where("line_no = -1").collect()}
    assert (found[100].lang, found[101].lang) == ("de", "fr")
    assert found[100].confidence < 0.9 < found[0].confidence


def test_confidence_is_calibrated():
    """Pieces of a few words of pages that the model has not seen: of those given a confidence, about as many are right."""
    rows = spark_pages("/root/testdata/sf0.01/pages.parquet")
    model = language.LanguageModel([(language.LANGUAGES.index(c), [language.words_of(x) for x in t.split("\n")]) for k, c, t in rows if k % 2 and c in language.LANGUAGES])
    sure, right, bins, scores = 0.0, 0, set(), Memo(model.word)
    n = 0
    for k, _, t in rows:
        words = language.words_of(t.replace("\n", " "))
        if k % 2 or len(words) < 60:
            continue
        each = np.array([scores[w] for w in words])
        main = each.sum(axis=0).argmax()
        for size in (1, 2, 4):
            for at in range(0, len(words) - size, 30):
                p = language.posterior(each[at : at + size].sum(axis=0)[None, :], np.array([size]), model.weight)[0]
                n, sure, right = n + 1, sure + p.max(), right + (p.argmax() == main)
                bins.add(int(p.max() * 5))
    assert n > 3000 and len(bins) >= 4 and abs(sure - right) < 0.05 * n


def spark_pages(path):
    import duckdb

    return duckdb.connect().execute(f"select id, lower(left(trim(lang), 2)), text from '{path}' where text is not null").fetchall()


def test_languages_hold_out(spark):
    """Learned on one half of the pages, held against the labels of the other half; some labels are wrong on purpose."""
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = language.fit(table.where("id % 2 = 0"))
    rows = language.languages(table.where("id % 2 = 1"), model=model, skip_residue=False).where("line_no = -1 and label is not null").collect()
    assert len(rows) > 400
    assert sum(r.label == r.lang for r in rows) > 0.88 * len(rows)


# problem 7

PAGE = """Home | News | About us | Contact
You are here: News › The quiet harbour of the north
The quiet harbour of the north
By the Example desk
We use cookies to keep Example running and to count visits. Accept all or choose settings.

{prose}
A short subheading
• First item of the article
• Second item
Related: How one link found the bakery
» Another article of this site
Editors' note: an earlier version gave a wrong date.

Most read
1. How one harbour found the header
2. Cache and museum in the north
Tags: harbour, north
Share this page with your friends
© 2021 Example
Back to top"""


SITE_PAGES = 40


def site_pages():
    """Pages of one site: the same furniture around other bodies; bylines repeat as well."""
    rng = random.Random(3)
    names = ["".join(rng.choice("bdfglmnrst") + rng.choice("aeiou") for _ in range(3)).title() for _ in range(400)]
    name = lambda: rng.choice(names)
    for k in range(SITE_PAGES):
        prose = " ".join(f"The {name()} of {name()} keeps the {name()} near {name()}." for _ in range(4))
        yield k, (
            f"Home | News | About us | Contact\nYou are here: News › {name()} and {name()}\n{name()} and {name()} of the north\nBy the Example desk\nWe use cookies to keep Example running and to count visits. Accept all or choose settings.\n\n"
            f"{prose}\nA short subheading by {name()}\n• First {name()} of the article\n• Second {name()}\nRelated: How one {name()} found {name()}\n» Another {name()} of this site\nEditors' note: an earlier version gave {name()} a wrong date.\n\n"
            f"Most read\n1. How one {name()} found the header\n2. Cache and {name()} in the north\nTags: {name()}, {name()}\nShare this page with your friends\n© 2021 Example\nVisitors today: {k}"
        )


FURNITURE = {0, 1, 4, 10, 11, 14, 15, 16, 17, 18, 19, 20}


def test_body(spark):
    texts = dict(site_pages())
    rows = [(k, f"https://www.site.test/{k}", t.replace(" ", "  ").replace("\n", "\r\n") if k == 7 else t, 0) for k, t in texts.items()] + [(90, "https://www.site.test/a", None, 0), (91, "https://www.site.test/b", "", 0), (92, "https://www.site.test/c", "Back\nError 404: the page you asked for could not be found.", 0)]
    table = spark.createDataFrame(rows, "id long, url string, text string, kind int")
    model = residue.ResidueModel([*PROSE.values(), *texts.values()])
    found = {(r.id, r.line_no) for r in body.furniture_lines(table, skip_residue=False).collect()}
    assert {x for x in found if x[0] < 90} == {(k, n) for k in texts for n in FURNITURE}
    cases = {r.id for r in residue.residue_pages(table, model).collect()}
    assert 92 in cases and {(r.id, r.line_no) for r in body.furniture_lines(table, model).collect()} == {x for x in found if x[0] not in cases}
    kept = {r.id: r.text for r in body.main_body(table).collect()}
    assert kept[1].split("\n") == [x for k, x in enumerate(texts[1].split("\n")) if k not in FURNITURE and x.strip()]
    assert kept[90] is None and kept[91] == "" and len(kept) == len(rows)
    assert body.furniture_lines(table.limit(0), model).count() == body.main_body(table.limit(0)).count() == 0


def test_body_leaves_out_residue_told_by_all_pages(spark):
    """A notice beside lines that only pages beyond any sample share: those lines are furniture, so the page is a case."""
    shared = ["Opening hours of the wvuts library are posted at every gate.", "Parking near the wvuts library is free on each sunny day.", "Tickets of the wvuts library are sold near every old gate."]
    rows = [(k, f"https://s{k}.test/", t, lang) for k, _, t, lang in all_pages()]
    rows += [(5000 + k, "https://s.test/", "\n".join(x for j, y in enumerate(shared) for x in (f"Intro {chr(97 + k)}{chr(97 + j)}", y)) + "\n" + PROSE["en"], "en") for k in range(6)]
    table = spark.createDataFrame([*rows, (9000, "https://s.test/9", "Back\nError 404: the page you asked for could not be found.\n| Home | News | Shop |", "en")], "id long, url string, text string, lang string")
    model = residue.fit(table)
    assert all(sum(map(model.furniture, x.lower().split())) > residue.FURNITURE for x in shared)
    cases = {r.id for r in residue.residue_pages(table, model).collect()}
    found = {r.id for r in body.furniture_lines(table).collect()}
    assert 9000 in cases and not found & cases and found == {r.id for r in body.furniture_lines(table, model).collect()}


def test_body_reads_each_text_once(spark, tmp_path):
    assert once(spark, body.furniture_lines, tmp_path)


def test_body_of_pages_without_url(spark):
    """They count as one site; a site of few pages has its form only."""
    rows = [(k, None if k < 30 else f"https://s{k}.test/", t) for k, t in site_pages()]
    found = {(r.id, r.line_no) for r in body.furniture_lines(spark.createDataFrame(rows, "id long, url string, text string"), skip_residue=False).collect()}
    assert {x for x in found if x[0] < 30} == {(k, n) for k in range(30) for n in FURNITURE}
    assert {x for x in found if x[0] >= 30} == {(k, n) for k in range(30, SITE_PAGES) for n in (0, 11, 15, 16, 19)}
    assert body.main_body(spark.createDataFrame([(1, "one line")], "id long, text string")).first().text == "one line"


@pytest.mark.parametrize("line", ["→ Das Haus", "» The house", "[+] La casa", "3. How one harbour found the header", "© 2020 Site"])
def test_furniture_by_form(line):
    assert form(line)[0] == 1.0


@pytest.mark.parametrize("line", ["The archive and the news of the small harbour", "Von der Redaktion Beispiel", "Note legali", "* An item", "Nota: una versione precedente dava un'altra data.", "1. Close the valve.", "x" * 5000])
def test_no_furniture_by_form(line):
    assert form(line)[0] == 0.0
    assert (form(line)[1] == "byline") == line.startswith(("Von der", "Nota:"))


def test_openings():
    assert body.pieces("related: how one link") == ("related", ["related", "how one link"]) and body.pieces("news › a very long title of an article") == ("news", ["news"])
    assert body.pieces("more like this – a title") == ("more like this", ["more like this"]) and body.pieces("la luz – el molino") == ("", []) == body.pieces("plain words")


def test_density_decides():
    """The same line with the same link share is main body or not by what else its page holds."""
    reader = body.Reader()
    line, menu = "Wspólna uwaga o sprawach miasta", "\n".join(f"Dom {c} | Sklep | Szukaj" for c in "abcdefgh")
    prose = PROSE["en"].replace(". ", ".\n") + "\n"

    def verdicts(text, repeated):
        return body.body_lines(reader(text)[0], repeated)

    on_prose, on_menus = verdicts(f"{prose}{line}\n{menu[:21]}", [0.0] * 4 + [0.05, 1.0]), verdicts(f"{menu}\n{line}", [1.0] * 8 + [0.05])
    assert on_prose[4][:2] == (4, False) and on_menus[8][:2] == (8, True)


def test_long_line():
    assert body.body_lines(body.Reader()("word " * 100_000)[0]) == [(0, True, "text")]
    assert body.body_lines(body.Reader()(" | ".join(f"Label {k}" for k in range(500)) + "\n" + PROSE["en"])[0])[0][1] is False


def test_plain_lines_are_read_as_sums_over_words(monkeypatch):
    """Only lines with separators, or with what `form` tells, are read by themselves; the numbers are those of each line read, and the hash of an opening is that of the line."""
    read, line = [], body.Reader._line
    monkeypatch.setattr(body.Reader, "_line", staticmethod(lambda x: read.append(x) or line(x)))
    plain = "\n".join(f"Plain line {k}, of words; x{'x' * k}" for k in range(40))
    reader = body.Reader()
    reader(plain + "\n\n" + plain.upper())
    assert not read
    odd = [*dict(site_pages())[3].split("\n"), "One – two – three, four", "a - b", "- An item", "La Voz staff report", "Note: a remark, and more", "2. Ranked", "ΟΔΟΣ 12: ΟΔΟΣ", "x:/", "Related"]
    lines, hashes, openings, names = reader("\r\n".join([*odd, plain]))
    known = [x for x in [*odd, *plain.split("\n")] if x]
    each = [line(x) for x in known]
    assert [tuple(lines[k + 2 : k + 5]) for k in range(0, len(lines), body.FIELDS)] == [(len(x), tags, link) for x, (tags, link, _, _) in zip(known, each, strict=True)]
    assert [bool(x) for x in openings] == [bool(x[2]) for x in each] and len(names) == sum(len(x[3]) for x in each)
    assert openings[next(k for k, x in enumerate(known) if x.startswith("Related:"))] == hashes[known.index("Related")] != 0
    assert reader("PLAIN  line 7, of words; xxxx")[1] == reader("plain Line 123, OF\twords; XXXX")[1] and not any(reader(""))


def test_bodies_of_many_pages_are_those_of_each():
    """Pages are judged together as by themselves, those without lines or without furniture too."""
    rows = [body.Reader()(t)[0] for _, t in site_pages()] + [[], body.Reader()("one line")[0], body.Reader()("a | b | c\n\na | b | c")[0]]
    rng = random.Random(5)
    shares = [[rng.choice([0.0, 0.02, 0.3, 1.0]) for _ in range(len(x) // body.FIELDS)] for x in rows]
    page = np.repeat(np.arange(len(rows)), list(map(len, shares)))
    main, kind = body.verdicts(page, np.array([x for row in rows for x in row]).reshape(-1, body.FIELDS), np.array([x for row in shares for x in row]))
    alone = [x[1:] for row, share in zip(rows, shares, strict=True) for x in body.body_lines(row, share)]
    assert [(m, body.KINDS[k]) for m, k in zip(main.tolist(), kind.tolist(), strict=True)] == alone and len(set(alone)) > 4


# sampling


def test_balanced_sample(spark):
    rows = [(k, "en" if k % 10 else "DE-at", "a line\n" * (5 if k else 50_000)) for k in range(1000)] + [(2000, None, "x"), (2001, "xx", "y"), (2002, "en", None), (2003, "en", "")]
    table = spark.createDataFrame(rows, "id long, lang string, text string")
    options = {"id_col": "id", "text_col": "text", "label_col": "lang", "sample_pages": 90}
    got = balanced_sample(table, ["en", "de"], others=True, **options)
    assert Counter(label for label, _ in got) == {"en": 30, "de": 30, "": 2}
    assert got == balanced_sample(table.repartition(7), ["en", "de"], others=True, **options)
    assert {label for label, _ in balanced_sample(table, ["en", "de"], others=False, **options)} == {"en", "de"}
    assert balanced_sample(table.limit(0), ["en"], others=True, **options) == []


# problem 10


def test_stuffing(spark):
    prose = [f"{PROSE[a]} {PROSE[b]}" for a in PROSE for b in PROSE if a != b]
    rng = random.Random(2)
    names = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    long_text = " ".join(f"The {rng.choice(names)} of {rng.choice(names)} sees {rng.choice(names)} and {rng.choice(names)} again." for _ in range(12_000))
    cases = [
        ", ".join(f"{a} kitchen graph" for a in ("dusty", "northern", "steady") for _ in range(12)), "\n".join(f"https://www.site{k}.test/page/{k} link {k}" for k in range(20)), " ".join(f"#tag{k % 7} #Word" for k in range(25)),
        "\n".join(f"Warm Site{k % 3} Pro No. {k} / {k}.50" for k in range(12)), " ".join("cold library? library Nova = cold library! Nova library – library Nova – cold library." for _ in range(8)), PROSE["en"].split(". ")[0] + ".\n" + "\n".join(["garden", "path server", "valley"] * 14),
    ]
    others = [
        *prose, PROSE["en"] + "\nSee https://www.site.test/a and https://www.site.test/b\nTags: one, two, three", "short, list, of, words", None, "", prose[0].lower().replace(".", ""), "\n".join(PROSE["en"].split(". ")),
        "> " + PROSE["en"].replace(" the ", " the\n> "), long_text,
    ]
    measure = stuffing.Measure()
    assert sum(measure(b)[0] for b in stuffing.blocks(long_text)) > 100_000
    rows = [(k, t, "en", 1) for k, t in enumerate(cases)] + [(100 + k, t, None, 1) for k, t in enumerate(others)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, words int")
    assert {r.doc_id for r in stuffing.stuffed_documents(table).collect()} == set(range(len(cases)))
    assert stuffing.stuffed_documents(table.limit(0)).count() == 0


def test_block_measures():
    measure = stuffing.Measure()
    prose, tags, links = PROSE["en"], "stone river " * 30, "\n".join(f"word{k} other{k * k} - http://site{k}.test/{k}" for k in range(10))
    rows = {name: np.array([measure(b) for b in stuffing.blocks(t)]) for name, t in (("prose", prose), ("tags", tags), ("links", links))}
    assert rows["tags"][0, 2] < rows["prose"][0, 2] and rows["links"][0, 4] < rows["prose"][0, 4]
    assert rows["prose"][0, 5] > 0.9 and rows["tags"][:, 5].max() == rows["links"][:, 5].max() == 0
    assert measure(stuffing.blocks(prose)[0]) == stuffing.Measure()(stuffing.blocks(prose)[0])  # the compressor forgets
    quoted = "> The old harbour\n> keeps the garden.\nName\nother"
    assert stuffing.unwrapped(quoted) == ["the old harbour keeps the garden.", "name", "other"]


def test_plain_lines_are_not_searched_for_what_is_left_over(monkeypatch):
    """Only lines with a word that may be left over are searched, and words of one form are judged once; verdicts are those of each line searched."""
    model = residue.ResidueModel([PROSE["en"]] * 3)
    odd = ["Dear {{ name }}, ΟΔΟΣ. is not\tset", "date (NOT  set)", "Written by: NULL\r", "He wrote 'N/A (null)' there.", "\x1c \n\n", "", None, "Lorem IPSUM dolor sit amet, consectetur 12 and ١٢"]
    searched = []
    left_over = model.left_over
    monkeypatch.setattr(model, "left_over", lambda line, low: searched.append(line) or left_over(line, low))
    text = "\n".join(f"Plain line {k} of words, {'x' * k}" for k in range(40))
    model.open()
    model.judge([text, text.upper()])
    assert not searched and len(model._rows) < len(model._index)
    expected = [any(left_over(" ".join(x.split()), " ".join(x.split()).lower()) for x in (t or "").split("\n") if x.split()) for t in odd]
    assert any(expected) and all(case for (case, _, _), left in zip(model.judge(odd), expected, strict=True) if left) and searched
