"""Problem 5: pages of template residue, filler, error messages and demands for scripts.

Character n-gram models (order 4, interpolated): filler and error notices from the seeds below, natural prose from
all of the collection's pages, whole, each declared language with a bounded weight (`sampling.LABEL_PAGES`). A line's words get the
log-likelihood ratio of the better residue model to natural prose; windows of WINDOW words whose mean ratio a character is
above THRESHOLD are residue. A page is a case if residue covers more words than its sentences do, furniture apart.

Placeholders are found by the same models over the shape of words (each run of letters one sign): forms of placeholders against all
words of the pages. What is found counts unless an exact check finds it inside quotes or code ticks, talked about and not left over, or
a tag of HTML. Marks of empty values are an exact list.

What is furniture is learned, too: words of lines that several pages share, pages of residue apart, against words of lines
that one page has.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Mapping
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnweave.llm.arrow import Memo, flat, map_batches
from tarnweave.llm.sampling import HELD, count_all, known_label, label_weights, weighted
from tarnweave.llm.words import PACKED, Words, codes, encoded, unpack

ORDER = 4
WINDOW = 3
THRESHOLD = 0.12
#: Words of residue that a case has at least: a short title is none.
MIN_RESIDUE = 3
#: Log-likelihood ratio of a word's shape that makes it a part of a placeholder.
SHAPE = 3.0
#: Pages that share a line of furniture, and log odds that make another line one.
SHARED, FURNITURE = 3, 2.0
#: Of so many pages; of more, as many more have to share it, for ordinary sentences come again, too.
SHARED_OF = 3600
LANGUAGES = ("en", "de", "fr", "es", "it", "nl", "pt", "ru")

# Seeds of the residue models.
ERRORS = """
Error 404: the page you asked for could not be found. Not found. The address does not exist on this server. The requested page was not found.
Access denied. You do not have permission to view this page. Forbidden. Internal server error. The administrator has been told. Bad gateway: upstream did not answer.
Service unavailable. Please try again in a few minutes. This site is down for maintenance and will be back soon. Database connection failed: timeout after ms.
Something went wrong on our side (code). Oops! This page has moved or was deleted. Your session has expired. Please sign in again. Warning: undefined index 'a1b2c3' in /srv/www/page on line 500.
Notice: undefined variable in /var/www/html/index on line 12. Fatal error: uncaught exception in /srv/www/page on line 404. Warning: undefined index 'f0e1d2' in /srv/www/page on line 1045. Traceback: most recent call last.
Request id. Reference. Gateway timeout. Reload. Back. OK. Retry. Go to the home page. Too many requests.
Please enable JavaScript to use this page. You need to turn on scripts in your browser to continue. This application requires JavaScript. Loading. Checking your browser before you proceed. Scripts and cookies must be on.
Your browser is not supported. Update it, allow scripts and reload. Enable cookies and reload the page. JavaScript is disabled in your browser.
Fehler 404: Die gewünschte Seite wurde nicht gefunden. Seite nicht gefunden. Zugriff verweigert. Sie haben keine Berechtigung. Der Dienst ist zurzeit nicht erreichbar. Bitte später erneut versuchen. Interner Serverfehler. Ihre Sitzung ist abgelaufen. Bitte melden Sie sich erneut an.
Bitte aktivieren Sie JavaScript, um diese Seite zu nutzen. Für diese Anwendung müssen Skripte erlaubt sein. Ihr Browser wird nicht unterstützt.
Erreur 404 : la page demandée est introuvable. Accès refusé. Vous n'avez pas les droits nécessaires. Service momentanément indisponible, réessayez plus tard. Erreur interne du serveur. Votre session a expiré.
Veuillez activer JavaScript pour afficher cette page. Cette application a besoin des scripts du navigateur. Votre navigateur n'est pas pris en charge.
Error 404: no se ha encontrado la página solicitada. Acceso denegado. No tiene permiso para ver esta página. Servicio no disponible. Inténtelo de nuevo más tarde. Error interno del servidor. Su sesión ha caducado.
Active JavaScript para ver esta página. Esta aplicación necesita que permita los scripts. Su navegador no es compatible.
Errore 404: la pagina richiesta non è stata trovata. Accesso negato. Non avete il permesso. Servizio non disponibile, riprovate più tardi. Errore interno del server. La sessione è scaduta.
Attivate JavaScript per vedere questa pagina. Questa applicazione richiede gli script del browser. Il browser non è supportato.
Fout 404: de gevraagde pagina is niet gevonden. Toegang geweigerd. U hebt geen rechten. De dienst is tijdelijk niet beschikbaar, probeer het later opnieuw. Interne serverfout. Uw sessie is verlopen.
Schakel JavaScript in om deze pagina te bekijken. Deze toepassing heeft scripts in de browser nodig. Uw browser wordt niet ondersteund.
Erro 404: a página pedida não foi encontrada. Acesso negado. Não tem permissão para ver esta página. Serviço indisponível, tente mais tarde. Erro interno do servidor. A sua sessão expirou.
Ative o JavaScript para ver esta página. Esta aplicação precisa dos scripts do navegador. O seu navegador não é suportado.
Ошибка 404: запрошенная страница не найдена. Доступ запрещён. У вас нет прав. Сервис временно недоступен, повторите попытку позже. Внутренняя ошибка сервера. Ваша сессия истекла.
Включите JavaScript, чтобы просмотреть страницу. Для работы приложения нужны скрипты. Ваш браузер не поддерживается.
"""
FILLER = """
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas. Proin porta urna, lectus cursus risus tincidunt vestibulum ornare, faucibus varius sentiat mollis justo nostra ferunt.
Ornate pellar porta ipsum urna dolora lorem varem ornate tempor. Magna pellar ipsum mollis labore sentia tincus vestib lectum consec ferun velum cursum quista aliqua proin justum faucil risus nostra.
This is dummy copy for layout only. Sample paragraph text goes here. Content coming soon, xxxx xxxx. Replace this text with your own content. Your story starts in this box, type anything. Headline placeholder, subtitle placeholder.
TODO write intro, TBD, TBD. asdf asdf qwer asdf. Text text text text text. Your text here. Insert text here. Placeholder text. Test test test. Coming soon.
Blindtext, bitte ersetzen. Hier steht später Ihr Text. Platzhalter für Ihren Text. Texte provisoire à remplacer. Votre texte ici. Texto de ejemplo, sustituir. Su texto aquí. Testo di prova, da sostituire. Il vostro testo qui.
Voorbeeldtekst, nog te vervangen. Hier komt uw tekst. Texto de exemplo, a substituir. O seu texto aqui. Пробный текст, замените его. Здесь будет ваш текст. Текст для примера, заменить.
"""

# Forms of unfilled template parts; a stands for any name.
PLACEHOLDERS = """
{{a}} {{ a }} {{a.a}} {{a_a}} {{ a_a }} {{a0}} ${a} ${a_a} ${a.a} ${a0} #{a} #{a_a} #{a.a} {% a a %} {% a_a %} {%a%} <%= a %> <%= a.a %> <%=a%> <% a %> [[a]] [[a_a]] [[ a ]] [[a.a]]
@@a@@ @@a_a@@ @@a0@@ __a__ __a_a__ __a_0__ __a.a__ %a% %a_a% %a.a% %a_0% $a$ $a_a$ $a.a$ {a} {a_a} {a.a} {a0} <a-a> <a_a> <a.a> <a> [a a a] [a a a a] [a a] [a_a a] [a.a a]
""".split("\n")
_HTML_TAGS = frozenset("a b i p br em ul ol li h1 h2 h3 h4 hr tt td tr th div pre sup sub code span html body head main strong table title".split())
EMPTY_MARK = re.compile(r"\bN/A \(null\)|\bundefined – NaN\b|\bnull, null\b|\(not set\)|\bundefined undefined\b|\bNaN:NaN\b", re.I)
EMPTY_LINE = re.compile(r"^(?:[#*•-]\s*)?(?:\w+\s?:\s*|by\s+)?(?:n/a|null|undefined|nan|none|nil|\(null\)|\(not set\)|\[object object\])(?:[\s,;/–-]+(?:n/a|null|undefined|nan|none|nil|\(null\)))*$", re.I)
_OPEN, _CLOSE = "\"'`“„«‘‹»”", "\"'`”“»’›«"
_WORD = re.compile(r"[^\W_]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_SIGNS = re.compile(r"[{}\[\]<>%$@]|__")
_SUSPECT = re.compile(r"[{}\[\]<>%$@]|__|n(?:ull|an\b|/a|ot set|one|il)|undefined|object")
_EMPTY = re.compile(r"n(?:ull|an\b|/a|ot set|one|il)|undefined|object")
_DIGITS = re.compile(r"\d+")
_END = re.compile(r"[.!?…][\"”»)\]]*$")


def shape(word: str) -> str:
    """A word with each run of letters as `a` and each run of digits as `0`."""
    return _DIGITS.sub("0", _LETTERS.sub("a", word))


def _suspect(word: str) -> bool:
    """Whether `_SUSPECT` may match at the word: all that it matches is of one word, or begins at the end of one."""
    low = word.lower()
    return _SUSPECT.search(low) is not None or low.endswith("not")


def empty_value(line: str, low: str) -> bool:
    """Whether the mark of an empty value stands in the line (`low`: in lower case) outside of quotes and code ticks."""
    if not _EMPTY.search(low):
        return False
    for m in EMPTY_MARK.finditer(line):
        a, b = m.span()
        if not (a and line[a - 1] in _OPEN and b < len(line) and line[b] in _CLOSE):
            return True
    return bool(EMPTY_LINE.match(line))


def _text(raw: str) -> str:
    return " ".join(raw.split()).lower()


def _clean(raw: str) -> str:
    return _DIGITS.sub("0", _text(raw))


class CharModel:
    """Interpolated character n-grams over lower-case text with single spaces, digits as 0."""

    def __init__(self, texts: Iterable[str] | Mapping[str, int], smooth: float = 2.0):
        """`texts` may map texts to their numbers."""
        self.smooth = smooth
        self.grams: list[Counter] = [Counter() for _ in range(ORDER)]
        self.heads: list[Counter] = [Counter() for _ in range(ORDER)]
        for t in texts:
            times = texts[t] if isinstance(texts, Mapping) else 1
            t = "  " + t + " "
            for n in range(ORDER):
                grams, heads = self.grams[n], self.heads[n]
                if times == 1:
                    grams.update([t[i - n : i + 1] for i in range(max(2, n), len(t))])
                    heads.update([t[i - n : i] for i in range(max(2, n), len(t))])
                    continue
                for i in range(max(2, n), len(t)):
                    grams[t[i - n : i + 1]] += times
                    heads[t[i - n : i]] += times

    @classmethod
    def of_grams(cls, counts: Mapping[str, float], smooth: float = 2.0) -> CharModel:
        """The model of counted grams of one to ORDER characters."""
        out = cls([], smooth)
        for gram in sorted(counts):  # sums of fractions are the same in the same order
            n = counts[gram]
            out.grams[len(gram) - 1][gram] += n
            out.heads[len(gram) - 1][gram[:-1]] += n
        return out

    def logp(self, context: str, ch: str) -> float:
        p = 1 / 200
        for n in range(ORDER):
            h = context[len(context) - n :] if n else ""
            p = (self.grams[n].get(h + ch, 0) + self.smooth * p) / (self.heads[n].get(h, 0) + self.smooth)
        return math.log(p)


def grams(padded: str) -> list[str]:
    """The grams of one to ORDER characters that end in a character of `padded` after the spaces it begins with."""
    first = len(padded) - len(padded.lstrip(" "))
    return [padded[i - n : i + 1] for n in range(ORDER) for i in range(max(first, n), len(padded))]


class Furniture:
    """Naive Bayes over the words of a line: shared by pages, or of one page only.

    A line counts as shared if it stands before SHARED different lines and after as many, which the lines of copies don't.
    """

    def __init__(self, pages: list[list[str]], prior: float = 20.0):
        before, after = defaultdict(set), defaultdict(set)
        for lines in pages:
            for a, b in zip(["", *lines], [*lines, ""], strict=True):
                before[b].add(a)
                after[a].add(b)
        around = {x: min(len(before[x]), len(after[x])) for x in before if x}
        shared, single = ([set(_LETTERS.findall(x)) for x, n in around.items() if (n >= SHARED if many else n == 1)] for many in (True, False))
        many, few = (Counter(w for x in part for w in x) for part in (shared, single))
        self.learn(((w, many[w], few[w]) for w in many.keys() | few.keys()), len(shared), len(single), prior)

    def learn(self, words: Iterable[tuple[str, int, int]], shared: int, single: int, prior: float = 20.0) -> None:
        """Sets the odds by the numbers of shared and of single lines, of each word (`word, shared, single`) and of all."""
        self.odds = {}
        for w, many, few in words:
            rate = (many + few) / max(1, shared + single)
            x = math.log((many + prior * rate) / (shared + prior)) - math.log((few + prior * rate) / (single + prior))
            if many + few >= 2 and abs(x) > 0.1:
                self.odds[w] = x

    def __call__(self, word: str) -> float:
        """Log odds that a word adds."""
        return sum(self.odds.get(w, 0.0) for w in _LETTERS.findall(word))


class ResidueModel:
    """The models; `judge(texts)` decides."""

    def __init__(self, texts: list[str], filler: str = FILLER, errors: str = ERRORS):
        """Learns natural prose from the sentences of eight words or more of the sampled `texts`, whose residue is left out of the furniture."""
        self.residue = [CharModel([_clean(x) for x in re.split(r"\n|(?<=[.!?])\s", src) if x.strip()]) for src in (filler, errors)]
        words = Counter(w for t in texts for w in t.split())
        shapes: Counter = Counter()
        for w, n in words.items():
            shapes[shape(w)] += n
        self.shapes = CharModel([w for x in PLACEHOLDERS for w in x.split()]), CharModel(shapes)
        self.furniture = None
        self.open()
        self.natural = CharModel([_clean(x) for t in texts for x in self.prose(t)])
        sound = [t for t, verdict in zip(texts, self.judge(texts), strict=True) if not verdict[0]]
        self.furniture = Furniture([[x for x in map(_clean, t.split("\n")) if x] for t in sound])
        self.open()

    def prose(self, text: str) -> list[str]:
        """The sentences of eight words or more in which nothing is left over."""
        words = Words.of([text])
        return [words.text(a, b) for a, b in zip(*self.sentences(words), strict=True)]

    def sentences(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Where `prose`'s sentences begin and end."""
        if not len(words.tokens):
            return words.tokens, words.tokens
        last = words.told(lambda w: w[-1] in ".!?", bool)[words.tokens]
        last[words.end - 1] = True
        end = np.flatnonzero(last) + 1
        start = np.concatenate([[0], end[:-1]])
        found = end - start >= 8
        odd = np.add.reduceat(words.told(self._suspects.__getitem__, np.int64)[words.tokens], start)
        for j in np.flatnonzero(found & (odd > 0)).tolist():
            found[j] = not self._lines[words.text(start[j], end[j])]
        return start[found], end[found]

    def open(self) -> None:
        """Worker-side caches: a row of `_rows` per distinct word, and whether something is left over in lines and sentences with a word of which it may be."""
        self._index = Memo(self._known, 10**9)  # of words as they are; emptied together with the rows
        self._lows = Memo(self._word, 10**9)
        self._rows: list[tuple[float, float, float, float]] = []
        self._suspects = Memo(_suspect)
        self._ends = Memo(lambda w: _END.search(w) is not None)
        self._lines = Memo(lambda line: self.left_over(line, line.lower()), 50_000)
        self._marks = Memo(self._mark)
        self._grams = Memo(self._gram)

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("residue", "natural", "shapes", "furniture")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.open()

    def _known(self, word: str) -> int:
        return self._lows[_DIGITS.sub("0", word.lower())]

    def _word(self, word: str) -> int:
        grams = self._grams
        padded = f"  {word} "
        ratios = [grams[padded[max(0, k - ORDER + 1) : k + 1]] for k in range(2, len(padded))]
        self._rows.append((sum([x for x, _ in ratios]), sum([x for _, x in ratios]), float(len(word) + 1), self.furniture(word) if self.furniture else 0.0))
        return len(self._rows) - 1

    def _gram(self, gram: str) -> tuple[float, float]:
        """Log-likelihood ratios of a character after those before it."""
        context, ch = gram[:-1], gram[-1]
        base = self.natural.logp(context, ch)
        filler, errors = (m.logp(context, ch) - base for m in self.residue)
        return filler, errors

    def _mark(self, form: str) -> bool:
        total, context = 0.0, "  "
        for ch in form + " ":
            total += self.shapes[0].logp(context, ch) - self.shapes[1].logp(context, ch)
            context = (context + ch)[-ORDER:]
        return total > SHAPE

    def left_over(self, line: str, low: str) -> bool:
        """Whether a placeholder stands in the line (single spaces; `low`: in lower case) outside of quotes, or the mark of an empty value."""
        if not _SUSPECT.search(low):
            return False
        if _SIGNS.search(line):
            words = line.split(" ")
            for k, w in enumerate(words):
                if _SIGNS.search(w) and self._marks[shape(w)]:
                    quoted = w[0] in _OPEN and any(x and x.rstrip(".,;:!?)")[-1:] in _CLOSE for x in [w[1:], *words[k + 1 :]] if x.rstrip(".,;:!?)"))
                    if not quoted and not (w[0] == "<" and w.strip("<>/.,;:").lower() in _HTML_TAGS):
                        return True
        return empty_value(line, low)

    def _hot(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Per line the number of words inside residue windows (a line of fewer than WINDOW words is one window), and whether it is furniture."""
        flat, start, end = words.tokens, words.start, words.end
        table = np.array([self._rows[k] for k in map(self._index.__getitem__, words.vocabulary)]).T
        above = [(x > 0)[flat].astype(np.int8) for x in table[:2]]
        fits = np.ones(len(flat), bool)  # a window of the line begins at the word
        for k in range(1, WINDOW):
            fits[np.maximum(end - k, start)] = False
        whole = max(0, len(flat) - WINDOW + 1)
        many = [sum((x[k : whole + k] for k in range(WINDOW)), np.zeros(whole, np.int8)) >= min(2, WINDOW) for x in above]
        inside = np.zeros(len(flat), bool)
        for n in range(1, WINDOW + 1):
            begin = np.flatnonzero(fits[:whole] & (many[0] | many[1])) if n == WINDOW else start[words.size == n]
            most = min(2, n)  # no single odd word makes a window
            at = flat[begin[:, None] + np.arange(n)]
            filler, errors, size = (x[at].sum(axis=1) for x in table[:3])
            enough = [(x > 0)[at].sum(axis=1) >= most for x in table[:2]]
            hot = ((filler > THRESHOLD * size) & enough[0]) | ((errors > THRESHOLD * size) & enough[1])
            inside[(begin[hot][:, None] + np.arange(n)).ravel()] = True
        return np.add.reduceat(inside, start, dtype=np.int64), words.by_line(table[3]) > FURNITURE

    def judge_words(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per page: is it a case, its residue words, its sentence words (0 where residue is too little for a case)."""
        if len(self._rows) > 150_000 or len(self._index) > 500_000:
            self.open()
        left_over = np.zeros(words.pages, bool)
        if not len(words.size):
            return left_over, left_over.astype(np.int64), left_over.astype(np.int64)
        suspects = np.flatnonzero(words.told(self._suspects.__getitem__, bool)[words.tokens])
        for j in np.unique(np.searchsorted(words.end, suspects, "right")).tolist():
            left_over[words.page[j]] |= self._lines[words.text(words.start[j], words.end[j])]
        bad, furniture = self._hot(words)
        n = words.size
        # below that a page is never a case by its residue
        some = words.by_page(bad)[words.page] >= MIN_RESIDUE
        mostly = some & (bad >= 0.6 * n)
        ended = words.told(self._ends.__getitem__, bool)[words.tokens[words.end - 1]]
        text = some & ~mostly & (n >= 6) & ~furniture & ((n >= 14) | ended)
        residue = words.by_page(np.where(mostly | (text & (bad > 2)), bad, 0))
        sentence = words.by_page(np.where(text, n - bad, 0))
        return left_over | ((residue >= MIN_RESIDUE) & (residue > sentence)), residue, sentence

    def judge(self, texts: list[str | None]) -> list[tuple[bool, int, int]]:
        """`judge_words`'s verdict on each text."""
        return list(zip(*(x.tolist() for x in self.judge_words(Words.of(texts))), strict=True))

    def __call__(self, text: str | None) -> tuple[bool, int, int]:
        return self.judge([text])[0]


def _count_words(held: dict[str, Counter], labels: list[str | None], words: Words) -> None:
    names, of = codes(labels)
    for k, n in enumerate(np.bincount(of[of >= 0], minlength=len(names)).tolist()):
        held.setdefault(names[k], Counter())[""] += n  # pages
    for k, w, n in words.tally(words.tokens, np.repeat(of[words.page], words.size), len(names)):
        held[names[k]][w] += n


def _shape_grams(words: Counter) -> Counter:
    shapes: Counter = Counter()
    for w, n in words.items():
        if w:
            shapes[shape(w)] += n
    out = Counter({"": words[""]})
    for x, n in shapes.items():
        for g in grams(f"  {x} "):
            out[g] += n
    return out


def _prose_grams(words: Counter) -> dict[str, int]:
    """Grams of the words of sentences, in lower case with digits as 0, of which the first ones come with two spaces before them. No word is judged by one before it, so grams of two words are not counted."""
    clean: Counter = Counter()
    for w, n in words.items():
        clean[_DIGITS.sub("0", w.lower())] += n
    out = defaultdict(int)
    for w, n in clean.items():
        for g in grams(f"{w} " if w[0] == " " else f" {w} "):
            out[g] += n
    return out


def _contexts(rows: DataFrame, model: ResidueModel) -> DataFrame:
    """`hash, line, before, after` of the lines of pages that are no cases, each with hashes of the lines before and after it; `line` only once a task or so, else null."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m, clean, seen = shared.value, Memo(_clean), set()
        hashed = Memo(lambda w: xxhash.xxh3_64_intdigest(clean[w]))
        for _, words in unpack(batches):
            if not len(words.size):
                continue
            sound = np.flatnonzero(~m.judge_words(words)[0][words.page])
            hashes, page = words.hashes(hashed.__getitem__)[sound], words.page[sound]
            same = page[1:] == page[:-1]
            before, after = np.zeros(len(sound), np.int64), np.zeros(len(sound), np.int64)
            before[1:], after[:-1] = np.where(same, hashes[:-1], 0), np.where(same, hashes[1:], 0)
            order = np.lexsort((after, before, hashes))
            hashes, before, after = hashes[order], before[order], after[order]
            first = np.diff(hashes, prepend=~hashes[:1]) != 0
            different = first.copy()
            different[1:] |= (np.diff(before) != 0) | (np.diff(after) != 0)
            low = list(map(clean.__getitem__, words.vocabulary))
            lines = [None] * len(sound)
            for j, at, h in zip(np.flatnonzero(first).tolist(), sound[order[first]].tolist(), hashes[first].tolist(), strict=True):
                if h not in seen:
                    seen.add(h)
                    lines[j] = " ".join([low[k] for k in words.tokens[words.start[at] : words.end[at]].tolist()])
            keep = np.flatnonzero(different).tolist()
            yield [hashes[keep], [lines[k] for k in keep], before[keep], after[keep]]
            if len(seen) > HELD:
                seen.clear()

    return map_batches(rows.select("label", *PACKED), run, {"hash": "long", "line": "string", "before": "long", "after": "long"})


def _furniture(rows: DataFrame, model: ResidueModel, pages: int) -> Furniture:
    """What `Furniture` learns, from all pages. The words reach the driver, those of one line apart."""
    enough = max(SHARED, round(SHARED * pages / SHARED_OF))

    def run(batches):
        many, few = Counter(), Counter()
        key, text, before, after = None, None, set(), set()  # the line that may go on in the next batch
        letters = Memo(lambda w: list(map(place.__getitem__, _LETTERS.findall(w))))
        place = Memo(lambda w: len(place), 10**9)

        def count(lines: pa.Array, least: np.ndarray):
            """Adds the words of distinct lines, each word once a line."""
            shared = least >= enough
            taken = np.flatnonzero(shared | (least == 1))
            if len(place) > HELD:
                place.clear()
                letters.clear()
            words, sizes = flat(pc.split_pattern(lines.take(pa.array(taken)), " "))
            coded = words.dictionary_encode()
            known = [letters[w] for w in coded.dictionary.to_pylist()]
            parts, ends = np.fromiter(chain.from_iterable(known), np.int64), np.cumsum(list(map(len, known)), dtype=np.int64)
            token = coded.indices.to_numpy()
            n = np.diff(ends, prepend=0)[token]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat((ends - np.diff(ends, prepend=0))[token], n)
            line = np.repeat(np.repeat(np.arange(len(taken)), sizes), n)
            pairs = np.sort(line * len(place) + parts[at])
            pairs = pairs[np.diff(pairs, prepend=-1) != 0]
            names = list(place)
            for counter, of in ((many, shared[taken]), (few, ~shared[taken])):
                counts = np.bincount(pairs[of[pairs // len(place)]] % len(place)) if len(pairs) else np.zeros(0, np.int64)
                found = np.flatnonzero(counts)
                for k, times in zip(found.tolist(), counts[found].tolist(), strict=True):
                    counter[names[k]] += times
                counter[""] += int(of.sum())  # lines

        def close():
            if key is not None:
                count(pa.array([text], pa.string()), np.array([min(len(before), len(after))]))

        def out():
            words = list(many.keys() | few.keys())
            columns = [words, [many[w] for w in words], [few[w] for w in words]]
            many.clear()
            few.clear()
            return columns

        for keys, lines, b, a in batches:
            keys, b, a = (x.to_numpy() for x in (keys, b, a))
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            if key == int(keys[0]):
                end = int(first[1]) if len(first) > 1 else len(keys)
                text = text or next((x for x in lines[:end].to_pylist() if x), None)
                before.update(b[:end].tolist())
                after.update(a[:end].tolist())
                first = first[1:]
            if not len(first):
                continue
            close()
            last = int(first[-1])
            key, text, before, after = int(keys[last]), next((x for x in lines[last:].to_pylist() if x), None), set(b[last:].tolist()), set(a[last:].tolist())
            if len(first) > 1:
                rows = np.arange(first[0], last)
                group = np.repeat(np.arange(len(first) - 1), np.diff(first))
                least = np.full(len(first) - 1, len(rows))
                for x in (b[rows], a[rows]):
                    order = np.lexsort((x, group))
                    x, of = x[order], group[order]
                    different = np.concatenate([[True], (x[1:] != x[:-1]) | (of[1:] != of[:-1])])
                    least = np.minimum(least, np.bincount(of[different], minlength=len(least)))
                # one row of each line at least has its text
                given = rows[lines.slice(first[0], len(rows)).is_valid().to_numpy(zero_copy_only=False)]
                one = given[np.searchsorted(given, first[:-1])]
                count(lines.take(pa.array(one)), least)
            if len(many) + len(few) > HELD:
                yield out()
        close()
        yield out()

    lines = _contexts(rows, model).repartition("hash").sortWithinPartitions("hash")
    words = map_batches(lines, run, {"word": "string", "many": "long", "few": "long"}, ("hash", "line", "before", "after")).groupBy("word").agg(F.sum("many").alias("many"), F.sum("few").alias("few"))
    found = words.where("many + few >= 2 or word = ''").toArrow()
    rows = {w: (many, few) for w, many, few in zip(*(found[c].to_pylist() for c in ("word", "many", "few")), strict=True)}
    out = Furniture([])
    out.learn(((w, *n) for w, n in rows.items() if w), *rows.get("", (0, 0)))
    return out


def labelled(pages: DataFrame, text_col: str, label_col: str) -> Column:
    """First two letters of the label if they are among LANGUAGES, else ''; null for a page without text."""
    return F.when(F.length(text_col) > 0, known_label(pages, list(LANGUAGES), label_col))


def fit(pages: DataFrame, *, text_col: str = "text", label_col: str = "lang") -> ResidueModel:
    """Learns from all pages, whole: their words are encoded in one scan, and read three times to count the shapes of words, the grams of prose and the lines around lines.

    Pages of a declared language (first two letters) of more than `sampling.LABEL_PAGES` pages weigh less each, so that rare ones are learned too.
    """
    return learn(encoded(pages.select(labelled(pages, text_col, label_col).alias("label"), F.col(text_col).alias("text")), {"label": "string"}))


def learn(rows: DataFrame) -> ResidueModel:
    """`fit`'s model, of an encoded table that has `labelled` pages in a column `label`."""
    model = ResidueModel([])
    model.furniture = None
    counted = count_all(rows, _count_words, _shape_grams)
    pages_of = {k: c.pop("") for k, c in counted.items()}
    weights = label_weights(pages_of)
    model.shapes = model.shapes[0], CharModel.of_grams(weighted(counted, weights))
    model.open()
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def count_prose(held: dict[str, Counter], labels: list[str | None], words: Words) -> None:
        names, of = codes(labels)
        start, end = shared.value.sentences(words)
        edge = np.bincount(start, minlength=len(words.tokens) + 1) - np.bincount(end, minlength=len(words.tokens) + 1)
        inside = np.cumsum(edge[:-1]) > 0
        inside[start] = False
        label = np.repeat(of[words.page], words.size)
        for before, at in (("  ", start), ("", np.flatnonzero(inside))):
            for k, w, n in words.tally(words.tokens[at], label[at], len(names)):
                held.setdefault(names[k], Counter())[before + w] += n

    model.natural = CharModel.of_grams(weighted(count_all(rows, count_prose, _prose_grams), weights))
    model.open()
    model.furniture = _furniture(rows, model, sum(pages_of.values()))
    model.open()
    return model


def residue_pages(pages: DataFrame, model: ResidueModel | None = None, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """`<id_col>, residue_words, sentence_words` of the pages that are cases.

    Null, empty and merely short texts are none. Each row is judged by itself, so repeated rows come out repeatedly;
    null ids are kept. Other columns are ignored; an empty table gives no rows (and only the seeds are learned).
    """
    rows = encoded(pages.select(F.col(id_col).cast("long").alias("id"), labelled(pages, text_col, "lang").alias("label"), F.col(text_col).alias("text")), {"id": "long", "label": "string"})
    model = model or learn(rows)
    shared = pages.sparkSession.sparkContext.broadcast(model)  # as large as the grams and words of the pages are many

    def judge(batches):
        m = shared.value
        for (ids,), words in unpack(batches):
            case, bad, good = m.judge_words(words)
            found = np.flatnonzero(case)
            yield [[ids[k] for k in found.tolist()], bad[found], good[found]]

    return map_batches(rows.select("id", *PACKED), judge, {id_col: "long", "residue_words": "long", "sentence_words": "long"})
