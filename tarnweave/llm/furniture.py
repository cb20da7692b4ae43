"""What the form of a line says about being its site's furniture. No phrases: which lines, labels and openings a site repeats is counted (`body`)."""

from __future__ import annotations

import re

# Openings of bylines and, before a colon, of editors' notes; main body even if a site repeats them.
BYLINES = ("by the", "written by", "text and pictures", "von der redaktion", "text und bild", "par la rédaction", "texte et photos", "por la redacción", "texto y fotos", "dalla redazione", "testo e foto", "door de redactie", "tekst en beeld", "pela redação", "texto e fotos", "текст и фото")
NOTES = ("editors' note", "corrected after", "hinweis", "note", "nota", "noot", "от редакции", "примечание")
# Marks before a link to another article.
LINK_MARKS = ("»", "→", "[+]", "›", "▸", "►")

_BYLINE = re.compile(rf"(?:(?:{'|'.join(map(re.escape, BYLINES))})(?!\w)|(?:{'|'.join(map(re.escape, NOTES))})\s?:|\S+(?: \S+){{0,2}} staff report\b)", re.I)
_FIRST = frozenset(x.split()[0] for x in (*BYLINES, *NOTES))
_RANKED = re.compile(r"\d{1,2}[.)]\s")
_END = re.compile(r"[.!?…][\"”»)\]]*$")
BYLINE_WORDS = 14


def form(line: str) -> tuple[float, str]:
    """`(link share, kind)` of a line that isn't blank, by its form alone: arrows, ranks without an end mark, copyright signs; kind is 'byline' for what is never furniture, 'text' for the rest."""
    first = line[0]
    if first in "»→›▸►[" and line.startswith(LINK_MARKS):
        return 1.0, "link"
    if first == "©":
        return 1.0, "footer"
    if first.isdigit() and _RANKED.match(line) and not _END.search(line):
        return 1.0, "ranked"
    if (line.split(" ", 1)[0].rstrip(":").lower() in _FIRST or " staff report" in line.lower()) and line.count(" ") < BYLINE_WORDS and _BYLINE.match(line):
        return 0.0, "byline"
    return 0.0, "text"


def may_open(word: str) -> bool:
    """Whether `form` may say more than 'text' of a line that begins with the word."""
    return word[0] in "»→›▸►[©" or word[0].isdigit() or word.rstrip(":").lower() in _FIRST
