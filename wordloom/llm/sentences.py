"""Problem 10: sentence boundaries across languages and scripts.

The standard character-property rules: a terminator (STerm, ATerm), what closes behind it
(Close), blanks (Sp). A full stop is no boundary inside numbers and words, before a lower-case
word, or behind an abbreviation of the passage's language. No terminator is a boundary when what
follows continues the sentence (comma, dash, a word tied to the quotation), and speech quoted
within a sentence does not end it: a question or exclamation in quotes that opens the sentence
goes on with who said it. Scripts written without terminators end a sentence with the blank
between two of their letters.

Blank lines always end a unit. A heading with its mark and each list item is a unit; around
those a line break ends the unit, elsewhere it is a blank.

Cases: null, empty and blank texts have no units; a block without any terminator is one unit;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import map_batches
from wordloom.sources.tables import table

# Abbreviations that need what follows them, by language ("" for all).
ABBREVIATIONS = {
    "": "dr prof no nr fig vol cf vs e.g i.e approx ca",
    "en": "mr mrs ms st messrs gen col sgt capt rev hon gov sen rep pp ed eds dept est al viz",
    "de": "z b d h u a bzw usw. abs bd hr fr str evtl ggf inkl sog vgl nat tel zzgl jh st",
    "fr": "m mm mme mlle p ex env av bd chap mgr art",
    "es": "sr sra sres dra d dña aprox pág núm ud uds av",
    "pt": "sr sra dra aprox pág núm ex av",
    "it": "sig dott ing avv pag",
    "ru": "г гг проф т е д п рис стр см др им ул руб тыс млн акад доц гл напр ср",
    "el": "κ κα δηλ π.χ κτλ δρ αρ σελ βλ",
    "hi": "डॉ श्री प्रो सं पं",
    "ar": "د أ م ص ج هـ",
}
# Abbreviations that may end a sentence; a capital behind them starts the next.
MAY_END = set("inc ltd co corp jr bros a.m p.m u.s u.k u.n d.c e.u etc uu ee ph.d b.c a.d".split())
# Short month names with a number behind them; month names behind an ordinal's point.
SHORT_MONTHS = set("jan feb mar apr jun jul aug sept sep oct nov dec".split())
MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember jänner".split())
SUPPRESSED = {lang: {*ABBREVIATIONS[""].split(), *words.split()} for lang, words in ABBREVIATIONS.items()}
ANY = {w for words in SUPPRESSED.values() for w in words}
# Frequent words that tell the languages of one script apart.
FREQUENT = {
    "en": "the of and to in is that was for it with as on his her by this are from they at be were which not have had he she we you or an",
    "de": "der die das und ist nicht von den zu mit sich des auf für im dem ein eine als auch es an werden aus er hat dass sie wird bei",
    "fr": "le la les de des et est un une du dans que qui pour pas sur au avec il elle se ce sont par plus ne en aux cette l'on était",
    "es": "el la los las de que y en un una por con no para se del al es lo como más su sus fue pero ha está son este entre",
    "pt": "o a os as de que e em um uma por com não para se do da dos das no na ao é mais como foi ele mas são este pela",
    "it": "il lo la gli di che e in un una per con non si del della dei al è sono come più ha ma nel alla anche questo era le",
}
#: Scripts written in one of the languages above.
SCRIPTS = (("ru", "Cyrillic"), ("el", "Greek"), ("hi", "Devanagari"), ("ar", "Arabic"))

_BLANK_LINE = regex.compile(r"\n[^\S\n]*(?=\n)|\r\n[^\S\n]*(?=\r?\n)| ")
_HEADING = regex.compile(r"[^\S\n]*#{1,6}[^\S\n]+\S")
_ITEM = regex.compile(r"[^\S\n]*(?:[-*•‣◦·–—][^\S\n]+|\(?\d{1,3}[.)][^\S\n]+|\(?[A-Za-z]\)[^\S\n]+)\S")
_SURE_ITEM = regex.compile(r"[^\S\n]*[-*•‣◦][^\S\n]+\S")
# Standard properties: terminators with what closes behind them. An ellipsis counts as a stop.
_ENDS = regex.compile(r"(?:[\p{Sentence_Break=STerm}\p{Sentence_Break=ATerm}…]|(?<=\p{Greek});)+(?P<close>(?:[)\]}）】〉》」』”’»›'\"]|(?<=„[^„“”]*)“|\s»(?<=«[^«»]*\s»))*)(?P<space>[\s\p{Sentence_Break=Sp}]*)")
_GAP = regex.compile(r"(?<=[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}])\s+(?=[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}])")
_UNSPACED = regex.compile(r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]")
_BEFORE = regex.compile(r"(?:^|[\s(\[{“„«\"'‘¿¡—–-])((?:\p{L}\p{M}*\.)*[\p{L}\p{M}]+)$")
_NEXT_WORD = regex.compile(r"[^\p{L}\p{N}\s]*([\p{L}\p{M}\p{N}’'-]*)")
_ATTRIBUTION = regex.compile(r"\p{Lu}[\p{L}\p{M}’'-]*\s+(?:\p{Lu}[\p{L}\p{M}’'-]*\s+)?\p{Ll}")
_CONTINUES = regex.compile(r"[\p{Sentence_Break=SContinue}—–;]")
_WIDE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_KANA = regex.compile(r"[\p{Hiragana}]")
OPENERS = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "‹": "›", "‘": "’", "»": "«"}
QUOTE_CLOSERS = set("”“»«」』›’\"'")
BRACKET_CLOSERS = set(")]}）】〉》")


_OF_SCRIPT = [(lang, regex.compile(rf"\p{{{name}}}")) for lang, name in SCRIPTS]
_AROUND = ".,;:!?…\"'()[]«»“”„‘’¿¡—–-"
_WORDS_OF: dict[str, set[str]] = {}
for _lang, _words in FREQUENT.items():
    for _w in _words.split():
        _WORDS_OF.setdefault(_w, set()).add(_lang)


def votes(passage: str) -> dict[str, float]:
    """Frequent words of each Latin-script language; one that several share counts for each in part."""
    out = dict.fromkeys(FREQUENT, 0.0)
    for w in passage.lower().split():
        of = _WORDS_OF.get(w.strip(_AROUND))
        if of:
            for lang in of:
                out[lang] += 1 / len(of)
    return out


def languages(passage: str, whole: Callable[[], dict[str, float]]) -> set[str]:
    """The languages a passage may be in, told by its script and frequent words.

    A passage too short to tell takes those of its whole text beside its own; the text's tag is
    not read, as tags are often wrong. ``whole`` gives the votes of the text.
    """
    out = {lang for lang, letter in _OF_SCRIPT if letter.search(passage)}
    found = votes(passage)
    first, second = sorted(found.values(), reverse=True)[:2]
    for told in (found,) if first >= 2 and first >= 1.5 * second else (found, whole()):
        most = max(told.values())
        out |= {lang for lang, v in told.items() if v >= 0.7 * most}
    return out


class Passage:
    """The abbreviations of a stretch of a text; its languages are told when first asked for."""

    def __init__(self, text: str, begin: int, stop: int, whole: Callable[[], dict[str, float]]) -> None:
        self.text, self.begin, self.stop, self.whole = text, begin, stop, whole
        self.held: set[str] | None = None

    def suppresses(self, key: str) -> bool:
        if key not in ANY:
            return False
        if self.held is None:
            self.held = {w for lang in languages(self.text[self.begin : self.stop], self.whole) for w in SUPPRESSED[lang]}
        return key in self.held or key in SUPPRESSED[""]


def segments(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, is one unit) of the stretches that no sentence crosses."""
    at = 0
    blocks = []
    for m in _BLANK_LINE.finditer(text):
        blocks.append((at, m.start()))
        at = m.end()
    blocks.append((at, len(text)))
    for begin, stop in blocks:
        block = text[begin:stop]
        if not block or block.isspace():
            continue
        if "\n" not in block.strip():
            yield begin, stop, bool(_HEADING.match(block.lstrip("\r\n")) or _ITEM.match(block.lstrip("\r\n")))
            continue
        lines, pos = [], begin
        for line in block.split("\n"):
            lines.append((pos, pos + len(line), line))
            pos += len(line) + 1
        lines = [x for x in lines if x[2].strip()]
        start, last_item = None, False
        for k, (a, b, line) in enumerate(lines):
            item = bool(_HEADING.match(line))
            if not item and _ITEM.match(line):
                before = lines[k - 1][2].rstrip() if k else ""
                after = lines[k + 1][2] if k + 1 < len(lines) else ""
                item = k == 0 or last_item or (bool(_SURE_ITEM.match(line)) and (before[-1:] in ".:!?;。" or bool(_SURE_ITEM.match(after))))
            if item:
                if start is not None:
                    yield start, lines[k - 1][1], False
                yield a, b, True
                start = None
            elif start is None:
                start = a
            last_item = item
        if start is not None:
            yield start, lines[-1][1], False


def quote_opened(text: str, start: int, end: int) -> int:
    """Where the innermost quotation open at ``end`` began, or -1."""
    stack: list[tuple[str, int]] = []
    for i in range(start, end):
        c = text[i]
        if c == '"':
            if stack and stack[-1][0] == '"':
                stack.pop()
            else:
                stack.append(('"', i))
        elif stack and c == stack[-1][0] and c != "’":
            stack.pop()
        elif c in OPENERS and c not in "‘»":
            stack.append((OPENERS[c], i))
    return stack[-1][1] if stack else -1


def word_start(text: str, start: int, end: int) -> int:
    """A place before the word that ends at ``end``: the last blank or line break, or ``start``."""
    return max(start, text.rfind(" ", start, end), text.rfind("\n", start, end))


def is_boundary(text: str, start: int, m: regex.Match[str], stop: int, passage: Passage) -> bool:
    """Whether the sentence that began at ``start`` ends with the terminators of ``m``."""
    close, space, after = m.group("close"), m.group("space"), m.end()
    if after >= stop:
        return True
    mark = text[m.start() : m.start("close") if close else m.start("space")]
    nxt = text[after]
    dots = mark.strip(".…") == ""
    quoted = bool(close) and any(c in QUOTE_CLOSERS for c in close)
    if not space:
        if dots and "。" not in mark and not quoted:
            return False  # inside a number, a name, an address
        if not (_WIDE.match(text[m.start() - 1]) or _WIDE.match(nxt) or mark[-1] in "。！？｡।॥؟"):
            return False
        if quoted and nxt.isalpha() and not _WIDE.match(nxt) and not _WIDE.match(text[m.start() - 1]):
            return False  # a particle tied to the quotation
    if _CONTINUES.match(nxt) and not (nxt in "—–" and not quoted):
        return False
    if quoted and _KANA.match(nxt) and not space:
        return False
    word = _NEXT_WORD.match(text, after).group(1)
    lower = bool(word) and word[0].islower() and not any(c.isupper() for c in word[1:])
    if close and lower:
        return False
    if quoted and not dots and mark[-1] not in "。।":
        opened = quote_opened(text, start, m.start())
        if opened >= 0 and not text[start:opened].strip():
            if not space and nxt.isalpha():
                return False
            if _ATTRIBUTION.match(text, after):
                return False
    if not dots:
        return True
    if lower:
        return False
    if mark == ".":
        found = _BEFORE.search(text[word_start(text, start, m.start()) : m.start()])
        if found:
            name = found.group(1)
            key = name.lower()
            if key in SHORT_MONTHS and word[:1].isdigit():
                return False
            if key in MAY_END:
                return bool(word) and not word[0].isdigit()
            if passage.suppresses(key):
                return key == "no" and bool(word) and not word[0].isdigit()
            if len(name) == 1 and name.isupper():
                return False
            if len(name) > 2 and name[-2:-1] == "." and all(len(p) == 1 for p in name.split(".")):
                return bool(word) and word[0].isupper()
        elif text[m.start() - 1 : m.start()].isdigit() and word.lower() in MONTHS:
            return False
    return True


def sentence_ends(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each unit, in characters; the end is behind its last character."""
    out: list[tuple[int, int]] = []
    if not text or text.isspace():
        return out
    unspaced = bool(_UNSPACED.search(text))
    whole_votes = cache(lambda: votes(text))
    for begin, stop, whole in segments(text):
        while begin < stop and text[begin].isspace():
            begin += 1
        while stop > begin and text[stop - 1].isspace():
            stop -= 1
        if begin == stop:
            continue
        start = begin
        if not whole:
            cuts = [(m.start("space"), m.end(), m) for m in _ENDS.finditer(text, begin, stop)]
            if unspaced:
                cuts += [(m.start(), m.end(), None) for m in _GAP.finditer(text, begin, stop)]
                cuts.sort(key=lambda c: c[:2])
            passage = Passage(text, begin, stop, whole_votes)
            for end, following, m in cuts:
                if end > start and following < stop and (m is None or is_boundary(text, start, m, stop, passage)):
                    out.append((start, end))
                    start = following
        out.append((start, stop))
    return out


def _read(batch: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {"doc_id": [], "sentence_no": [], "start_char": [], "end_char": [], "sentence": []}
    for doc, text in zip(batch["doc_id"], batch["text"]):
        ends = sentence_ends(text)
        out["doc_id"] += [doc] * len(ends)
        out["sentence_no"] += range(len(ends))
        out["start_char"] += [a for a, _ in ends]
        out["end_char"] += [b for _, b in ends]
        out["sentence"] += [text[a:b] for a, b in ends]
    return out


def _bounds(batch: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {"doc_id": [], "end_char": []}
    for doc, text in zip(batch["doc_id"], batch["text"]):
        ends = sentence_ends(text)
        out["doc_id"] += [doc] * len(ends)
        out["end_char"] += [b for _, b in ends]
    return out


def texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text").filter(F.col("text").isNotNull())


def p10_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Every sentence unit of every document, in order of ``sentence_no``."""
    return map_batches(texts(spark, folder), _read, "doc_id bigint, sentence_no int, start_char int, end_char int, sentence string")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """The end of every sentence unit."""
    return map_batches(texts(spark, folder), _bounds, "doc_id bigint, end_char int").distinct()


QUERIES = {"p10_sentences": p10_sentences, "p10_found": p10_found}
ORACLES: dict[str, str] = {}
