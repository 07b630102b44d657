"""Problem 5: texts decoded with the wrong character encoding.

The characters of a text are mapped back to the bytes of a legacy code page, and an automaton
for the structure of multibyte characters (a regular expression over lead and continuation
characters, one for each code page) finds the maximal well-formed spans; only these spans are
decoded, the rest of the text stays. Passes repeat, as texts are damaged twice. Texts in which
one legacy encoding was read as another (no UTF-8 involved) form runs of high bytes; such runs
are decoded with the encoding whose result reads most like its language.

A text with fillers - U+FFFD, or question marks where letters were - has lost characters: what
can be decoded is, but the whole can't be worked out.

A damaged sequence that stands alone in a sentence, like a thing talked about, is a mention.

Cases: null, empty and undamaged texts are no cases; repeated rows give one result; extra
columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import map_batches
from wordloom.sources.tables import table

#: Code pages that UTF-8 was read with; the bytes a page leaves undefined stay C1 controls.
PAGES = ("cp1252", "cp1251", "mac_roman", "cp437", "cp850", "cp866", "koi8_r", "cp1250", "cp1253")
#: Pages whose high half is letters of running text: two short spans are needed there.
LETTER_PAGES = {"cp1251", "cp866", "koi8_r", "cp1253"}
PASSES = 3
#: The part of the touched runs a page must explain; characters it must explain in letter pages.
COVER = 0.7
#: The share of a language's frequent letters that leaves no doubt.
SURE = 0.65
LETTER_WEIGHT = 8

# Letters that are frequent in running text of a language, by legacy encoding.
FREQUENT = {
    "cp1251": "оеаинтсрвлкмдпуя",
    "koi8_r": "оеаинтсрвлкмдпуя",
    "cp866": "оеаинтсрвлкмдпуя",
    "iso8859_5": "оеаинтсрвлкмдпуя",
    "mac_cyrillic": "оеаинтсрвлкмдпуя",
    "cp1253": "αοιετνσςηυρπκμλίόάέήώ",
    "iso8859_7": "αοιετνσςηυρπκμλίόάέήώ",
    "cp1256": "اليمنوترهبدعفسكحق",
    "iso8859_6": "اليمنوترهبدعفسكحق",
    "cp1255": "יולאתהמרבשנ",
    "cp874": "านรกอเงมยลวดทสตะปบคหแจพชขใไ่้ัิี",
    "gbk": "的一是了在人有我他这个们中来上大为和国地到以说时要就出会也你对生能而子那得于着下自之年过发后作里，。、“”个所有的机器图书馆认为比较",
    "big5": "的一是了在人有我他這個們中來上大為和國地到以說時要就出會也你對生能而子那得於著下自之年過發後作裡，。、",
    "shift_jis": "のにはをたがでてとしれさいるんなすかよばべっら、。",
    "euc_jp": "のにはをたがでてとしれさいるんなすかよばべっら、。",
    "euc_kr": "의을는이가에를은다고한지도기서로했하사인어들있대리해자",
}
#: What a page may have been read instead of; "" is the page in which the text was shown.
SHOWN = {
    "cp1252": ("cp1251", "koi8_r", "cp866", "iso8859_5", "cp1253", "cp1256", "iso8859_6", "cp1255", "cp874", "gbk", "big5", "shift_jis", "euc_jp", "euc_kr"),
    "cp1251": ("koi8_r", "cp866", "iso8859_5", "mac_cyrillic", "gbk", "euc_kr"),
    "koi8_r": ("cp1251", "cp866", "iso8859_5"),
    "cp866": ("cp1251", "koi8_r"),
    "mac_roman": ("cp1251", "koi8_r", "gbk", "euc_kr", "shift_jis"),
    "cp437": ("cp1251", "cp866", "gbk", "shift_jis"),
}
DOUBLE_BYTE = {"gbk", "big5", "shift_jis", "euc_jp", "euc_kr"}

# What a decoded character may be: scripts and signs of running text.
_PLAUSIBLE = re.compile(
    "[ -ɏͰ-ϿЀ-ӿא-ת؀-ۿऀ-ॿ฀-๿Ḁ-῿"
    "‐-‾₠-₿℀-⋿─-◿　-ヿ一-鿿가-힣ﬀ-ﬄ＀-￯\U0001f300-\U0001faff]"
)
_LONE = re.compile("[·•—–―›»«‹|…→ −×]")
_URL = re.compile(r"https?://\S+|www\.\S+")
_FILLED = re.compile(r"(?<!\S)[(\"'“«]?\?{2,}[\w?]*|\?{3,}|[^\W\d_]\?[^\W\d_]", re.UNICODE)
_LONE_FILLER = re.compile(r"(?:^|(?<=\S) )\? (?=[a-z0-9]|[A-Z])", re.M)
_ASKS = re.compile(r"(?i)\b(?:o[ùu]|pourquoi|quel|quelle|quels|quelles|comment|qui|que|combien|quand|est-ce)\b|['’]t-|-(?:ils|elles|il|elle|t)\b")


@lru_cache(maxsize=None)
def page_bytes(page: str) -> dict[str, int]:
    """The byte of each character above ASCII that ``page`` can show."""
    out: dict[str, int] = {}
    for b in range(0x80, 0x100):
        out.setdefault(chr(b) if page in ("cp1252", "cp1250") or b < 0xA0 else "", b)
        try:
            out[bytes([b]).decode(page)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    out.pop("", None)
    return out


def _class(page: str, low: int, high: int) -> str:
    return "[" + "".join(re.escape(c) for c, b in page_bytes(page).items() if low <= b <= high) + "]"


@lru_cache(maxsize=None)
def automaton(page: str) -> re.Pattern[str]:
    """Maximal runs of characters that are well-formed UTF-8 as bytes of ``page``."""
    tail, lead2, lead3, lead4 = (_class(page, *r) for r in ((0x80, 0xBF), (0xC2, 0xDF), (0xE0, 0xEF), (0xF0, 0xF4)))
    return re.compile(f"(?:{lead2}{tail}|{lead3}{tail}{{2}}|{lead4}{tail}{{3}})+")


def decode_span(span: str, page: str) -> str | None:
    """The span's text, if all of it is plausible."""
    mapped = page_bytes(page)
    try:
        text = bytes(mapped[c] for c in span).decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if all(_PLAUSIBLE.match(c) or "\x80" <= c <= "\x9f" for c in text) else None


def is_mention(text: str, start: int, end: int, decoded: str) -> bool:
    """A sequence alone between blanks, for a character that does not stand alone."""
    before, after = text[start - 1 : start] if start else "\n", text[end : end + 1] or "\n"
    if not (before in " \"'“‘(" and after in " \"'”’),.;"):
        return False
    if decoded == "©":
        return not (text[end : end + 2].strip().isdigit() or text[end : end + 6].strip().isdigit())
    return len(decoded) == 1 and not _LONE.match(decoded) and decoded not in "àÀéèóúÉ" + "яиваксуоё" or (decoded == "é" and before == " ")


@lru_cache(maxsize=None)
def page_sides(page: str) -> tuple[frozenset[str], frozenset[str]]:
    """(lead characters, continuation characters) of ``page``."""
    mapped = page_bytes(page)
    return frozenset(c for c, b in mapped.items() if 0xC2 <= b <= 0xF4), frozenset(c for c, b in mapped.items() if b <= 0xBF)


def run_of(text: str, start: int, end: int) -> tuple[int, int]:
    """The maximal run of characters above ASCII around a span."""
    while start and text[start - 1] > "\x7f":
        start -= 1
    while end < len(text) and text[end] > "\x7f":
        end += 1
    return start, end


def line_of(text: str, at: int) -> tuple[int, int]:
    end = text.find("\n", at)
    return text.rfind("\n", 0, at) + 1, len(text) if end < 0 else end


def utf8_pass(text: str) -> tuple[str, int]:
    """(text after one pass with the page that explains most, damaged spans replaced).

    A span counts only if the spans of its run make up most of it (of its line, for pages
    whose high half is letters): chance finds in sound text cover a part of it only.
    """
    best: tuple[int, list[tuple[int, int, str]]] = (0, [])
    wide = {c for c in set(text) if c > "\x7f"}
    for page in PAGES:
        leads, tails = page_sides(page)
        if wide.isdisjoint(leads) or wide.isdisjoint(tails):
            continue
        in_run: dict[tuple[int, int], list[tuple[int, int, str]]] = {}
        for m in automaton(page).finditer(text):
            decoded = decode_span(m.group(), page)
            if decoded is not None:
                unit = line_of(text, m.start()) if page in LETTER_PAGES else run_of(text, *m.span())
                in_run.setdefault(unit, []).append((m.start(), m.end(), decoded))
        spans, weight = [], 0
        for (a, b), found in in_run.items():
            covered = sum(y - x for x, y, _ in found)
            if covered >= COVER * (sum(c > "\x7f" for c in text[a:b]) if page in LETTER_PAGES else b - a):
                spans += found
                weight += covered
        if not spans:
            continue
        if weight < LETTER_WEIGHT and (page in LETTER_PAGES or page == "cp1250"):
            continue
        if weight > best[0] and not all(is_mention(text, *s) for s in spans):
            best = (weight, spans)
    if not best[1]:
        return text, 0
    out, at = [], 0
    for start, end, decoded in best[1]:
        out += [text[at:start], decoded]
        at = end
    return "".join(out) + text[at:], len(best[1])


@lru_cache(maxsize=None)
def high_runs(page: str) -> re.Pattern[str]:
    high = _class(page, 0x80, 0xFF)
    return re.compile(f"{high}(?:{high}|(?<={high})[@-~](?={high}|$)|[ ,.!?-](?={high}))*")


def language_share(text: str, encoding: str) -> float:
    """How much of the letters of ``text`` are frequent ones of the encoding's language."""
    wide = [c for c in text.lower() if c > "\x7f"]
    return sum(c in FREQUENT[encoding] for c in wide) / len(wide) if len(wide) >= 4 else 0.0


_SUSPECT = {
    "cp1252": re.compile("[À-ÿ]{4}|(?:[‚ƒ\x82\x83\x81].){3}|(?:[¡-ÿ]{2}){3}"),
    "cp1251": re.compile("[а-я][А-Я]{2}|[А-Я]{2}[а-я]?[А-Я]{3}|[Ђ-Џђ-џҐ][Ѐ-ӿ]{2}"),
    "koi8_r": re.compile("[а-я][А-Я]{2}|[─-▟]{3}"),
    "cp866": re.compile("[а-п][─-▟]|[─-▟]{3}"),
    "mac_roman": re.compile("[À-ÿŒœŸ⁄€‹›ﬁﬂ‡·‚„‰Ê-ÔÒ-Ùıˆ˜¯˘˙˚¸˝˛ˇ]{5}"),
    "cp437": re.compile("[─-▟Α-ωº-ÿ]{5}"),
}


def legacy_pass(text: str, sure: float = 0.0) -> tuple[str, int]:
    """(text after decoding runs of one legacy encoding shown as another, runs replaced).

    ``sure`` is the least language share. Each line is judged by itself, as a text may be damaged in a part only.
    """
    if not any(p.search(text) for p in _SUSPECT.values()):
        return text, 0
    done = [legacy_line(line, sure) for line in text.split("\n")]
    return "\n".join(line for line, _ in done), sum(n for _, n in done)


def legacy_line(text: str, sure: float = 0.0) -> tuple[str, int]:
    best: tuple[float, str, int] = (0.0, text, 0)
    if sure and any(p.search(text) for p in _SUSPECT.values()):
        wide = sum(c > "\x7f" for c in text)
        if any(sum(len(m.group()) for m in automaton(page).finditer(text)) >= COVER * wide for page in PAGES):
            return text, 0  # bytes of UTF-8 explain the line
    for shown, real in SHOWN.items():
        if not _SUSPECT[shown].search(text):
            continue
        mapped = page_bytes(shown)
        runs = [m for m in high_runs(shown).finditer(text) if sum(c > "\x7f" for c in m.group()) >= 3]
        if not runs:
            continue
        before = "".join(m.group() for m in runs)
        now = max((language_share(before, e) for e in ("cp1251", "cp1253")), default=0.0)
        for encoding in real:
            out, at, n, new = [], 0, 0, []
            for m in runs:
                raw = bytes(mapped[c] if c > "\x7f" else ord(c) for c in m.group())
                decoded = raw.decode(encoding, "replace")
                if decoded.count("�") * 20 > len(decoded):
                    continue
                if encoding in DOUBLE_BYTE or sum(c.isalpha() for c in decoded) * 2 >= len(decoded):
                    out += [text[at : m.start()], decoded]
                    at, n = m.end(), n + 1
                    new.append(decoded)
            share = language_share("".join(new), encoding)
            covered = sum(map(len, new)) / max(1, len(before)) * (2 if encoding in DOUBLE_BYTE else 1)
            need = max(sure, 0.16 if encoding in DOUBLE_BYTE else 0.55)
            score = share * min(1.0, covered)
            if share >= need and covered > 0.5 and score > max(best[0], now + 0.1):
                best = (score, "".join(out) + text[at:], n)
    return best[1], best[2]


def filler_count(text: str) -> int:
    """Places where characters were replaced by a filler."""
    n = text.count("�") + text.count("锟斤拷")
    if "?" in text:
        bare = _URL.sub(" ", text) if "://" in text or "www." in text else text
        n += len(_FILLED.findall(bare))
        for m in _LONE_FILLER.finditer(bare):
            line = bare[bare.rfind("\n", 0, m.start()) + 1 : m.start() + 1]
            sentence = re.split(r"[.!?…] ", line)[-1]
            n += not _ASKS.search(sentence) and not re.search("[À-ſ]", sentence)
    return n


def restored(text: str) -> tuple[str, int, int]:
    """(the text as far as it can be restored, damaged spans, fillers)."""
    if text.isascii():
        return text, 0, filler_count(text)
    # lines that read as their language under a legacy encoding first: chance finds spoil them
    text, damaged = legacy_pass(text, SURE)
    for _ in range(PASSES):
        text, n = utf8_pass(text)
        if not n:
            break
        damaged += n
    text, n = legacy_pass(text)
    return text, damaged + n, filler_count(text)


def _read(batch: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {"episode_id": [], "restorable": [], "damaged_spans": [], "fillers": [], "restored_text": []}
    for eid, text in zip(batch["id"], batch["raw_text"]):
        fixed, damaged, fillers = restored(text)
        if damaged or fillers:
            for name, value in zip(out, (eid, int(not fillers), damaged, fillers, fixed)):
                out[name].append(value)
    return out


def damaged_texts(episodes: DataFrame) -> DataFrame:
    """(episode_id, restorable, damaged_spans, fillers, restored_text) of every damaged text."""
    rows = episodes.select("id", "raw_text").filter(F.col("raw_text").isNotNull())
    return map_batches(rows, _read, "episode_id string, restorable int, damaged_spans int, fillers int, restored_text string")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every damaged episode, and whether its whole text can be worked out."""
    return damaged_texts(table(spark, folder, "episodes")).select("episode_id", "restorable").distinct()


def p5_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The damaged texts, as far as they can be restored."""
    return damaged_texts(table(spark, folder, "episodes")).dropDuplicates(["episode_id"])


QUERIES = {"p5_found": p5_found, "p5_restored": p5_restored}
ORACLES: dict[str, str] = {}
