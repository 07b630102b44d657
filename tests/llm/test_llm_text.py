"""The text functions behind the operators: vectors, round trips, brute force."""

import random

import numpy as np
import pytest

from wordloom.llm import boilerplate, cart, chunking, encoding, mixing, neardup, packing, scans, sentences, truncation


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("A whole text.", "whole"),
        ('He said, "It is whole."', "whole"),
        ("(A whole aside.)", "whole"),
        ("", "whole"),
        ("  \n ", "whole"),
        ("♪", "whole"),
        ("Text.\n\n- a list item", "whole"),
        ("Text.\n\n## A heading", "whole"),
        ("Fine. It was rest�", "cut"),
        ("Fine. It was \\u20", "cut"),
        ("Fine. It was &am", "cut"),
        ("Fine. See [the page](https://exa", "cut"),
        ("Fine. It was mid [...]", "cut"),
        ("Fine. (It was in Sept.", "cut"),
        ("Fine. It became the heart of, “remote", "cut"),
        ("這是完整的。", "whole"),
        ("Fine. As Dr.", "closing"),
        ("Fine. It went on and", "closing"),
        ("Thanks for listening", "closing"),
        ("Fine. If a…", "ellipsis"),
        ("สวนเก่าแก่หลายปีแล้ว", "ending"),
    ],
)
def test_ends(text, want):
    assert truncation.end_of(text)[0] == want


def test_open_marks():
    assert truncation.open_marks('a (b "c') == ["(", '"']
    assert truncation.open_marks("„Wie?“ (ja) «oui»") == []
    assert truncation.open_marks("(open\n\nnext") == []


def test_pieces_round_trip_and_overlap():
    rng = random.Random(6)
    words = ["harbour", "wörter", "檔案", "a", "signal.", "note!", "\n\n", "x" * 50, "。"]
    for _ in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 500)))
        most, overlap = rng.choice([(120, 20), (300, 0), (400, 60)])
        data, parts = text.encode(), chunking.cuts(text, most, overlap)
        end, whole = 0, b""
        for a, b in parts:
            assert b - a <= most and a <= end
            data[a:b].decode()
            if whole and overlap:
                assert end - a <= overlap and (end - a > overlap - 4 or a == end)
            whole += data[end:b]
            end = b
        assert whole == data


def test_wide_stretches_in_a_row_are_measured_in_bytes():
    assert chunking.longest_stretch("文" * 500 + " " + "文" * 1300 + " and more text") == 3900
    assert chunking.longest_stretch("a" * 2000 + " " + "😀" * 900 + " end") == 3600


def test_pieces_without_boundary_and_edits():
    text = "x" * 9000
    assert all(b - a <= 3600 for a, b in chunking.cuts(text, 3600, 200))
    assert chunking.longest_stretch("a" * 10 + "。" + "é" * 20) == 40
    rng = random.Random(1)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) + ("." if i % 9 == 8 else "") for i in range(9000))
    edited = long[:20000] + " inserted words here" + long[20000:]
    ends = lambda t: {t.encode()[:b][-30:] for _, b in chunking.cuts(t, 3600, 0)}
    assert len(ends(long) & ends(edited)) >= 0.7 * len(ends(long))
    assert chunking.cuts("", 10, 2) == [] and chunking.cuts("short", 10, 2) == [(0, 5)]


GERMAN = "Für Müller sind öffentliche Räume wichtiger – „Warum?“ fragte er. Straße, Gäste, Bücher."
RUSSIAN = "Эти старые книги заменяют большие запросы.\nОколо реки лекции сравнивают все страницы, но голоса молчат."


@pytest.mark.parametrize("page", ["cp1252", "mac_roman", "cp437", "cp850", "latin-1"])
def test_utf8_read_as_a_page_is_restored(page):
    shown = "".join(bytes([b]).decode(page, "replace") if page == "latin-1" or b in encoding.page_bytes(page).values() or b < 128 else chr(b) for b in GERMAN.encode())
    shown = "".join(c if c != "�" else "\x81" for c in shown)
    fixed, damaged, fillers = encoding.restored(shown)
    assert damaged and not fillers
    if "\x81" not in shown:
        assert fixed == GERMAN


def test_legacy_encodings():
    assert encoding.restored(RUSSIAN.encode("cp1251").decode("latin-1"))[0] == RUSSIAN
    assert encoding.restored(RUSSIAN.encode("koi8_r").decode("cp1251"))[0] == RUSSIAN
    assert encoding.restored(RUSSIAN.encode().decode("cp866"))[0] == RUSSIAN
    assert encoding.restored(RUSSIAN.encode().decode("latin-1"))[0] == RUSSIAN
    twice = GERMAN.encode().decode("latin-1").encode().decode("latin-1")
    assert encoding.restored(twice)[0] == GERMAN
    part = GERMAN + "\n" + "L’été déjà".encode().decode("latin-1")
    assert encoding.restored(part)[0] == GERMAN + "\nL’été déjà"


@pytest.mark.parametrize(
    "text",
    [GERMAN, RUSSIAN, "NÃO HÁ cães em SÃO Paulo.", "КАНАЛЫ ЗАБЫТЫЕ", "The sign Â© in the tunnel puzzled them.", "The old page showed Ã© wherever an é was meant.", "Où sont-ils ? Là.", "Really?!", "", "日本語の文章。", "http://x.y/?a=b?c"],
)
def test_sound_texts_are_no_cases(text):
    assert encoding.restored(text) == (text, 0, 0)


def test_fillers():
    assert encoding.restored("caf� near")[2] == 1
    assert encoding.restored("??????? ????? Vasri")[2] >= 2
    assert encoding.restored("Listen ? 12 min")[2] == 1


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("One. Two! Three?", ["One.", "Two!", "Three?"]),
        ("It is 3.5 e.g. now. Dr. X came at 7 p.m. Then left.", ["It is 3.5 e.g. now.", "Dr. X came at 7 p.m.", "Then left."]),
        ("“Leave it alone!” Bob shouted at us. Next.", ["“Leave it alone!” Bob shouted at us.", "Next."]),
        ('He wrote, "It is dense." Hardly.', ['He wrote, "It is dense."', "Hardly."]),
        ("« Où ? » demande Luc. Oui.", ["« Où ? » demande Luc.", "Oui."]),
        ("Eldfidell说：“模型很重要。”谁听见了？“在哪里？”Bredelas问道。", ["Eldfidell说：“模型很重要。”", "谁听见了？", "“在哪里？”Bredelas问道。"]),
        ("「どこですか？」と聞いた。次。", ["「どこですか？」と聞いた。", "次。"]),
        ("लहरें कहाँ हैं? डॉ. Ram आए। और।", ["लहरें कहाँ हैं?", "डॉ. Ram आए।", "और।"]),
        ("สวนเก่าแก่หลายปีแล้ว สะพานหายาก จำนวน 219 แห่ง", ["สวนเก่าแก่หลายปีแล้ว", "สะพานหายาก", "จำนวน 219 แห่ง"]),
        ("## Head\n\nA line\nwrapped here. B.\n- item one\n- item two\nAfter.", ["## Head", "A line\nwrapped here.", "B.", "- item one", "- item two", "After."]),
        ("They waited... and went. The end…", ["They waited... and went.", "The end…"]),
        ("Am 3. Mai 1813 ging er. „Gut.“ Ja.", ["Am 3. Mai 1813 ging er.", "„Gut.“", "Ja."]),
        ("", []),
        (" \n\t", []),
        (None, []),
    ],
)
def test_sentences(text, want):
    assert [text[a:b] for a, b in sentences.sentence_ends(text)] == want


def test_page_furniture():
    for line in ("175", "Page 96", "[169]", "146.", "- 12 -", "l52", "xiv"):
        assert scans.furniture(line, "a title") == "page_number"
    for line in ("A TITLE", "150    A title", "Xford Quarterly of Field Notes    113", "Belpoby and Vaswitis"):
        assert scans.furniture(line, "a title") == "running_header"
    for line in ("1931   250", "198 times.", "Discussion", "Compiler and bakery", "times. Listeners from Quen asked why", ""):
        assert scans.furniture(line, "a title") == ""


def test_repaired_paragraphs():
    text = "   The librarians quietly docu-\nmented it with a water-\n\nXford Annals of Field Notes  12\n\ncooled filter, and\nregisfer it.\n   Next one."
    fixed = scans.rebuilt(text, "t", {"regisfer": "register"}, {"water-cooled"})
    assert fixed == "The librarians quietly documented it with a water-cooled filter, and register it.\n\nNext one."


def test_tree_learns():
    rng = np.random.default_rng(0)
    x = rng.random((400, 5))
    y = ((x[:, 1] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    assert ((cart.predict(cart.fit(x[:300], y[:300]), x[300:]) >= 0.5) == y[300:]).mean() > 0.9
    assert ((cart.predict_bagged(cart.fit_bagged(x[:300], y[:300]), x[300:]) >= 0.5) == y[300:]).mean() > 0.8
    assert list(cart.predict(cart.fit(np.zeros((0, 2)), np.zeros(0)), np.zeros((2, 2)))) == [0, 0]


def test_words_of_a_long_line_are_all_scored():
    words = boilerplate.Words(["the story goes on"] * 9 + ["cookies consent"] * 9, [0] * 9 + [1] * 9)
    filler = "unseen " * 80
    assert len(filler) > 400
    assert words.of(filler + "cookies consent")[:4] != words.of(filler)[:4]
    assert words.of(filler + "cookies consent")[3] == words.of("cookies consent")[3] > 0


def test_furniture_labels():
    body = " ".join(["word"] * 40) + "."
    page = f"Menu\n\nTitle\n\n{body}\n\nShare\n\nSubscribers to the queue receive each message at least once.\n\n{body}x.\n\nFooter"
    assert boilerplate.labels(page, "Title", f"{body}\n\n{body}x.") == [1, 0, 0, 1, 0, 0, 1]
    assert boilerplate.labels("only short", "t", "other") is None
    numbers, x = boilerplate.features("\n \n", None, np.zeros(1 << boilerplate.SKETCH_BITS), boilerplate.Words([], []))
    assert numbers == [] and len(x) == 0


def test_best_fit_keeps_every_constraint():
    rng = np.random.default_rng(8)
    sizes = rng.integers(1, 512, 3000)
    row, n = packing.best_fit(sizes, 512)
    limit = packing.capacities(512)
    for r in range(n):
        own = sizes[row == r].astype(float)
        assert own.sum() <= limit[0] and len(own) <= limit[1] and (own**2).sum() <= limit[2] and len(own)
    assert n <= 1.03 * np.ceil(sizes.sum() / 512)
    assert packing.best_fit(np.array([], dtype=int), 512)[1] == 0


def test_expected_copies():
    got = mixing.expected_copies([("a", 0.5, 1, 100), ("b", 0.3, 4, 10), ("c", 0.2, 2, 0)], 100.0)
    assert got["c"] == 0 and got["b"] == 3.75 and got["a"] == pytest.approx(0.625)
    short = mixing.expected_copies([("a", 0.5, 1, 1000), ("b", 0.5, 2, 10)], 100.0)
    assert short["b"] == 2 and short["a"] == pytest.approx(0.08)
    assert mixing.largest_total([], 0.9) == 0.0


def test_shingles():
    assert len(neardup.shingles("a b", 3)) == 0 and len(neardup.shingles(None, 3)) == 0
    assert len(neardup.shingles("a b c a b c", 3)) == 3
    assert (neardup.shingles("A  b\tC", 3) == neardup.shingles("a b c", 3)).all()
