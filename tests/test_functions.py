"""Golden vectors of the scalar and text functions."""

import random

import pytest
from pyspark.sql import functions as F

from wordloom.functions import scalars as S
from wordloom.functions import text as X
from wordloom.sources import documents as D
from wordloom.sources import lexicon


def one(spark, column, **values):
    """The value of a column expression over one row of literals."""
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("First one. Second two! Third?", ["First one.", " Second two!", " Third?"]),
        ("no mark at all", ["no mark at all"]),
        ("It cost 3.5 and ended. Version 1.2.3 came.", ["It cost 3.5 and ended.", " Version 1.2.3 came."]),
        ("Dr. Who met Prof. X. Then left.", ["Dr. Who met Prof. X. Then left."]),
        ("In the U.S. it is 9 a.m., e.g. now. Yes.", ["In the U.S. it is 9 a.m., e.g. now.", " Yes."]),
        ("Wait... what?!", ["Wait.", "..", " what?", "!"]),
    ],
)
def test_split_sentences(spark, text, want):
    assert one(spark, X.split_sentences(F.col("t")), t=text) == want


def brute_sentences(text):
    """The reference's loop: a character at a time, the word before a point looked at backwards."""
    import regex

    out, current = [], ""
    for i, ch in enumerate(text):
        current += ch
        if ch not in ".!?" or len(current.encode()) < 2:
            continue
        if ch == ".":
            if i and regex.match("[0-9]", text[i - 1]) and regex.match("[0-9]", text[i + 1 : i + 2]):
                continue
            word = regex.search(r"\p{Alphabetic}*$", current[:-1]).group()
            if len(word) == 1 or word.lower() in X.SPOKEN_ABBREVIATIONS:
                continue
        out.append(current)
        current = ""
    return out + [current] if current else out


def test_every_document_is_split_into_sentences(spark, tmp_path):
    import hashlib

    from wordloom.plans import catalog

    texts = ["Une ide\u0301e. Puis rien.", "Cafe\u0301 Dr. No\u0301. S\u0323. X", "नमस्ते. हि. दो! क्या? Dr. x", "Plain. Text 3.5 here", "\u0301.a\u0301.b.", None, ""]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_sentences"], r["sentences_md5"]) for r in catalog.QUERIES["sentence_split_all"](spark, str(tmp_path)).collect()}
    want = {i: brute_sentences(t) for i, t in rows if t}
    assert got == {i: (len(w), hashlib.md5("\x02".join(w).encode()).hexdigest()) for i, w in want.items()}


def test_long_sentences_are_cut_within_the_size():
    for text in ("word " * 400, "a clause, " * 200 + "end.", "x" * 2500, "é" * 1000, ("wörter; " * 300)):
        pieces = X.long_sentence_pieces(text)
        assert len(pieces) > 1
        assert all(len(p.rstrip(". ").encode()) <= 1800 for p in pieces)
    assert X.long_sentence_pieces("short.") == ["short."]
    assert all(len(p.encode()) <= 902 for p in X.long_sentence_pieces("word " * 400))


def packed(pieces, most):
    out, cur = [], ""
    for p in pieces:
        if cur and len((cur + p).encode()) > most:
            out.append(cur)
            cur = ""
        cur += p
    return [*out, cur] if cur else out


def test_packing_equals_a_plain_loop(spark):
    rng = random.Random(1)
    rows = [["ä" * rng.randint(0, 30) + "b" * rng.randint(0, 30) for _ in range(rng.randint(0, 12))] for _ in range(40)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, p array<string>")
    got = {r["i"]: r["x"] for r in df.select("i", X.pack(F.col("p"), 70).alias("x")).collect()}
    for i, r in enumerate(rows):
        assert got[i] == packed(r, 70)


def test_speech_chunks(spark):
    assert one(spark, X.speech_chunks(F.col("t"), 100), t="Short text.") == ["Short text."]
    assert len(one(spark, X.speech_chunks(F.col("t"), 20), t="One sentence here. Two sentence here. And a third.")) == 3


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("no header", []),
        ("## A\nbody\n\n## B", [("A", "A\n\nbody"), ("B", "B")]),
        ("preface\n\n## A\nx\n### sub\ny", [(None, "preface"), ("A", "A\n\nx\n### sub\ny")]),
        ("  \n  ## A\nx", [("A", "A\n\nx")]),
        ("", []),
    ],
)
def test_parse_sections(spark, text, want):
    assert [tuple(r) for r in one(spark, X.parse_sections(F.col("t")), t=text)] == want


def test_ssml(spark):
    want = "<speak><p><s>A &amp; be.</s><s>C!</s></p><p><s>D</s></p></speak>"
    assert one(spark, X.build_ssml(F.col("t")), t="A & be. C!\n\n  \n\nD") == want
    assert one(spark, X.build_ssml(F.col("t")), t="  ") == "<speak><p><s></s></p></speak>"


def test_ssml_cuts_long_sentences_and_skips_blank_paragraphs(spark):
    long = "alpha beta gamma, " * 90 + "end."
    got = one(spark, X.build_ssml(F.col("t")), t=f"{long}\n\n\t\n\nShort.\n\n\n")
    pieces = [p.split("</s>")[0] for p in got.split("<s>")[1:]]
    assert len(pieces) > 3 and all(len(p.encode()) <= 902 for p in pieces) and pieces[-1] == "Short."
    assert "<p></p>" not in got and got.count("<p>") == 2


def test_white_space_of_any_kind_is_stripped(spark):
    assert one(spark, S.not_blank(F.col("t")), t="\n\t\u2003\n") is None
    assert one(spark, S.tail(F.col("t"), 5), t="abc\n d\n\n") == "d"
    assert one(spark, S.normalize_whitespace(F.col("t")), t="\u3000a\n b\x85") == "a b"


def test_lexicon(spark):
    entries = [("SQL", "sequel"), ("NoSQL", "no sequel"), ("SQL", "never"), ("Pkl", "pee kay ell")]
    apply = X.apply_lexicon(F.col("t"), entries)
    assert one(spark, apply, t="SQL, NoSQL; Pkls (Pkl) sql éSQL") == "sequel, no sequel; Pkls (pee kay ell) sql ésequel"
    assert one(spark, X.apply_lexicon(F.col("t"), []), t="SQL") == "SQL"
    assert lexicon.parse("# c\n\nSQL\tsequel\n") == [("SQL", "sequel")]
    with pytest.raises(ValueError):
        lexicon.parse("SQL sequel")
    assert len(lexicon.SPOKEN) == len({t for t, _ in lexicon.SPOKEN})


def test_anchors(spark):
    text = "Contents: Alpha begins here. " + "filler " * 60 + "Alpha begins here and goes on. " + "filler " * 60
    at = text.index("Alpha begins here and")
    assert one(spark, X.find_anchor(F.col("t"), F.col("a")), t=text, a="Alpha begins here and") == at + 1
    assert one(spark, X.find_anchor(F.col("t"), F.col("a")), t=text, a="Alpha begins here andX paraphrased end") == text.index("Alpha begins") + 1
    assert one(spark, X.rfind_anchor(F.col("t"), F.col("a")), t=text, a="Alpha begins here") == text.rindex("Alpha begins here") + 1
    assert one(spark, X.find_anchor(F.col("t"), F.col("a")), t=text, a="nothing like that") is None


def test_locate_sections(spark):
    text = "Intro words. " + "One starts. " + "a " * 200 + "Two starts. " + "b " * 200 + "References follow"
    outline = F.array(F.struct(F.lit("One").alias("title"), F.lit("One starts.").alias("start_anchor")), F.struct(F.lit("Two").alias("title"), F.lit("Two starts.").alias("start_anchor")))
    got = one(spark, X.locate_sections(F.col("t"), outline, F.col("e")), t=text, e="References follow")
    assert [r["title"] for r in got] == ["One", "Two"]
    assert got[0]["body"].startswith("One starts.") and got[1]["body"].endswith("b ")
    assert one(spark, X.locate_sections(F.col("t"), outline, F.col("e")), t="One starts. Two starts.", e="x") is None
    assert one(spark, X.locate_sections(F.col("t"), outline, F.col("e")), t=text.replace("Two starts", "Zwei"), e="x") is None


def test_paragraph_pieces():
    section = "\n\n".join(["p" * 40, "q" * 40, "r. " * 60, "ü" * 90])
    pieces = X.paragraph_pieces(section, 100)
    assert all(len(p.encode()) <= 100 for p in pieces)
    assert "".join(pieces).replace(" ", "").replace("\n", "") == section.replace(" ", "").replace("\n", "")
    assert X.paragraph_pieces("  short  ", 100) == ["short"]


def test_html():
    page = "<html><head><title>T</title><script>x</script></head><body><nav>Menu</nav><p>One <b>two</b>.</p><p>Three &amp; four</p><footer>f</footer></body></html>"
    assert X.html_text(page) == ("T", "One two.\n\nThree & four")
    paper = '<article class="ltx_document"><h1 class="ltx_title_document">Paper</h1><div class="ltx_authors">A</div><p>Let <math alttext="x=1"><mi>x</mi></math> be.</p><cite>[1]</cite></article>'
    title, text = X.html_text(paper, paper=True)
    assert title == "Paper" and "Let x=1 be." in text and "[1]" not in text and "A" not in text.split()
    assert X.html_text("<p>no paper</p>", paper=True) is None
    assert X.html_text(None) is None


@pytest.mark.parametrize(
    ("url", "server", "batch", "abstract", "paper"),
    [
        ("https://arxiv.org/abs/2301.1?x=1", "arxiv", "arxiv", "2301.1", "2301.1"),
        ("https://arxiv.org/pdf/2301.1v2.pdf", "arxiv", "pdf", None, "2301.1v2"),
        ("https://ar5iv.org/abs/2301.1/", "arxiv", "arxiv", "2301.1", "2301.1"),
        ("https://x.org/a.PDF#p", "pdf", "article", None, None),
        ("https://x.org/a", "article", "article", None, None),
    ],
)
def test_urls(spark, url, server, batch, abstract, paper):
    u = F.col("u")
    assert one(spark, S.detect_source_type(u), u=url) == server
    assert one(spark, S.detect_input_type(u), u=url) == batch
    assert one(spark, S.arxiv_id_of_abstract(u), u=url) == abstract
    assert one(spark, S.arxiv_id(u), u=url) == paper


def test_small_scalars(spark):
    assert one(spark, S.xml_escape(F.col("t")), t="a&<b>\"'") == "a&amp;&lt;b&gt;&quot;&apos;"
    assert [one(spark, S.duration_label(F.col("s")), s=s) for s in (0, 45, 62, 120, 3661, 1)] == ["--:--", "0:45", "1:02", "2:00", "61:01", "0:01"]
    assert one(spark, S.clock(F.col("s"), F.lit(True)), s=3661.9) == "1:01:01"
    assert one(spark, S.clock(F.col("s"), F.lit(False)), s=-3.0) == "0:00"
    assert one(spark, S.rfc2822(F.try_to_timestamp(F.col("t"))), t="2026-04-14 14:59:47") == "Tue, 14 Apr 2026 14:59:47 +0000"
    assert one(spark, S.rfc2822(F.try_to_timestamp(F.col("t"))), t="x") == ""
    for text, want in (("HTTP 503", True), ("Quota gone", True), ("overloaded", True), ("401", False), ("connection refused", False)):
        assert one(spark, S.is_outage(F.col("t")), t=text) is want
    assert tuple(one(spark, S.title_and_text(F.col("t")), t="TITLE: A b\nrest")) == ("A b", "rest")
    assert tuple(one(spark, S.title_and_text(F.col("t")), t="rest")) == ("Untitled PDF", "rest")
    assert one(spark, S.atom_title(F.col("t")), t="<feed><title>f</title><entry><title>A\n b</title></entry></feed>") == "A  b"
    assert one(spark, S.parse_sections_json(F.col("t")), t='[{"title":"a"}]') is None
    assert one(spark, S.parse_sections_json(F.col("t")), t="[]") == []
    assert one(spark, S.parse_sections_json(F.col("t")), t="{bad") is None
    assert one(spark, S.chapters_json(S.parse_sections_json(F.col("t"))), t="{bad") == '{"version":"1.2.0","chapters":[]}'
    assert one(spark, S.file_stem(F.col("t")), t="/a/b.c.md.md") == "b.c"
    assert one(spark, S.strip_code_fence(F.col("t")), t="```json\n{}\n```") == "{}"
    assert one(spark, S.max_output_tokens(F.col("n")), n=9000) == 5048
    assert tuple(one(spark, S.square_crop(F.col("w"), F.col("h")), w=10, h=7)) == (7, 1, 0)
    assert one(spark, D.page_count(F.col("t")), t="Title: x\nPages:  12\n") == 12
    assert one(spark, D.key_of_url(F.col("u"), ["a.example", "b.example"]), u="https://b.example/episodes/1.mp3") == "episodes/1.mp3"
    assert one(spark, S.render_markdown_headers(F.col("t")), t="## A <b>\nx") == "<h2>A &lt;b&gt;</h2>\nx"


def test_replies_and_outlines(spark):
    from wordloom.functions import names as N

    reply = lambda t: tuple(one(spark, N.reply(F.col("t")), t=t))
    assert reply('{"candidates":[{"content":{"parts":[{"text":"a"},{"x":1},{"text":"b"}]}}],"usageMetadata":{"promptTokenCount":3}}') == ("ab", None, 3, 0)
    assert reply('{"candidates":[{"finishReason":"SAFETY","content":{"parts":[{"text":""}]}}]}') == (None, "empty: SAFETY", 0, 0)
    assert reply("{}") == (None, "no parts", 0, 0)
    assert one(spark, N.outline(F.col("t")), t='```\n{"sections":[]}\n```')["intro_line"] is None
    assert one(spark, N.outline(F.col("t")), t='{"intro_line":"x"}') is None
    assert one(spark, N.json_or_null(F.col("t")), t="{bad") is None
    assert [one(spark, N.window_days(F.col("t")), t=t) for t in ("7", "x", "")] == [7, None, None]
    assert one(spark, N.fixed_width((F.lit("ab"), 4), (F.lit(12), -4), (F.lit("toolong"), 3)), t="") == "ab     12 toolong"
    assert one(spark, N.paper_fault(F.col("t")), t=" " * 600 + "x") is not None and one(spark, N.paper_fault(F.col("t")), t="x" * 500) is None
    assert one(spark, N.cover_brief(F.lit("T"), F.col("t")), t=" \n\t") == "T"
