"""Scalar functions against plain-Python models."""

import re
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from engram.functions import text as X
from engram.functions.chunking import SPACE, split_text
from engram.functions.html import page_content
from engram.functions.parsing import markdown_content, parse_bytes
from engram.schemas import CONFLICT, EXTRACTED_FACTS


def values(spark, column, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "i int, t string").select("i", column(F.col("t")).alias("x"))
    return [r.x for r in frame.orderBy("i").collect()]


def test_uuid3_matches_python(spark):
    names = ["", "bob", "Zoë", "日本", "shared-general-knowledge", "default-user", "x" * 500]
    assert values(spark, X.uuid3, names) == [str(uuid.uuid3(uuid.NAMESPACE_DNS, n)) for n in names]


def test_trim_space_matches_unicode_white_space(spark):
    texts = [" a b ", " 　x \n", "\t\v\f\r\n", "", "\x1cx\x1f", "x​", "a\n", "  in  ner  "]
    assert values(spark, X.trim_space, texts) == [t.strip(SPACE) for t in texts]


def model_scrub(text):
    text = re.sub(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[EMAIL_REDACTED]", text)
    text = re.sub(r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "[IP_REDACTED]", text, flags=re.ASCII)
    phone = r"\+?[0-9]{1,4}?[-.\s]?\(?[0-9]{1,3}?\)?[-.\s]?[0-9]{1,4}[-.\s]?[0-9]{1,4}[-.\s]?[0-9]{1,9}"
    return re.sub(
        phone, lambda m: "[PHONE_REDACTED]" if len(re.sub("[^0-9]", "", m[0])) >= 7 else m[0], text,
        flags=re.ASCII,
    )


def test_scrub_samples(spark):
    texts = [
        "My phone is +1-555-0199. and 12345 and (555) 123-4567 x 2024-01-01",
        "a@b.co_c@d.org x@y", "é1.2.3.4 and 1.2.3.4.5", "", "A.B+c@EX-ample.Org!", "1" * 40,
        "x" * 20000 + "@", ("a." * 3000) + "@b.c", "@a@b.cd@e.fg",
    ]
    assert values(spark, X.scrub, texts) == [model_scrub(t) for t in texts]
    assert values(spark, X.scrub, texts[:1])[0] == (
        "My phone is [PHONE_REDACTED]. and 12345 and ([PHONE_REDACTED] x [PHONE_REDACTED]"
    )


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("aZ0.19@-+_ (%)\n", max_size=40), min_size=40, max_size=80))
def test_scrub_random(spark, texts):
    assert values(spark, X.scrub, texts) == [model_scrub(t) for t in texts]
    clean = values(spark, X.scrub, ["[EMAIL_REDACTED] [IP_REDACTED] [PHONE_REDACTED]"])
    assert clean == ["[EMAIL_REDACTED] [IP_REDACTED] [PHONE_REDACTED]"]


def test_attributes_and_aliases(spark):
    names = ["company", "Former_Company", "x_list", "listing", "hobby", "medications", "visited_x", "my_interest_rate"]
    assert values(spark, X.is_singular, names) == [True, False, False, True, False, False, False, False]
    said = ["User ", "john", "", "Bob", "speaker"]
    assert values(spark, X.is_self_alias, said) == [True, False, False, False, True]
    assert values(spark, lambda c: X.is_self_alias(c, F.lit("BOB"), blank=True), said) == [True, False, True, True, True]
    assert values(spark, lambda c: X.is_self_alias(c, aliases=("john",)), said) == [False, True, False, False, False]


def test_replies_and_tags(spark):
    replies = ["```json\n[1]\n```", " [] ", "``` {} ```", "", "x"]
    assert values(spark, X.strip_code_fence, replies) == ["[1]", None, "{}", None, "x"]
    assert values(spark, X.split_tags, ["a, b,, c ", ""]) == [["a", "b", "c"], []]
    assert values(spark, X.page_count, ["a\fb\f", "a", ""]) == [2, 1, 0]


def test_sources(spark):
    urls = ["http://x/a.PDF?q", "https://docs.google.com/document/d/A-b_1/edit", "http://DOCS.google.com/x", "http://x/a.pdf/y"]
    assert values(spark, X.source_type, urls) == ["pdf", "google_docs", "web_page", "web_page"]
    assert values(spark, X.google_doc_id, urls) == [None, "A-b_1", None, None]
    assert values(spark, lambda c: X.source_type(c, F.lit("pdf")), urls[2:3]) == ["pdf"]
    assert values(spark, X.file_type, ["a.PDF", "b.md", "c.d.Markdown", "e", "f.txt"]) == ["pdf", "markdown", "markdown", None, None]


CHUNK_TEXT = (
    "Otters sleep on their backs and hold hands while floating down slow rivers. Some of them carry stones. "
    "Nobody knows which stone an otter will pick when it has several good ones."
)


def test_chunker_sample():
    assert split_text(CHUNK_TEXT, 100, 20) == [
        # the last twenty bytes of a chunk open the next one; the last sentence gets a second dot
        "Otters sleep on their backs and hold hands while floating down slow rivers.",
        "ng down slow rivers. Some of them carry stones.",
        "f them carry stones. Nobody knows which stone an otter will pick when it has several good ones..",
    ]
    assert split_text("", 10, 2) == [] and split_text(" \n ", 10, 2) == []
    assert split_text("xxxxxxxxxxxx", 5, 1)[0].startswith("x x x")


@settings(max_examples=200, deadline=None)
@given(st.text("ab é.\n?!", max_size=300), st.integers(5, 60), st.integers(0, 10))
def test_chunker_keeps_words(text, size, overlap):
    joined = " ".join(split_text(text, size, overlap))
    for word in re.findall(r"[^ \n]+", text):
        if len(word.encode()) < size:
            assert word.rstrip(".?!") in joined


def test_markdown():
    text = "---\ntitle: River Notes\nauthor: Mia Berg\ntags: otter, stone, water\n---\n# First Steps\nBody."
    body, metadata = markdown_content(text)
    assert body == "# First Steps\nBody."
    assert metadata == {"title": "River Notes", "author": "Mia Berg", "tags": "otter, stone, water"}
    assert markdown_content("---\ntitle: x\nno end") == ("---\ntitle: x\nno end", {})
    assert markdown_content("---\r\na: [1, true]\r\n---\r\nb")[1] == {"a": "[1 true]"}
    assert markdown_content("---\n: : bad\n  - x: [\n---\nb") == ("b", {})


def test_web_page():
    html = """<html><head><title>Otter Diary</title></head><body>
<header><nav><a href="/">Start</a></nav></header>
<main><h1>A Day at the River</h1><p>The water was cold that morning.</p></main>
<footer>All rights with the otters</footer></body></html>"""
    text, metadata = page_content(html)
    assert text == "# A Day at the River\n\nThe water was cold that morning."
    assert metadata == {"title": "Otter Diary"}


def test_web_page_rules():
    html = """<title>T &amp; U</title><meta name=description content=" d ">
<meta name="keywords" content="a, b,,"><meta property="article:tag" content="c">
<meta property="article:author" content="Ann"><div class="x sidebar">gone</div>
<h2>One<h3>Two</h3>bare<p>p1<p>p2 <b>bold<div>leaf</div><ul><li>x<li>  <li>y</ul>
<ol><li>a<li><li>c</ol><span>s</span><em><i>in</i></em><div>text<b>b</b></div>"""
    text, metadata = page_content(html)
    assert metadata == {"title": "T & U", "description": "d", "tags": "a,b,c", "author": "Ann"}
    assert text.startswith("## One\n\n\n\n### Two\n\n")
    assert "bare" not in text and "gone" not in text
    assert "p1\n\np2 bold\n\n" in text
    assert "* x\n* y\n\n" in text and "1. a\n3. c\n" in text


def test_nested_content_is_repeated():
    assert page_content("<main><article><p>x</p></article></main>")[0] == "x\n\nx"


def test_bad_bytes_are_dropped():
    assert parse_bytes("markdown", b"a\xff\xfeb")[0] == "ab"
    assert parse_bytes("zip", b"")[2].startswith("ValueError")


def test_parse_instant(spark):
    stamps = ["2024-01-02T03:04:05.678901Z", "nope", "2024-01-02T03:04:05+02:00"]
    got = [str(v) for v in values(spark, lambda c: X.parse_instant(c).cast("string"), stamps)]
    assert got == ["2024-01-02 03:04:05.678901", "0001-01-01 00:00:00", "2024-01-02 01:04:05"]


@pytest.mark.parametrize("reply, kept", [
    ('[{"attribute": "a", "value": "b", "confidence_score": 1}]', 1), ('[{"attribute": "a"}, {"value": null}]', 2),
    ('[{"attribute": "a", "value": 5}]', None), ('[{"attribute": "a", "value": "b"}, {"attribute": true}]', None),
    ('[{"attribute": "a", "value": "b", "confidence_score": "high"}]', None), ('{"attribute": "a"}', None), ('[1, 2]', None),
    ('[{"attribute": "a", "extra": [1]}]', 1), ("[", None), ("sorry", None), ("[]", None), (None, None),
])
def test_one_wrong_type_refuses_the_reply(spark, reply, kept):
    frame = spark.createDataFrame([(reply,)], "reply string")
    facts = frame.select(X.decode_reply(F.col("reply"), EXTRACTED_FACTS).alias("f")).first().f
    assert (None if facts is None else len(facts)) == kept


def test_wrong_types_in_single_replies(spark):
    rows = ['{"has_conflict": true, "conflicting_fact": "x", "reason": "y"}', '{"has_conflict": "yes"}', '[{"has_conflict": true}]', '{}']
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, reply string").orderBy("i")
    found = [r.c for r in frame.select(X.decode_reply(F.col("reply"), CONFLICT).alias("c")).collect()]
    assert found[0].has_conflict is True and found[1] is None and found[2] is None and found[3].has_conflict is None
