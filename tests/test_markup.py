"""Markup expressions against a tree built with the standard library, plus rules it does not share."""

import random
import re

import dom
import pytest
from pyspark.sql import functions as F

from webcorpus.functions import extracted, markup, texts
from webcorpus.functions import patterns as P
from webcorpus.functions.text_sql import quoted
from webcorpus.operators import classify, extract

CASES = [
    "<a href=/x>1</a><a href='/y'>2</a><A HREF=\"/z\">3</A>",
    "<a data-href='/no' href=\"/yes\">", "<a title=\"x href=/no\" href=/yes>", "<a href>", "<a href=''>", "<a>", "<a href=/1 href=/2>",
    "<a href = /sp >", "<a\nhref=\n'/nl'\n>", "<a href=/a/>", "<a href='/a'/>", "<abbr href=/no><a-b href=/no>", "<link href=/l/><area href=/m>",
    "<!-- <a href=/no> --><a href=/yes>", "<script>var x='<a href=/no>';</script><a href=/yes>", "<style><a href=/no></style><a href=/yes>",
    "<a href=\"/q?a=1&amp;b=2&lt;&#65;&#x42;&eacute;&nosuch;\">", "<a href='/x>y'>", "<a href=/é>", "<div class=a><a href=/in></div>",
    "<a href=/a\"b>", "<a x='>' href=/gt>", "<!DOCTYPE html><a href=/d>", "<?php echo '<a href=/no' ?><a href=/y>", "<a/href=/slash>", "< a href=/no>", "<a href=/x", "<3 <a href=/y>",
    "<script src=/s.js></script><script src='/t.js' /><script>a()</script><SCRIPT type=text/x>b</SCRIPT>", "<script></script><script> </script><script src></script>",
    "<script>if (a<b) { '</p>' }</script>", "<script data-src=x>c</script>", "<script>x</script >y<script>z</script\n>",
    "<form></form>", "<form action=/a method=post><input name=a><textarea name=b></textarea><select name=c><option></select></form><input name=out>",
    "<form method=''><input type=FILE name=f><input type=file></form>", "<form><input name=a", "<form><input name=a>", "<form action='/x'><div><input name=a></form><input name=b></div>",
    "<div><form><input name=a></div><input name=b></form>", "<form id=1><form id=2><input name=a></form><input name=b></form><input name=c>",
    "<table><tr><form><td><input name=a></td></tr><tr><td><input name=b></td></tr></form></table>", "<p><form><p><input name=a></p><input name=b></form>",
    "</form><form><br><input/><img><input name=x /></form>", "<form><span/><input name=a></span><input name=b></form>", "<!-- <form> --><form><!-- </form> --><input name=a></form>",
    "<form action=\"?a&amp;b\"><input name='&quot;q&quot;' type></form>", "<FORM METHOD=Post><INPUT NAME=CSRF></FORM>", "<select><form></select><input name=a></form>",
    "<form><form/><input name=a></form>", "plain text", "", "<", "<>", "</>", "<!>", "<a href=a><b></a><a href=b>",
]


def run(spark, pages, **columns):
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string").withColumn(
        "scripts", extracted.script_elements("html")
    )
    rows = df.select("i", *[c.alias(n) for n, c in columns.items()]).collect()
    return [r for r in sorted(rows, key=lambda r: r.i)]


def columns():
    tags = f"transform({markup.link_tags_sql('html')}, t -> {markup.attribute_sql('t', 'href')})"
    sources = f"transform(scripts, e -> {markup.attribute_sql(markup.opening_tag_sql('e'), 'src')})"
    return {
        "hrefs": F.expr(f"array_compact({tags})"),
        "sources": F.expr(f"array_compact({sources})"),
        "inline": extracted.inline_bodies("scripts"),
        "forms": extracted.raw_forms("html"),
    }


def check(spark, pages):
    for html, row in zip(pages, run(spark, pages, **columns())):
        assert set(row.hrefs) == dom.hrefs(html), html
        assert set(row.sources) == dom.script_sources(html), html
        assert row.inline == dom.inline(html), html
        got = [(f.action, f.method, [tuple(i) for i in f.inputs]) for f in row.forms or []]
        assert got == dom.forms(html), html


def test_hand_written_pages(spark):
    check(spark, CASES)


def test_given_pages(spark, sf):
    complete = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect() if "</script>" in r.html]
    check(spark, complete)


def test_generated_pages(spark):
    rng = random.Random(11)
    pieces = [
        "<form>", "<form action=/a method=POST>", "</form>", "<input name=a>", "<input type=file name='b c'/>", "<select name=s>", "</select>",
        "<div>", "</div>", "<p>", "</p>", "<table>", "</table>", "<tr>", "</tr>", "<br>", "<br/>", "<span/>", "<a href=/x>", "</a>", "<a href='/y&amp;z'>",
        "<script>s('<form>')</script>", "<script src=/j.js></script>", "<style>p{}</style>", "<!-- <form> -->", "text", " > ", " < ", "=x", "<LINK HREF=/l>",
    ]
    check(spark, ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(1500)])


@pytest.mark.parametrize(
    "html, found",
    [
        ("<title><a href=/no></title><a href=/yes>", ["/yes"]),  # text-only elements hold no tags
        ("<textarea><a href=/no></textarea><a href=/yes>", ["/yes"]),
        ("<a href=/yes><!-- never closed <a href=/no>", ["/yes"]),
        ("<a href=/yes><a href=\"/no><a href=/no>", ["/yes"]),  # an open quote takes the rest
        ("<!--><a href=/yes>", ["/yes"]),
        ("<!-- x --!><a href=/yes>", ["/yes"]),
        ("<a href='/c?a=1&copy=2&copy;'>", ["/c?a=1&copy=2©"]),  # no reference right before "="
        ("<a href='&#0;&#xD800;&#x110000;&#128;&#00065;&#x1F600;'>", ["���€A😀"]),
        ("<a href=/" + "a" * 200_000 + ">", ["/" + "a" * 200_000]),
        ("<a " + "x=1 " * 100_000 + "href=/many>", ["/many"]),
        ("<a href=\"" + "&amp;" * 20_000 + "\">", ["&" * 20_000]),
    ],
)
def test_tokenizer_rules(spark, html, found):
    assert run(spark, [html], hrefs=columns()["hrefs"])[0].hrefs == found


def test_script_without_end_runs_to_the_end(spark):
    assert run(spark, ["<script>a</p>b"], inline=columns()["inline"])[0].inline == ["a</p>b"]


def test_escape(spark):
    assert spark.range(1).select(markup.escape_html(F.lit("&<>\"'&amp;"))).first()[0] == "&amp;&lt;&gt;&quot;'&amp;amp;"


def test_emails_and_endpoints_equal_the_base_patterns(spark):
    rng = random.Random(3)
    pieces = [
        "a@b.com", "x", "_", "@", ".", "co", "'", '"', " ", "/api/v1", "/graphql", "swagger", "openapi", ".json", "http://h/p", "https://", "wss://w", "ws://",
        "bkt.s3.amazonaws.com", ".s3-eu-west-1", ".amazonaws.com", "p.firebaseio.com", "-", "/rest/", "V2", "<", ")", "\n", " ", "é", "/",
    ]
    pages = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    cols = {c: F.expr(texts.endpoints_of_sql("html", c)) for c in P.ENDPOINT_PATTERNS}
    for html, row in zip(pages, run(spark, pages, emails=texts.emails("html"), **cols)):
        assert set(row.emails) == set(re.findall(P.EMAIL, html)), html
        for category, pattern in P.ENDPOINT_PATTERNS.items():
            flags = re.I if category in P.ENDPOINT_IGNORE_CASE else 0
            assert set(row[category]) == set(re.findall(pattern, html, flags)), (category, html)


def test_long_runs_are_linear(spark):
    import time

    for filler in ("a", "a.", "a@", '"/api', "'swagger", ".s3", "<", "<a ", "<a x=\">\" ", "</", "<!", "<!--", "<script>", "<form ", "&", "token='"):
        text = filler * (200_000 // len(filler))
        cols = {c: F.size(F.expr(texts.endpoints_of_sql("html", c))) for c in P.ENDPOINT_PATTERNS}
        start = time.perf_counter()
        run(
            spark, [text + " @ .amazonaws.com .firebaseio.com graphql swagger ://"], emails=F.size(texts.emails("html")),
            comments=F.size(texts.telling_comments("html")), secrets=F.size(F.expr(texts.secrets_sql("html"))),
            links=F.expr(f"size({markup.link_tags_sql('html')})"), bodies=F.size(extracted.inline_bodies("scripts")), forms=F.size(extracted.raw_forms("html")), **cols,
        )
        assert time.perf_counter() - start < 12, filler


def test_comments(spark):
    html = "<!--12345--><!-- 123456 --><!-- \n1234567\t --><!---->" + "<!--" + "y" * 400 + "--><script><!--in script--></script>"
    rows = extract.html_comments(spark.createDataFrame([("u", html)], "url string, html string")).collect()
    assert [(r.pos, len(r.comment)) for r in rows] == [(0, 6), (1, 7), (2, 300), (3, 9)]


def test_secret_previews_hide_the_value(spark):
    values = ["hunter2hunter2", "8charsXX", "AKIA" + "A1B2" * 4, "0123456789abcdef0123456789abcdef", "aaaaaaaaaaaaaaaa"]
    body = "\n".join(f'Password: "{v}"' for v in values) + "\n-----BEGIN RSA PRIVATE KEY-----"
    rows = extract.secrets(spark.createDataFrame([("s", body)], "source string, body string")).collect()
    assert {r.type for r in rows} == {"assignment", "aws_access_key", "private_key"}
    assert not any(v in r.value_preview for r in rows for v in values)
    assert "aaaa…aaaa" not in [r.value_preview for r in rows]  # too regular to be a secret


def test_form_flags(spark):
    pages = [
        (0, "http://h/a", "<form method=post action=/x#f><input name=n></form>"),
        (1, "http://h/b", "<form><input name=User_PASSword><input type=file></form>"),
        (2, "http://h/c", "<form method=POST action='http://[x'><input name=authenticity><input type=FILE></form>"),
        (3, "http://h/d", "<form method=''><input name=pass></form>"),
    ]
    found = extract.forms(spark.createDataFrame(pages, "page_id int, url string, html string"))
    assert {r.found_on: (r.action, r.method, r.csrf_protected) for r in found.collect()} == {
        "http://h/a": ("http://h/x", "POST", False), "http://h/b": ("http://h/b", "GET", False),
        "http://h/c": ("http://h/c", "POST", True), "http://h/d": ("http://h/d", "", False),
    }
    assert {r.found_on: r.issues for r in classify.form_flags(found).collect()} == {
        "http://h/a": [P.ISSUE_NO_CSRF], "http://h/b": [P.ISSUE_PASSWORD_GET, P.ISSUE_FILE],
    }


def test_param_flags(spark):
    names = ["id", "userId", "USER_ID", "cust_id", "customer_id", "identity", "id\n", "xid", "is_admin", "Debug", "staff_id", "ıd"]
    rows = classify.param_flags(spark.createDataFrame([(n,) for n in names + names], "name string")).collect()
    assert {r.name for r in rows if r.is_idor} == {"id", "userId", "USER_ID", "cust_id", "customer_id", "id\n", "ıd"}
    assert {r.name for r in rows if r.is_admin} == {"is_admin", "Debug", "staff_id"} and len(rows) == len(names)


def test_expressions_take_any_column_name(spark):
    df = spark.createDataFrame([("http://h/p", "x")], "o string, k string")
    assert quoted("a'b\\") == "'a\\'b\\\\'" and df.count() == 1
