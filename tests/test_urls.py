"""URL expressions against the standard library, on golden, boundary and generated cases."""

import random
from urllib.parse import parse_qs, urldefrag, urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from webcorpus.functions import urls

BASE = "https://a.com/x/y?q=1#f"
GOLDEN = {
    "": "https://a.com/x/y?q=1",
    "#z": "https://a.com/x/y?q=1",
    "?r=2": "https://a.com/x/y?r=2",
    "//c.com/p": "https://c.com/p",
    "p": "https://a.com/x/p",
    "../../../p": "https://a.com/p",
    "./": "https://a.com/x/",
    "a//b": "https://a.com/x/a/b",
    " /sp ace ": "https://a.com/sp ace",
    "mailto:a@b": "mailto:a@b",
    "HTTP://A.com/Z": "HTTP://A.com/Z",
    "http:foo": "http:foo",
    "http://[bad": "",
    "/für": "https://a.com/für",
}
BASES = [
    BASE, "http://a.com", "http://a.com/", "https://a.com/x/", "https://a.com/x//y/z;p=1?q", "http://u:p@h:8/d/e.html#t",
    "", "mailto:x@y", "ftp://f/a/b", "file:///etc/x", "http:x/y", "//n/p", "rel/path", "http://[::1]/a", "http://[bad/a",
    "https://a.com/x;m/y;n", "x", "javascript:void(0)", "HTTPS://A.COM/B/C",
]
LINKS = [
    *GOLDEN, ".", "..", "../", "./p", "../p/./q/../r", "/..", "/../p", "/a/../../b/", "/a/./b/.", "/a/b/..", "a/..", "a/.",
    ";x", "p;x", "p;", "/p;x;y", "../;x", "p?", "p#", "p?#", "?", "#", "?#", "/p?q#f", "//", "///p", "////p", "//h", "//h?q", "//h:1/..",
    "http:", "http:/p", "http://", "https:", "https:p", "https:/p", "https:?q", "https://A.com/B#c", "HTTPS://A.com/B", "data:text/plain,x#y", "javascript:void(0)#a",
    "a:b", "1:b", "a b", "\ta\nb", "\x00a", "a\x00", " \u00a0a\u3000 ", "\u2028", "http://a\uff0fb/", "http://a\u2100/", "http://[::1]/", "http://[1.2.3.4]/",
    "http://[v1.x]/", "http://[::ffff:1.2.3.4]:8/p", "http://[1:2:3:4:5:6:7:8]/", "http://[1::8::9]/", "http://]x/", "/x//y", "x//", "//x//y/../z", "/a;b/c;d", "tel:1;x#", "svn+ssh://h/p/../q",
    "/.hidden", "/a/.hidden/..b", "a/b/c/../../../../d", "?a=b/../c", "#/../x", "/%2e%2e/x", "é/ü/..", "x:/y", "http://h\\p",
]


def stdlib(base, link):
    try:
        return urldefrag(urljoin(base, link))[0].strip()
    except Exception:
        return ""


def resolved(spark, pairs):
    df = spark.createDataFrame([(i, b, u) for i, (b, u) in enumerate(pairs)], "i int, b string, u string")
    df = df.withColumn("base", urls.base_parts("b")).select("i", urls.resolve("u", "base").alias("r"))
    return [r.r for r in sorted(df.collect(), key=lambda r: r.i)]


def check(spark, pairs):
    wrong = [
        (pair, got, stdlib(*pair)) for pair, got in zip(pairs, resolved(spark, pairs)) if got != stdlib(*pair)
    ]
    assert not wrong, wrong[:10]


def test_golden(spark):
    assert dict(zip(GOLDEN, resolved(spark, [(BASE, link) for link in GOLDEN]))) == GOLDEN


def test_every_base_with_every_link(spark):
    check(spark, [(b, u) for b in BASES for u in LINKS])


def test_generated_links(spark):
    rng = random.Random(7)
    pieces = ["/", "//", "..", ".", "a", "b;c", ";", "?", "#", "q=1", ":", "http:", "https://h", "é", " ", "%41", "[", "]", "@", "x.y", "\t"]
    text = lambda n: "".join(rng.choice(pieces) for _ in range(rng.randint(0, n)))
    bases = ["http://h/" + text(5) for _ in range(60)] + [text(5) for _ in range(40)]
    check(spark, [(rng.choice(bases), text(7)) for _ in range(4000)])


def test_parts_match_stdlib(spark):
    good = [u for u in BASES + LINKS if stdlib("http://h/", u) != ""]
    good = [u for u in good if "[bad" not in u]
    df = spark.createDataFrame([(u,) for u in good], "u string").select(
        "u",
        urls.domain(F.col("u")).alias("domain"),
        urls.root_domain(F.col("u")).alias("root"),
        urls.is_static_asset(F.col("u")).alias("static"),
        urls.base_of(F.col("u")).alias("base"),
    )
    for row in df.collect():
        parts = urlparse(row.u)
        labels = parts.netloc.lower().split(".")
        assert row.domain == parts.netloc.lower()
        assert row.root == (".".join(labels[-2:]) if len(labels) >= 2 else parts.netloc.lower())
        assert row.base == f"{parts.scheme}://{parts.netloc}"


@pytest.mark.parametrize(
    "url, static",
    [
        ("http://h/a.PNG", True), ("http://h/a.png?x", True), ("http://h/a.png;v=1", True), ("http://h/a.js", False),
        ("http://h/a?b.png", False), ("http://h/a.png/", False), ("http://h/.css", True), ("http://h.zip", False),
    ],
)
def test_static_assets(spark, url, static):
    assert spark.range(1).select(urls.is_static_asset(F.lit(url))).first()[0] is static


def test_param_names(spark):
    import re

    cases = [
        "http://h/?a=1&b=&c&d=x=y&=z&a=2", "http://h/?a%20b=1&c+d=2&e%zz=3&f%41=4", "http://h/p&q=1", "http://h/#?x=1",
        "http://h/?a-b=1&a.b[]=2", "http://h/", "http://h/?a=1;b=2", "http://h/?a=1#b=2&c=3", "http://h/?é=1&%C3%A9x=2",
    ]
    df = spark.createDataFrame([(u,) for u in cases], "u string").select("u", urls.param_names(F.col("u")).alias("n"))
    for row in df.collect():
        expected = set(parse_qs(urlparse(row.u).query)) | set(re.findall(r"[?&]([a-zA-Z0-9_\[\]\.]+)=", row.u))
        assert sorted(row.n) == sorted(expected), row.u


def test_capture_keys_and_clean_names(spark):
    row = spark.range(1).select(
        urls.capture_key(F.lit("https://a.com/x/y")).alias("a"),
        urls.capture_key(F.lit("http://a.com/" + "z" * 200), 150).alias("b"),
        urls.clean_param_name(F.lit("a b[0]-c_d.é")).alias("c"),
    ).first()
    assert row.a == "a.com_x_y" and len(row.b) == 150 and row.c == "ab[0]-c_d"
