"""Joins, robots, crawl, reports and streams on small tables with known answers."""

import random
from urllib import robotparser

import pytest
from pyspark.sql import functions as F

from webcorpus.functions import forms
from webcorpus.operators import assets, crawl, exposure, extract, joins, robots, scope
from webcorpus.plans import findings, report, run
from webcorpus.session import STREAM_SETTINGS, new_folder, shared_folder
from webcorpus.sources import captures
from webcorpus.streaming import ingest


def urls_frame(spark, urls):
    return spark.createDataFrame([(u,) for u in urls], "url string")


def domains(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "domain string")


HOSTS = [
    "http://example.com/", "http://EXAMPLE.com/a", "http://www.example.com/", "http://notexample.com/", "http://example.com:8080/",
    "http://u@example.com/", "http://a.example.com:8080/", "http://b.net/", "http://sub.b.net/", "/relative", "http:///x", "http://example.com/",
]


@pytest.mark.parametrize("small", [True, False])
def test_in_scope_keeps_bags(spark, monkeypatch, small):
    monkeypatch.setattr(scope, "is_small", lambda df: small)
    allowed = ["example.com", "www.example.com", "b.net", "example.com:8080"]
    kept = scope.in_scope(urls_frame(spark, HOSTS), domains(spark, *allowed)).collect()
    host = lambda u: u.split("/")[2].lower() if u.startswith("http://") else ""
    expected = [u for u in HOSTS if any(host(u) == d or host(u).endswith("." + d) for d in allowed)]
    assert sorted(r.url for r in kept) == sorted(expected)


def test_allowed_domains(spark):
    of = lambda *a, **k: {r.domain for r in scope.allowed_domains(spark, *a, **k).collect()}
    assert of("https://Sub.Example.com/x") == {"sub.example.com"}
    assert of("https://Sub.Example.com/x", include_subdomains=True, extra=["b.net"]) == {"sub.example.com", "example.com", "b.net"}


def test_targets(spark):
    targets = urls_frame(spark, ["http://a", "HTTPS://b", "ftp://c", "a.com", "javascript:x"])
    assert {r.url for r in scope.valid_targets(targets).collect()} == {"http://a", "HTTPS://b"}
    assert {r.url for r in scope.rejected_targets(targets).collect()} == {"ftp://c", "a.com", "javascript:x"}


def test_small_side_is_measured(spark):
    assert joins.is_small(domains(spark, "a", "b"), max_rows=2)
    assert not joins.is_small(domains(spark, "a", "b", "c"), max_rows=2)
    assert not joins.is_small(domains(spark, "a" * 100), max_bytes=50)


def test_content_gate_and_errors(spark):
    rows = [
        (1, "u1", "h", 200, {"content-TYPE": "text/html"}, None, None), (2, "u2", "h", 200, {"Content-Type": "image/png"}, None, None),
        (3, "u3", "h", 500, None, None, None), (4, "u4", "h", 200, {"Content-Type": "TEXT/HTML"}, None, None),
        (5, "u5", None, None, None, "late", "2024-01-02 00:00:00"), (6, "u5", None, None, None, "early", "2024-01-01 00:00:00"),
    ]
    frame = spark.createDataFrame(
        rows, "page_id long, url string, html string, status int, headers map<string,string>, error string, ts string"
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    gated = captures.content_gate(captures.fetched(frame)).orderBy("page_id").collect()
    assert [(r.html, r.status) for r in gated] == [("h", 200), ("", 200), ("h", 500), ("", 200)]
    assert [tuple(r) for r in captures.page_errors_latest(frame).collect()] == [("u5", "late")]


def test_json_captures(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"page_id": 1, "url": "u", "html": "<a>", "status": 200, "headers": {"X": "y"}}\n')
    row = captures.read_pages(spark, str(tmp_path), "json").first()
    assert (row.page_id, row.status, row.headers) == (1, 200, {"X": "y"})


def test_overlay_and_assets(spark):
    pages = spark.createDataFrame([(1, "u", "old"), (2, "u", "old2"), (3, "v", "kept")], "page_id int, url string, html string")
    rendered = spark.createDataFrame([("u", "new")], "url string, html string")
    got = assets.render_overlay(pages, rendered).orderBy("page_id")
    assert got.columns == pages.columns and [r.html for r in got.collect()] == ["new", "new", "kept"]
    js = spark.createDataFrame([("p", "a"), ("q", "a"), ("p", "b"), ("p", "data:x")], "page_url string, js_url string")
    stored = spark.createDataFrame([("a", 200, "A"), ("b", 404, "B"), ("c", 200, "C")], "url string, status int, body string")
    assert [tuple(r) for r in assets.js_asset_join(js, stored).collect()] == [("a", "A")]


def test_exposed_files(spark):
    rows = [
        ("http://h/.env", 200, {"content-length": "7"}), ("http://h/.git/HEAD", 200, None), ("http://h/id_rsa", 301, None), ("http://h/robots.txt", 403, None),
        ("http://other/.env", 200, None), ("http://h/x/.env", 200, None), ("http://h/.env?x", 200, None), ("HTTP://h/.env", 200, None),
    ]
    responses = spark.createDataFrame(rows, "url string, status int, headers map<string,string>")
    got = exposure.exposed_files(responses, urls_frame(spark, ["http://h/start?q"]))
    assert sorted(map(tuple, got.collect())) == [("http://h/.env", 200, "7"), ("http://h/.git/HEAD", 200, "?")]


def test_robots_against_stdlib(spark):
    rng = random.Random(5)
    lines = [
        "", " ", "User-agent: *", "user-agent: WebCorpus", "User-agent: corp # x", "User-agent: other", "Disallow: /a", "Allow: /a/b", "Disallow:", "Disallow: /",
        "Allow: /p%20q", "Disallow: /x?y=1", "disallow : /é", "Crawl-delay: 3", "Sitemap: http://h/s", "Disallow /bad", "# note", "Disallow: /s;t", "Request-rate: 1/2",
        "Disallow: *", "Allow: /A",
    ]
    paths = ["", "/", "/a", "/a/b/c", "/A", "/p q", "/p%20q", "/x?y=1&z", "/x", "/é", "/%C3%A9", "/s;t", "/s", "/*", "/b#f", "//d", "/a%2Fb"]
    bodies = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 12))) for _ in range(150)]
    files = [(f"http://h{i}", 200, b) for i, b in enumerate(bodies)]
    links = [(base, base + p) for base, _, _ in files for p in paths]
    files += [("http://h401", 401, ""), ("http://h404", 404, ""), ("http://h500", 503, ""), ("http://hnone", None, None)]
    more = [f"http://{h}/q" for h in ("h401", "h404", "h500", "hnone", "unknown")]
    frame = spark.createDataFrame(files, "base string, http_status int, body string")
    got = {r.url: r.allowed for r in robots.robots_allowed(urls_frame(spark, [u for _, u in links] + more), frame).collect()}
    for base, _, body in files[: len(bodies)]:
        parser = robotparser.RobotFileParser()
        parser.parse(body.splitlines())
        for path in paths:
            assert got[base + path] == parser.can_fetch(robots.USER_AGENT, base + path), (body, path)
    assert [got[u] for u in more] == [False, True, False, True, True]


def test_robots_rules_are_read_inside_the_row(spark):
    frame = spark.createDataFrame(
        [("http://a", 200, "User-agent: *\nDisallow: /x"), ("http://b", 200, "User-agent: other\nDisallow: /"), ("http://c", 500, "")],
        "base string, http_status int, body string",
    )
    rules = robots.robots_rules(frame)
    plan = rules._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Generate" not in plan, plan
    assert sorted((r.base, [(x.path, x.allow) for x in r.rules]) for r in rules.collect()) == [("http://a", [("/x", False)])]


def test_scripts_are_addressed_by_content(spark):
    lib = 'fetch("/api/v1/x");var k="/graphql/q";'
    js_urls = spark.createDataFrame(
        [(f"http://p{i}", f"http://cdn{i}/lib.js") for i in range(6)] + [("http://p", "http://h/a.js"), ("http://p", "http://h/b.js")],
        "page_url string, js_url string",
    )
    js_assets = spark.createDataFrame(
        [(f"http://cdn{i}/lib.js", 200, lib) for i in range(6)] + [("http://cdn0/lib.js", 200, lib)]
        + [("http://h/a.js", 200, 'fetch("/a")'), ("http://h/a.js", 200, 'fetch("/b")'), ("http://h/b.js", 404, 'fetch("/c")'),
           ("http://other/z.js", 200, 'fetch("/z")')],
        "url string, status int, body string",
    )
    scripts = assets.script_dictionary(js_urls, js_assets)
    assert scripts.bodies.count() == 2
    joined = sorted(map(tuple, assets.js_asset_join(js_urls, js_assets).collect()))
    assert joined == sorted([(f"http://cdn{i}/lib.js", lib) for i in range(6)] + [("http://h/a.js", 'fetch("/b")')])
    found = sorted(map(tuple, assets.searched(scripts, extract.endpoints).collect()))
    plain = sorted(map(tuple, extract.endpoints(assets.js_asset_join(js_urls, js_assets)).collect()))
    assert found == plain and {r[0] for r in found} >= {f"http://cdn{i}/lib.js" for i in range(6)}


def test_latest_script_capture_wins(spark):
    js_urls = spark.createDataFrame([("http://p", "http://h/a.js")], "page_url string, js_url string")
    js_assets = spark.createDataFrame(
        [("http://h/a.js", 200, "zzz", 1), ("http://h/a.js", 200, "aaa", 2), ("http://h/a.js", 200, "bbb", 2)],
        "url string, status int, body string, at int",
    )
    assert [tuple(r) for r in assets.js_asset_join(js_urls, js_assets, "at").collect()] == [("http://h/a.js", "bbb")]


def test_overlay_of_bucketed_tables_moves_nothing(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS captures LOCATION '{tmp_path}/warehouse'")
    pages = spark.createDataFrame(
        [(i, f"http://h/{i % 7}", f"<p>{i}</p>") for i in range(40)] + [(99, None, "<p>x</p>")], "page_id long, url string, html string"
    )
    rendered = spark.createDataFrame(
        [(f"http://h/{i % 5}", f"<b>{i}</b>", i) for i in range(12)] + [("http://elsewhere/", "<b>e</b>", 1)],
        "url string, html string, at int",
    )
    assets.write_by_url(pages, "captures.pages", 4)
    assets.write_latest_by_url(rendered, "captures.rendered", 4, captured_at="at")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large to broadcast
    try:
        got = assets.overlay_written(spark.table("captures.pages"), spark.table("captures.rendered"))
        plan = got._jdf.queryExecution().executedPlan().toString()
        rows = sorted(map(tuple, got.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan, plan
    assert rows == sorted(map(tuple, assets.render_overlay(pages, rendered, "at").collect()))
    spark.sql("DROP DATABASE captures CASCADE")


def brute_force_depths(edges, start, depth):
    seen, frontier = {start: 0}, [start]
    for level in range(1, depth + 1):
        frontier = sorted({b for a, b in edges if a in frontier} - set(seen))
        seen.update({u: level for u in frontier})
    return seen


def test_crawl_depth_on_graphs_with_cycles_and_hubs(spark):
    rng = random.Random(2)
    edges = [(f"n{rng.randint(0, 30)}", f"n{rng.randint(0, 30)}") for _ in range(45)] + [(f"n{i}", "n0") for i in range(31)]
    frame = spark.createDataFrame(edges + edges[:10], "src string, dst string")
    start = urls_frame(spark, ["n0"])
    got = crawl.crawl_depth(frame, start, max_depth=4)
    expected = brute_force_depths(edges, "n0", 4)
    assert {r.url: r.depth for r in got.collect()} == expected
    for cap in (1, 5, 12, 500):
        first = sorted((d, u) for u, d in expected.items())[:cap]
        assert [(r.depth, r.url) for r in crawl.crawl_capped(frame, start, 4, cap).collect()] == first
    assert {r.url for r in crawl.crawl_depth(frame, start, max_depth=0).collect()} == {"n0"}


def test_crawl_of_pages(spark):
    link = lambda *hrefs: "".join(f"<a href='{h}'>" for h in hrefs)
    pages = [
        (0, "http://h/", link("/a", "/pic.png", "http://out/", "mailto:x@y", "/#top")), (1, "http://h/a", link("b", "/blocked")),
        (2, "http://h/b", link("/deep")), (3, "http://h/blocked", link("/behind")), (4, "http://h/deep", link("/deeper")),
    ]
    frame = spark.createDataFrame(pages, "page_id int, url string, html string")
    rules = spark.createDataFrame([("http://h", 200, "User-agent: *\nDisallow: /blocked")], "base string, http_status int, body string")
    edges = crawl.crawl_edges(frame, domains(spark, "h"), rules)
    got = crawl.crawl_depth(edges, urls_frame(spark, ["http://h/"]), max_depth=3)
    assert {r.url: r.depth for r in got.collect()} == {
        "http://h/": 0, "http://h/a": 1, "http://h/b": 2, "http://h/blocked": 2, "http://h/deep": 3,
    }


def small_site(spark):
    pages = [
        (1, "http://h/?id=1", "<script src=/j.js></script><form method=post><input name=admin></form><!-- comment one -->a@b.cc"),
        (2, "http://h/?id=2", "<script src=/j.js></script><script>f('/api/x')</script><!-- comment two --><!-- comment three -->"),
        (3, "http://h/empty?x=1", ""), (4, "http://h/none", None),
    ]
    js = [("http://h/j.js", 200, "f('/api/x');f('/v1/y'); secret='0123456789abcdef'")]
    return (
        spark.createDataFrame(pages, "page_id long, url string, html string"),
        spark.createDataFrame(js, "url string, status int, body string"),
    )


def test_findings_of_a_small_site(spark):
    pages, js = small_site(spark)
    found = findings.corpus_findings(pages, js)
    assert {r.metric: r.value for r in findings.summary_counts(found).collect()} == {
        "internal_urls": 4, "js_files": 1, "api_paths": 2, "full_urls": 0, "forms": 1, "risky_forms": 1, "emails": 1,
        "params": 2, "idor_candidates": 1, "secrets": 1,
    }
    assert found.filter("section = 'params'").select("value").distinct().count() == 2  # the empty page feeds none


def test_findings_are_local_to_a_page(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    whole = findings.page_findings(pages)
    parts = findings.page_findings(pages.filter("page_id < 20")).unionByName(findings.page_findings(pages.filter("page_id >= 20")))
    key = lambda df: sorted(map(str, df.drop("form").collect()))
    assert key(whole) == key(parts)


@pytest.fixture
def uncoalesced(spark):
    """Keep shuffle partitions apart that AQE would merge for being small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_numbering_spreads_a_hot_group(spark, uncoalesced):
    rows = [("hot", f"k{i:04d}") for i in range(900)] + [("cold", "z"), ("cold", "a")]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "section string, k string").repartition(4)
    got = report.numbered(frame, "section", ["k"])
    assert {(r.section, r.k): r.pos for r in got.collect()} == {
        **{("hot", f"k{i:04d}"): i for i in range(900)}, ("cold", "a"): 0, ("cold", "z"): 1,
    }
    assert got.filter("section = 'hot'").select(F.spark_partition_id()).distinct().count() > 1


def test_json_report_round_trip(spark, tmp_path):
    pages, js = small_site(spark)
    exposed = spark.createDataFrame([("http://h/.env", 200, "7")], "url string, status int, content_length string")
    errors = spark.createDataFrame([("http://h/e", "timeout")], "url string, error string")
    found = findings.corpus_findings(pages.unionByName(pages.withColumn("page_id", F.col("page_id") + 10)), js, exposed, errors)
    for _ in range(2):  # writing a run again replaces it
        path = report.write_json_report(found, "http://h/x", str(tmp_path / "report"), "a")
    report.write_json_report(found, "http://h/x", str(tmp_path / "report"), "b")
    assert path == str(tmp_path / "report" / "target_key=h_x" / "run=a")
    rows = [r.asDict(recursive=True) for r in spark.read.json(path).collect()]
    of = lambda section, *names: sorted(tuple(r[n] for n in names) for r in rows if r["section"] == section)
    assert {r["target"] for r in rows} == {"http://h/x"}
    assert of("emails", "value") == [("a@b.cc",)]
    assert of("internal_urls", "value") == [("http://h/?id=1",), ("http://h/?id=2",), ("http://h/empty?x=1",), ("http://h/none",)]
    assert of("js_files", "value") == [("http://h/j.js",)]
    assert of("js_endpoint_findings", "category", "value") == [("api_paths", "/api/x"), ("api_paths", "/v1/y")]
    assert of("params", "value") == [("admin",), ("id",)]
    assert of("idor_candidates", "value") == [("id",)] and of("admin_param_candidates", "value") == [("admin",)]
    form = ("http://h/?id=1", "http://h/?id=1", "POST")
    assert of("forms", "found_on", "action", "method") == [form] * 2
    assert [r["inputs"] for r in rows if r["section"] == "forms"] == [[{"name": "admin", "type": "text"}]] * 2
    assert of("form_risk_flags", "found_on", "action", "method") == [form] * 2
    assert of("comments", "source", "comment")[0] == ("http://h/?id=1", "comment one")
    assert of("interesting_files", "url", "status", "content_length") == [("http://h/.env", 200, "7")]
    assert of("errors", "url", "error") == [("http://h/e", "timeout")]
    assert [r["source"] for r in rows if r["section"] == "secrets"] == ["http://h/j.js"]
    assert len(rows) == spark.read.json(str(tmp_path / "report" / "target_key=h_x" / "run=b")).count()


def test_stream_equals_batch(spark, sf):
    stream = ingest.page_stream(spark, f"{sf}/page[s].parquet", captures.PAGE_SCHEMA)
    stored = ingest.run_available(ingest.stream_findings(stream), new_folder(spark, "test-findings"))
    batch = findings.page_findings(spark.read.parquet(f"{sf}/pages.parquet"))
    columns = ["section", "category", "source", "page_key", "pos", "value"]
    key = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert key(stored) == key(batch)


def test_visits_inside_the_watermark_are_dropped(spark, tmp_path):
    folder = tmp_path / "in"
    for batch, rows in enumerate([[("u", 0), ("u", 10), ("v", 20)], [("u", 30), ("w", 100_000)], [("x", 100_030)], [("u", 100_060), ("late", 5)]]):
        frame = spark.createDataFrame(rows, "url string, s long").select("url", F.timestamp_seconds("s").alias("at"))
        frame.coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema("url string, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(folder))
    stored = ingest.run_available(ingest.first_visits(stream, "at", "1 minute").select("url"), str(tmp_path / "out"))
    # "u" comes back long after the watermark passed it; a row older than the watermark is not let in. Both
    # take effect one batch after the watermark has moved.
    assert sorted(r.url for r in stored.collect()) == ["u", "u", "v", "w", "x"]


def test_spread_visits_give_the_same_set(spark, tmp_path):
    rows = [(f"p{i}", "hot" if i % 3 else f"u{i % 50}", i) for i in range(600)]
    frame = spark.createDataFrame(rows, "page_url string, url string, s long")
    frame.select("page_url", "url", F.timestamp_seconds("s").alias("at")).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("page_url string, url string, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stored = ingest.run_available(ingest.first_visits(stream, "at", "1 day", spread_by="page_url").select("url"), str(tmp_path / "out"))
    assert sorted(r.url for r in stored.collect()) == sorted({u for _, u, _ in rows})


def test_visited_urls_are_exact_and_go_on_after_a_stop(spark, tmp_path):
    """Far apart, out of order, over several triggers: nothing is forgotten or let in twice, nor after a restart."""
    for key, value in STREAM_SETTINGS.items():
        spark.conf.set(key, value)
    rng = random.Random(8)
    frame = lambda names: spark.createDataFrame([(n,) for n in names], "url string").coalesce(1)
    old = [f"u{i}" for i in range(200)]
    for k in range(4):
        frame(rng.sample(old, 200 if k else 150)).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: ingest.visited_urls(
        spark.readStream.schema("url string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    )
    try:
        first = ingest.run_available(stream(), str(tmp_path / "out"))
        assert sorted(r.url for r in first.collect()) == sorted(old)
        frame(["u3", "new", "new"]).write.mode("append").parquet(str(tmp_path / "in"))
        again = ingest.run_available(stream(), str(tmp_path / "out"))
        assert sorted(r.url for r in again.collect()) == sorted([*old, "new"])
    finally:
        for key in STREAM_SETTINGS:
            spark.conf.unset(key)


def test_visited_set_in_batches_resumes_and_writes_once(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS crawl LOCATION '{tmp_path}/warehouse'")
    rng = random.Random(9)
    frame = lambda names: spark.createDataFrame([(n,) for n in names], "url string").coalesce(1)
    old = [f"u{i}" for i in range(200)]
    for k in range(4):
        frame(rng.sample(old, 200 if k else 150) + ["hot"] * 50 + [None]).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("url string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    try:
        first = ingest.visited_in_batches(stream(), "crawl.visited", str(tmp_path / "out"), buckets=4)
        assert sorted(r.url for r in first.collect()) == sorted([*old, "hot"])
        frame(["u3", "new", "new"]).write.mode("append").parquet(str(tmp_path / "in"))
        again = ingest.visited_in_batches(stream(), "crawl.visited", str(tmp_path / "out"), buckets=4)
        assert sorted(r.url for r in again.collect()) == sorted([*old, "hot", "new"])  # each URL stored once
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = ingest.unseen(frame(["hot"] * 9 + ["x"]), "crawl.visited", 7, 4)._jdf.queryExecution().executedPlan().toString()
        scan = [line for line in plan.splitlines() if "crawl.visited" in line]
        assert len(scan) == 1 and "Bucketed: true" in scan[0], plan
        assert plan.count("Exchange") == 1 and "HashAggregate" in plan.split("Exchange")[1], plan  # partial first, then dealt
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE crawl CASCADE")


def test_every_line_is_a_capture_or_an_error(spark, tmp_path):
    lines = [
        '{"page_id": 1, "url": "http://h/a", "html": "<p>a</p>", "status": 200}',
        '{"page_id": 2, "url": "http://h/b", "html": "<p>b", ',
        '{"page_id": "three", "url": "http://h/c", "html": "x", "status": 200}',
        "not json at all",
        "",
        '{"page_id": 4, "url": "http://h/d", "error": "timeout", "ts": "2024-01-02 00:00:00"}',
    ]
    (tmp_path / "c.json").write_text("\n".join(lines) + "\n")
    got = captures.read_captures(spark, str(tmp_path))
    rows = sorted(((r.url, r.error is None, r.html) for r in got.collect()), key=str)
    assert len(rows) == 5  # the blank line is no record
    assert (("http://h/a", True, "<p>a</p>")) in rows and sum(1 for r in rows if r[1]) == 1
    errors = {r.url: r.error for r in captures.page_errors_latest(got).collect()}
    assert errors["http://h/d"] == "timeout"
    assert errors["http://h/b"].startswith(captures.MALFORMED) and errors["http://h/c"].startswith(captures.MALFORMED)
    assert errors[None].startswith(captures.MALFORMED + ": not json")
    assert [r.url for r in captures.fetched(got).collect()] == ["http://h/a"]


def test_a_url_captured_twice_counts_once(spark):
    js = spark.createDataFrame([("p", "a")], "page_url string, js_url string")
    stored = spark.createDataFrame([("a", 200, "old", 2), ("a", 200, "new", 5), ("a", 404, "gone", 9)], "url string, status int, body string, at int")
    assert [tuple(r) for r in assets.js_asset_join(js, stored, "at").collect()] == [("a", "new")]
    assert [tuple(r) for r in assets.js_asset_join(js, stored).collect()] == [("a", "old")]
    pages = spark.createDataFrame([(1, "u", "plain")], "page_id int, url string, html string")
    copies = spark.createDataFrame([("u", "x", 1), ("u", "a", 2)], "url string, html string, at int")
    assert [r.html for r in assets.render_overlay(pages, copies, "at").collect()] == ["a"]


def test_fields_of_unclosed_tags_take_linear_time():
    import time

    start = time.process_time()
    found = forms.forms_of(["form"] + ["b"] * 100_000 + ["input name=x"] * 100_000)
    assert len(found[0]["inputs"]) == 100_000 and time.process_time() - start < 10


def test_large_scans_are_not_spread(spark, sf, monkeypatch):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert captures.spread(pages).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(captures, "SPREAD_BYTES", 10)
    assert captures.spread(pages).rdd.getNumPartitions() == pages.rdd.getNumPartitions()


def test_crawls_past_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(crawl, "measure", lambda df: joins.Size(df.count(), False))
    frame = spark.createDataFrame([(f"n{i}", f"n{(i * k + 1) % 50}") for i in range(50) for k in (2, 3)], "src string, dst string")
    got = {r.url: r.depth for r in crawl.crawl_depth(frame, urls_frame(spark, ["n0"]), max_depth=4).collect()}
    assert got == brute_force_depths([tuple(r) for r in frame.collect()], "n0", 4)


def test_bucketed_edges_move_only_the_frontier(spark, monkeypatch):
    monkeypatch.setattr(crawl, "measure", lambda df: joins.Size(df.count(), False))
    pairs = [(f"n{i}", f"n{(i * k + 1) % 50}") for i in range(50) for k in (2, 3)] + [("n0", f"n{i}") for i in range(50)]
    frame = spark.createDataFrame(pairs + pairs[:20] + [(None, "n1"), ("n2", None)], "src string, dst string")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = {r.url: r.depth for r in crawl.crawl_depth(frame, urls_frame(spark, ["n3"]), max_depth=4, buckets=buckets).collect()}
    assert got == {r.url: r.depth for r in crawl.crawl_depth(frame, urls_frame(spark, ["n3"]), max_depth=4).collect()}
    assert got == brute_force_depths(pairs, "n3", 4)
    edges = crawl.bucketed_edges(frame, buckets)
    frontier = spark.createDataFrame([(f"n{i}",) for i in range(0, 50, 7)], "src string")
    with_conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = edges.join(frontier, "src")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan and f"SelectedBucketsCount: {buckets} out of {buckets}" in plan
        assert sorted(tuple(r) for r in joined.collect()) == sorted(set((a, b) for a, b in pairs if int(a[1:]) % 7 == 0))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_conf)


def test_frontier_follows_batches_of_edges(spark, tmp_path):
    rng = random.Random(5)
    pairs = [(f"n{rng.randint(0, 40)}", f"n{rng.randint(0, 40)}") for _ in range(90)] + [("n1", "n39"), ("n39", "n40")]
    batches = [pairs[60:], [], pairs[:30] + [(None, "n2"), ("n3", None)], pairs[30:60] + pairs[:5]]
    start = urls_frame(spark, ["n1", "n7"])
    folder, seen = str(tmp_path / "frontier"), []
    depths = lambda df: {r.url: r.depth for r in df.collect()}
    for batch_id, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "src string, dst string")
        crawl.frontier_merge(frame, start, folder, batch_id, max_depth=5)
        if batch_id == 2:  # run again after a failure: nothing counts twice
            crawl.frontier_merge(frame, start, folder, batch_id, max_depth=5)
        seen += [r for r in rows if None not in r]
        whole = crawl.crawl_depth(spark.createDataFrame(seen or [("n1", "n1")], "src string, dst string"), start, max_depth=5)
        assert depths(crawl.frontier_depths(spark, folder)) == depths(whole)
    arriving = tmp_path / "arriving"
    for i, rows in enumerate(batches):
        spark.createDataFrame([r for r in rows if None not in r], "src string, dst string").coalesce(1).write.parquet(str(arriving / f"b{i}"))
    stream = spark.readStream.schema("src string, dst string").option("maxFilesPerTrigger", 1).parquet(str(arriving / "b*"))
    got = ingest.crawl_frontier(stream, start, str(tmp_path / "streamed"), max_depth=5)
    assert depths(got) == depths(whole)


def test_run_reaches_only_what_the_crawl_visits(spark):
    pages = [(1, "http://h/#top", "<a href='/a'>a@b.cc"), (2, "http://h/a", "<a href='/c'>"), (3, "http://h/far", "x@y.zz"), (4, "http://h/c", "c@c.cc")]
    frame = spark.createDataFrame([(*p, 200, None) for p in pages], "page_id long, url string, html string, status int, headers map<string,string>")
    found = run.full_run(frame, domains(spark, "h"), urls_frame(spark, ["http://h/"]), max_depth=3, max_pages=2)
    assert {r.value for r in found.filter("section = 'internal_urls'").collect()} == {"http://h/#top", "http://h/a"}
    assert {r.value for r in found.filter("section = 'emails'").collect()} == {"a@b.cc"}


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for frame in (extract.page_links(pages), extract.html_comments(pages), extract.inline_scripts(pages), extract.emails(pages), extract.js_files(pages)):
        plan = plan_of(frame)
        assert "Python" not in plan and "Exchange" not in plan and plan.count("FileScan") == 1
    assert "ReadSchema: struct<url:string,html:string>" in plan_of(extract.emails(pages))
    assert "ReadSchema: struct<url:string>" in plan_of(extract.internal_urls(pages))
    summary = plan_of(findings.summary_counts(findings.corpus_findings(pages)))
    assert summary.count("FileScan") == 1 and "NestedLoop" not in summary and "Cartesian" not in summary
    python = [line for line in plan_of(findings.page_findings(pages)).split("\n") if "ArrowEvalPython" in line or "Generate" in line]
    assert len(python) == 3 and "ArrowEvalPython" in python[1]  # between two generators: its rows are findings, without html
    scoped = plan_of(scope.in_scope(extract.page_links(pages), domains(spark, "example.com")))
    assert "BroadcastHashJoin" in scoped and "NestedLoop" not in scoped


def test_merged_runs_equal_one_run_and_merge_once(spark, tmp_path):
    schema = "section string, category string, value string"
    rows = [("emails", "", f"a{i}@h.io") for i in range(40)] + [("params", "", "id")] * 3 + [("forms", "", "x")]
    whole = spark.createDataFrame(rows, schema)
    first, second = spark.createDataFrame(rows[:25], schema), spark.createDataFrame(rows[25:], schema)
    table, folder = "merge_test", str(tmp_path / "store")
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    try:
        findings.merge_findings(first, table, folder, "r1", parts=8)
        files = lambda: {
            p.name: p.stat().st_mtime_ns for p in (tmp_path / "store" / "findings").rglob("*.parquet")
        }
        before = files()
        merged = findings.merge_findings(second, table, folder, "r2", parts=8)
        key = lambda df: sorted(tuple(r) for r in df.collect())
        assert key(merged) == key(findings.distinct_findings(whole))
        again = findings.merge_findings(second, table, folder, "r2", parts=8)
        assert key(again) == key(merged)
        # a run of one value rewrites one partition only
        one = spark.createDataFrame([("emails", "", "a0@h.io")], schema)
        after = files()
        findings.merge_findings(one, table, folder, "r3", parts=8)
        kept = {name for name, stamp in files().items() if after.get(name) == stamp}
        assert len(kept) >= len(after) - 1 > 0 and set(before) & set(after)
        assert findings.merge_findings(one.limit(0), table, folder, "r4", parts=8).count() == 41
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
