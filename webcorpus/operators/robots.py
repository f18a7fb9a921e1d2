"""Robots rules from captured robots files, and the URLs they allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcorpus.functions import patterns, urls

USER_AGENT = "webcorpus/1.0"


def robots_lines(robots: DataFrame) -> DataFrame:
    """``base, line_no, event, value``: blank lines, agents, rules and delay lines of readable files."""
    readable = robots.filter(F.col("http_status") < 400)
    lines = readable.select("base", F.posexplode(F.split("body", patterns.LINE_BREAK)).alias("line_no", "raw"))
    text = urls.strip_space(F.regexp_replace("raw", "(?s)#.*", ""))
    field = F.lower(urls.strip_space(F.substring_index("text", ":", 1)))
    value = urls.percent_decode(urls.strip_space(F.regexp_replace("text", r"(?s)\A[^:]*+:", "")))
    event = (
        F.when(F.col("raw") == "", "blank")
        .when(~F.contains("text", F.lit(":")), None)
        .when(field == "user-agent", "agent")
        .when(field.isin("allow", "disallow"), field)
        .when(field.isin("crawl-delay", "request-rate"), "delay")
    )
    return (
        lines.withColumn("text", text)
        .select("base", "line_no", event.alias("event"), value.alias("value"))
        .filter(F.col("event").isNotNull())
    )


def _prefixed(text: Column, prefix: str) -> Column:
    """``prefix`` before a non-empty text; mentions ``text`` once, so long expressions are not copied."""
    return F.regexp_replace(text, r"(?s)\A(?=.)", prefix)


def _rule_path(value: Column) -> Column:
    """A rule's path the way it is compared: empty parts dropped, percent-encoded."""
    clean = urls.clean_url(value)
    scheme = F.regexp_replace(urls.scheme(clean), r"(?<=.)\z", ":")
    return urls.percent_encode(F.concat(scheme, _prefixed(urls.netloc(clean), "//"), _after_host(clean)))


def _after_host(clean: Column) -> Column:
    return F.concat(
        F.regexp_replace(urls.path(clean), r"(?s)((?:\A|/)[^/;]*+);\z", "$1"),
        _prefixed(urls.query(clean), "?"),
        _prefixed(urls.fragment(clean), "#"),
    )


RULE = "struct<line_no:int,path:string,allow:boolean>"


def _no_rules() -> Column:
    return F.array().cast(f"array<{RULE}>")


def parsed_lines(body: Column) -> Column:
    """``array<struct<line_no, event, value, path>>``: the blank, agent, rule and delay lines of a robots body, in order.

    The same reading as ``robots_lines``, but inside the row: comments go, a line without a colon is no line.
    """
    cut = F.transform(F.split(body, patterns.LINE_BREAK), lambda line, i: F.struct(
        i.alias("line_no"), line.alias("raw"), urls.strip_space(F.regexp_replace(line, "(?s)#.*", "")).alias("text")
    ))
    field = lambda l: F.lower(urls.strip_space(F.substring_index(l["text"], ":", 1)))
    read = F.transform(cut, lambda l: F.struct(
        l["line_no"].alias("line_no"),
        F.when(l["raw"] == "", "blank").when(~F.contains(l["text"], F.lit(":")), None)
        .when(field(l) == "user-agent", "agent").when(field(l).isin("allow", "disallow"), field(l))
        .when(field(l).isin("crawl-delay", "request-rate"), "delay").alias("event"),
        urls.percent_decode(urls.strip_space(F.regexp_replace(l["text"], r"(?s)\A[^:]*+:", ""))).alias("value"),
    ))
    kept = F.filter(read, lambda l: l["event"].isNotNull())
    return F.transform(kept, lambda l: F.struct(
        l["line_no"], l["event"], l["value"],
        F.when(l["event"].isin("allow", "disallow"), _rule_path(l["value"])).alias("path"),
    ))


def robots_rules(robots: DataFrame, user_agent: str = USER_AGENT) -> DataFrame:
    """``base, rules``: the rules that bind ``user_agent``, in file order; one row per readable file that has binding rules.

    Lines form groups: agents, then rules; an agent after a rule or after a blank line opens the next. The first group naming
    the agent wins, the first ``*`` group is the fallback. The lines are read by one fold over the row's own array, an
    automaton whose state is the open group and the best closed group so far: no explode, no window, no exchange, one scan
    of the robots table. The table holds one file per base, as ``robots_decisions`` assumes.
    """
    token = F.lower(F.substring_index(F.lit(user_agent), "/", 1))
    start = F.struct(
        F.lit(None).cast("string").alias("prev"), F.lit(None).cast("string").alias("opened"),
        F.lit(False).alias("dflt"), F.lit(False).alias("named"), F.lit(False).alias("has"), _no_rules().alias("rules"),
        F.lit(None).cast(f"struct<dflt:boolean,rules:array<{RULE}>>").alias("best"),
    )

    def closed(acc: Column) -> Column:
        """The best group once the open one is closed: a named group beats any default, else the earlier one wins."""
        usable = acc["has"] & (acc["dflt"] | acc["named"])
        better = usable & (acc["best"].isNull() | (acc["best"]["dflt"] & ~acc["dflt"]))
        return F.when(better, F.struct(acc["dflt"].alias("dflt"), acc["rules"].alias("rules"))).otherwise(acc["best"])

    def step(acc: Column, line: Column) -> Column:
        event = line["event"]
        opens = (event == "agent") & F.coalesce(acc["prev"] != "agent", F.lit(True))
        binding = event.isin("allow", "disallow", "delay") & F.coalesce(acc["opened"] == "agent", F.lit(False))
        agent = F.when(event == "agent", F.lower(line["value"]))
        kept = lambda name: F.when(opens, F.lit(False)).otherwise(acc[name])
        rule = F.struct(line["line_no"].alias("line_no"), line["path"].alias("path"), ((event == "allow") | (line["value"] == "")).alias("allow"))
        return F.struct(
            event.alias("prev"),
            F.when(event.isin("agent", "blank"), event).otherwise(acc["opened"]).alias("opened"),
            (kept("dflt") | F.coalesce(agent == "*", F.lit(False))).alias("dflt"),
            (kept("named") | F.coalesce(F.contains(token, agent), F.lit(False))).alias("named"),
            (kept("has") | binding).alias("has"),
            F.concat(
                F.when(opens, _no_rules()).otherwise(acc["rules"]),
                F.when(binding & event.isin("allow", "disallow"), F.array(rule)).otherwise(_no_rules()),
            ).alias("rules"),
            F.when(opens, closed(acc)).otherwise(acc["best"]).alias("best"),
        )

    rules = F.aggregate(parsed_lines(F.col("body")), start, step, lambda acc: closed(acc)["rules"])
    readable = robots.filter(F.col("http_status") < 400)
    return readable.select("base", rules.alias("rules")).where(F.col("rules").isNotNull())


def robots_decisions(robots: DataFrame, user_agent: str = USER_AGENT) -> DataFrame:
    """``base, verdict, rules``: one row per captured robots file."""
    verdict = (
        F.when(F.col("http_status").isin(401, 403), False)
        .when(F.col("http_status").between(400, 499), True)
        .when(F.col("http_status") >= 500, False)
    )
    return robots.select("base", verdict.alias("verdict")).join(
        robots_rules(robots, user_agent), "base", "left"
    )


def compared_path(url: Column) -> Column:
    """The part of a URL that rules are compared with: everything after the host, encoded."""
    after = _after_host(urls.clean_url(urls.percent_decode(url)))
    encoded = urls.percent_encode(F.regexp_replace(after, r"\A(?=//)", "//"))
    return F.regexp_replace(encoded, r"\A\z", "/")


def robots_allowed(
    links: DataFrame, robots: DataFrame, user_agent: str = USER_AGENT, url: str = "url"
) -> DataFrame:
    """``links`` with ``allowed``. One row per base on the right, so no pairs of URL and rule are made;
    a base that holds a third of all URLs is split by AQE's skew join."""
    decisions = robots_decisions(robots, user_agent).withColumnRenamed("base", "_base")
    judged = links.withColumn("_base", urls.base_of(F.col(url))).withColumn(
        "_path", compared_path(F.col(url))
    ).join(decisions, "_base", "left")
    first = F.try_element_at(
        F.filter("rules", lambda rule: (rule["path"] == "*") | F.startswith(F.col("_path"), rule["path"])),
        F.lit(1),
    )["allow"]
    return judged.withColumn("allowed", F.coalesce("verdict", first, F.lit(True))).drop(
        "_base", "_path", "verdict", "rules"
    )
