"""Secret scan by corpus-wide ownership: what few own and looks live is a secret, what many copy is an example.

Each text is searched once, in its task. Only hashes of candidate values leave it; they are counted by distinct owners and
repositories over the whole corpus, after removal of repeats in each task, so a value in a third of all rows is reduced before
any shuffle. Base kinds are always reported; candidates of the other kinds become spans only if their ownership and
look say that they are live.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcorpus.session import written

KINDS = ("assign", "access", "hex", "named", "format", "opaque")  # the first three are the base; in order of report
BASE_KINDS = 3
LONG = 24  # characters of the shortest opaque value

# Base patterns.
ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ASSIGN_LEAST = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 16
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")  # whole runs of at least 32
# Own patterns: further names, published key formats, opaque strings.
NAMED = re.compile(
    r"""(?i:pwd|passphrase|client_?id|access_?key|private_?key|auth|bearer|credentials?)["']?\x20*[:=]\x20*"""
    r"""["']?([A-Za-z0-9+/_.=-]{16,})""",
    re.ASCII,
)
FORMAT = re.compile(
    r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{20,}|sk_live_[A-Za-z0-9]{20,}|AIza[A-Za-z0-9_-]{35}"
    r"|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"
    r"|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}")
ASSIGN_WORDS, NAMED_WORDS = ("passw", "secret", "token", "key"), ("pwd", "phrase", "client", "key", "auth", "bearer", "cred")
FORMAT_WORDS = ("gh", "xox", "sk_live_", "AIza", "eyJ", "-----BEGIN")
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "xxxx", "test", "dummy", "sample", "0123456789", "abcdef")
ENTROPY_LEAST = 3.0  # bits a character of a live-looking value; random hex has nearly 4

FOUND = "array<struct<kind:int,start:bigint,end:bigint,hash:bigint,looks_live:boolean>>"
FOUND_ARROW = pa.list_(
    pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.int64()), ("looks_live", pa.bool_())])
)


def value_hash(value: str) -> int:
    """64-bit hash of a value; the value itself is never given out."""
    import hashlib

    return int.from_bytes(hashlib.sha256(value.encode(errors="surrogatepass")).digest()[:8], "little", signed=True)


def looks_live(value: str) -> bool:
    """Random to the eye: enough bits a character, letters and digits, no word that marks a placeholder."""
    low = value.lower()
    if any(word in low for word in PLACEHOLDERS):
        return False
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return entropy >= ENTROPY_LEAST and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def find(text: str) -> list[tuple[int, int, int, int, bool]]:
    """``kind, start, end, hash, looks_live`` of every candidate, by start and kind."""
    low = text.lower()
    found: list[tuple[int, int, int, str]] = []
    if any(word in low for word in ASSIGN_WORDS):
        found += ((0, m.start(), m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_LEAST)
    if "AKIA" in text:
        found += ((1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST)
    long = max(map(len, text.split()), default=0) >= LONG
    if long:
        found += ((2, m.start(), m.end(), m[0]) for m in HEX.finditer(text))
    more: list[tuple[int, int, int, str]] = []
    if any(word in low for word in NAMED_WORDS):
        more += ((3, m.start(), m.end(), m[1]) for m in NAMED.finditer(text))
    if any(word in text for word in FORMAT_WORDS):
        more += ((4, m.start(), m.end(), m[0]) for m in FORMAT.finditer(text))
    if long:
        more += ((5, m.start(), m.end(), m[0]) for m in OPAQUE.finditer(text))
    if more:  # not what a base span or an earlier kind has already
        covered = bytearray(len(text))
        for _, start, end, _ in found:
            covered[start:end] = b"\1" * (end - start)
        for span in more:
            _, start, end, _ = span
            if covered.find(1, start, end) < 0:
                found.append(span)
                covered[start:end] = b"\1" * (end - start)
    found.sort(key=lambda s: (s[1], s[0]))
    return [(kind, start, end, value_hash(value), looks_live(value)) for kind, start, end, value in found]


def _found(texts: pa.Array) -> pa.Array:
    names = ("kind", "start", "end", "hash", "looks_live")
    out = []
    for i in range(0, len(texts), 64):
        out += ([dict(zip(names, s, strict=True)) for s in find(t)] if t else [] for t in texts.slice(i, 64).to_pylist())
    return pa.array(out, FOUND_ARROW)


def found_in(text: str) -> Column:
    """Candidates of a column of texts.

    Marked as not deterministic, which keeps a filter on the candidates above their column. Pushed below, it would search each
    text a second time, in a second Python worker beside the first, and executors keep the workers they once started.
    """
    return F.arrow_udf(_found, FOUND).asNondeterministic()(text)


def ownership(found: DataFrame) -> DataFrame:
    """``hash, owners, repositories`` of all candidates of ``found(owner, repository, found)``."""
    values = found.select("owner", "repository", F.explode("found.hash").alias("hash"))
    return values.distinct().groupBy("hash").agg(
        F.count_distinct("owner").alias("owners"), F.count_distinct("owner", "repository").alias("repositories")
    )


def verdict(owners: Column, repositories: Column, looks: Column, most_owners: int, most_repositories: int) -> Column:
    few = (owners <= most_owners) & (repositories <= most_repositories)
    return F.when(~few, "copied").when(looks, "live").otherwise("weak")


def secret_scan(
    docs: DataFrame, owner: Column | None = None, repository: Column | None = None, most_owners: int = 2,
    most_repositories: int = 4, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``doc_id, spans`` per row of ``docs``; a span is ``start, kind_no, kind, end, hash, owners, repositories, verdict``.

    Spans are ordered by start and kind; start and end are code points, end exclusive. Kinds ``assign``, ``access`` and
    ``hex`` are all reported, with a verdict; ``named``, ``format`` and ``opaque`` only where the verdict is ``live``: at most
    ``most_owners`` owners and ``most_repositories`` repositories have the value and it looks random. ``copied`` is what more
    of them have, ``weak`` the rest. Null or empty texts have no spans; null owners count as one owner. Repeated rows stay
    rows. Other columns aren't read. An empty table gives an empty result.
    """
    owner = docs["source"] if owner is None else owner
    repository = owner if repository is None else repository
    rows = docs.select(
        docs[key].cast("bigint").alias("doc_id"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        F.coalesce(repository.cast("string"), F.lit("")).alias("repository"), docs[text].alias("text"),
    )
    rows = rows.select("doc_id", "owner", "repository", found_in("text").alias("found"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "secret-candidates")
    owned = ownership(rows)
    spans = rows.where(F.size("found") > 0).select("row", "doc_id", F.explode("found").alias("s"))
    spans = spans.select("row", "doc_id", "s.*").join(owned, "hash")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    spans = spans.withColumn(
        "verdict", verdict(F.col("owners"), F.col("repositories"), F.col("looks_live"), most_owners, most_repositories)
    ).where((F.col("kind") < BASE_KINDS) | (F.col("verdict") == "live"))
    span = F.struct("start", F.col("kind").alias("kind_no"), kind.alias("kind"), "end", "hash", "owners", "repositories", "verdict")
    lists = spans.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    # Rows without spans, or whose candidates were all dropped, come from the other side of the join.
    some = rows.where(F.size("found") > 0).select("row", "doc_id").join(lists.select("row", "spans"), "row", "left")
    none = rows.where(F.size("found") == 0).select("doc_id", F.lit(None).cast(lists.schema["spans"].dataType).alias("spans"))
    every = some.select("doc_id", "spans").unionAll(none)
    return every.select("doc_id", F.coalesce("spans", F.array().cast(lists.schema["spans"].dataType)).alias("spans"))


def masked(docs: DataFrame, most_owners: int = 2, most_repositories: int = 4, mask: str = "[secret]") -> DataFrame:
    """``docs`` (``doc_id, text, lang, source, n_chars``) with every live value's span replaced by ``mask``.

    Only texts that have candidates are shuffled, to meet the verdicts on their spans.
    """
    columns = docs.columns
    owner, repository = F.coalesce("source", F.lit("")), F.concat_ws("/", "source", "lang")
    scanned = docs.withColumn("_found", found_in("text"))
    small = docs.select("doc_id", owner.alias("owner"), repository.alias("repository"),
                        F.xxhash64("text").alias("text_hash"), found_in("text").alias("found"))
    small = written(small.where(F.size("found") > 0), "secret-candidates")
    spans = small.select("doc_id", "text_hash", F.explode("found").alias("s")).select("doc_id", "text_hash", "s.*").distinct()
    judged = spans.join(ownership(small), "hash").where(
        verdict(F.col("owners"), F.col("repositories"), F.col("looks_live"), most_owners, most_repositories) == "live"
    )
    lists = judged.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    some = scanned.where(F.size("_found") > 0).drop("_found").withColumn("_hash", F.xxhash64("text"))
    met = some.join(
        lists.withColumnsRenamed({"doc_id": "_id", "text_hash": "_text"}),
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text")), "left",
    )
    # Pieces between spans: overlapping ones count as one.
    state = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    step = lambda s, x: F.struct(
        F.when(x["start"] >= s["at"], F.concat(s["out"], F.substr("text", s["at"].cast("int") + 1, (x["start"] - s["at"]).cast("int")), F.lit(mask)))
        .otherwise(s["out"]).alias("out"),
        F.greatest(s["at"], x["end"]).alias("at"),
    )
    cut = F.aggregate("_spans", state, step, lambda s: F.concat(s["out"], F.substr("text", s["at"].cast("int") + 1)))
    met = met.withColumn("text", F.when(F.col("_spans").isNotNull(), cut).otherwise(F.col("text")))
    met = met.withColumn("n_chars", F.when(F.col("_spans").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return scanned.where(F.size("_found") == 0).select(columns).unionAll(met.select(columns))
