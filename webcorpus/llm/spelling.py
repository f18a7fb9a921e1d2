"""Spelling variants grouped by pivotal bigrams: words one edit apart, and the frequent form each variant points to.

Candidate search is a pivotal prefix filter for edit distance ``TAU = 1`` over positional bigrams. Bigrams are ordered
globally by their document frequency among words (rare first, then by text). A word's prefix is its bigrams whose order is at
most that of its third bigram (``Q * TAU + 1`` = 3; ties stay in). Its pivots are two disjoint bigrams of the prefix (positions
at least two apart), chosen by a small dynamic programme that minimises their summed order. Two words within one edit share
a pivot of one with a bigram in the prefix of the other: each edit breaks at most one of two disjoint bigrams, and the
surviving one is no later in the order than the end of the longer prefix. The one edit lies before the surviving bigram, and
then both words are equal from it to their end, or behind it, and then they are equal up to it. So pivots are joined to
prefixes on that part of the word, which begins or ends with the bigram, and on the length; candidates whose letters differ
by more than one edit can cause are left out, and every other is verified by ``levenshtein``. Nothing is capped; a bigram
that everyone has is no pivot of anyone who has a rarer one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcorpus.session import written

# Fixed values of the contract.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DROP_DIVISOR = 97
MIN_LENGTH = 5
MIN_COUNT = 3
FORM_RATIO = 2
TAU, Q = 1, 2

RUN = f"[{LETTERS}]{{{MIN_LENGTH},}}"  # a maximal run, and not one too short for a word: deleting never makes it longer


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``: distinct altered runs of at least 5 code points that occur at least 3 times in all texts.

    A run is lower-cased in A-Z only. With ``h`` the unsigned crc32 of the UTF-8 ``<key>:<run>``, a run with ``h`` divisible by 97
    loses its code point ``h % length`` (from 0). A null text has no runs; a null key is written as the empty string. Repeated rows
    count every time. Counting is a partial aggregate: a word that a third of all rows hold is combined in each task first.
    """
    runs = docs.select(F.col(key).cast("string").alias("_key"), F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))).alias("_run"))
    ascii_only = F.octet_length("_run") == F.length("_run")
    runs = runs.select(F.when(ascii_only, F.lower("_run")).otherwise(F.translate("_run", UPPER, LOWER)).alias("_low"), "_key")
    runs = runs.select("_low", F.crc32(F.concat(F.coalesce("_key", F.lit("")), F.lit(":"), "_low").cast("binary")).alias("_h"))
    cut = F.concat(F.expr("substring(_low, 1, _h % length(_low))"), F.expr("substring(_low, _h % length(_low) + 2)"))
    words = runs.select(F.when(F.col("_h") % DROP_DIVISOR == 0, cut).otherwise(F.col("_low")).alias("word"))
    counted = words.where(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= MIN_COUNT)


def prefixes(words: DataFrame) -> DataFrame:
    """``word, prefix, end, pivots, letters``: the prefix of every word as ``array<struct<ord, pos>>`` in order, the ``ord`` of its
    third bigram, which ends it, the positions (from 0) of its two pivots, and 64 bits for the letters it holds.

    ``ord`` is the number of words that hold a bigram, then the bigram's two letters, in one number. The prefix keeps every
    bigram whose ``ord`` is no later than the third's. The pivots are the disjoint pair of the prefix of smallest summed ``ord``.
    The dynamic programme over the prefix collapses for two pivots: with ``e1`` the first bigram, the cheapest pair is either
    ``e1`` with the first bigram at least two positions from it, or the two bigrams right beside ``e1`` (any cheaper pair
    without ``e1`` must avoid the first disjoint one, so both of its members touch ``e1``). Linear in the prefix, also for
    a run of one repeated letter, whose prefix is all of it. The table of bigrams is bounded by the alphabet (``LETTERS`` without
    capitals, squared: 8,100 rows), so it is broadcast and no bigram, however common, is a key that rows are dealt by.

    ``letters`` has two bits for each of 32 classes of letters: one is there, and a second one is. A letter more or less in a class
    changes one bit at most.
    """
    grams = F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))")
    held = words.select(F.explode(F.array_distinct(grams)).alias("gram")).groupBy("gram").agg(F.count("*").alias("freq"))
    order = held.select("gram", F.expr("freq * 65536 + ascii(gram) * 256 + ascii(substring(gram, 2, 1))").alias("ord"))
    ranked = words.select("word", F.posexplode(grams).alias("pos", "gram")).join(F.broadcast(order), "gram")
    ranked = ranked.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("ord", "pos"))).alias("_all"))
    ranked = ranked.select("word", F.expr("filter(_all, x -> x.ord <= _all[2].ord)").alias("prefix"), F.expr("_all[2].ord").alias("end"))
    pair = lambda x, y: f"named_struct('c', {x}.ord + {y}.ord, 'p', array({x}.pos, {y}.pos))"
    choose = F.expr(
        "array_min(filter(array("
        f"  {pair('prefix[0]', 'try_element_at(filter(prefix, y -> abs(y.pos - prefix[0].pos) >= 2), 1)')},"
        f"  {pair('try_element_at(filter(prefix, y -> y.pos = prefix[0].pos - 1), 1)', 'try_element_at(filter(prefix, y -> y.pos = prefix[0].pos + 1), 1)')}"
        "), p -> p.c IS NOT NULL)).p"
    )
    bit = "shiftleft(1L, c + 32 * cast(shiftright(m, c) & 1 AS int))"
    letters = f"aggregate(transform(sequence(1, length(word)), i -> ascii(substring(word, i, 1)) % 32), 0L, (m, c) -> m | {bit})"
    return ranked.select("word", "prefix", "end", choose.alias("pivots"), F.expr(letters).alias("letters"))


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, b``: ordered pairs of distinct words exactly one edit apart, both ways. Candidates are verified, so none is wrong.

    A pivot of ``a`` meets the prefix of ``b`` only where ``a``'s prefix ends no later than ``b``'s: the lemma needs no other
    direction, and the pair is found from the other side otherwise. The key is a hash of the part that the edit leaves whole
    (``head``: up to the bigram's end, ``tail``: from its start) and of ``b``'s length, which is ``a``'s or one more or less. Where
    ``a`` has no letter outside that part, none can be replaced or deleted there. A replacement changes two bits of ``letters`` at
    most, an insertion or deletion one.
    """
    table = written(prefixes(words), "spelling-prefixes")
    whole = ["xxhash64('head', substring(word, 1, pos + 2)) AS head", "xxhash64('tail', substring(word, pos + 1)) AS tail"]
    pivots = table.select("word", "end", "letters", F.length("word").alias("len"), F.explode("pivots").alias("pos")).selectExpr("*", *whole)
    ways = [("head", d, "pos + 2 < len") for d in (-1, 0)] + [("tail", d, "pos > 0") for d in (-1, 0)] + [("head", 1, "true"), ("tail", 1, "true")]
    ways_sql = ", ".join(f"named_struct('h', {h}, 'len', len + {d}, 'bits', {2 - abs(d)}, 'may', {may})" for h, d, may in ways)
    spread = pivots.select(
        F.col("word").alias("a"), F.col("end").alias("_ea"), F.col("letters").alias("_la"), F.explode(F.expr(f"array({ways_sql})")).alias("_w")
    )
    spread = spread.where("_w.may").select(F.xxhash64("_w.h", "_w.len").alias("_key"), "a", "_ea", "_la", F.col("_w.bits").alias("_bits"))
    other = table.select("word", "end", "letters", F.length("word").alias("len"), F.explode("prefix.pos").alias("pos")).selectExpr("*", *whole)
    other = other.select(
        F.col("word").alias("b"), F.col("end").alias("_eb"), F.col("letters").alias("_lb"), "len", F.explode(F.array("head", "tail")).alias("_h")
    )
    other = other.select(F.xxhash64("_h", "len").alias("_key"), "b", "_eb", "_lb")
    met = spread.join(other, "_key").where("_ea <= _eb AND bit_count(_la ^ _lb) <= _bits AND a != b").select("a", "b")
    found = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = found.where(F.levenshtein("a", "b", TAU) == 1)
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return found.select(both.alias("_p")).select("_p.a", "_p.b")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` per word of ``word_counts``.

    ``form`` is the near word of largest count (ties: smallest in code-point order) if its count is at least twice the word's,
    else null; ``root`` follows forms to the end (the word itself without form). Forms strictly double the count, so chains
    are short; they are followed by pointer doubling, each round a written table. Empty tables give an empty result;
    columns other than ``key`` and ``text`` are not read.
    """
    words = written(word_counts(docs, key, text), "spelling-words")
    pairs = near_pairs(words)
    counted = pairs.join(words.select(F.col("word").alias("b"), F.col("n").alias("nb")), "b")
    best = counted.groupBy("a").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("nb")).alias("neg"), F.col("b").alias("w"))).alias("_best")
    )
    table = words.join(best.withColumnRenamed("a", "word"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(-F.col("_best.neg") >= FORM_RATIO * F.col("n"), F.col("_best.w")).alias("form"),
        F.when(-F.col("_best.neg") >= FORM_RATIO * F.col("n"), -F.col("_best.neg")).alias("form_n"),
    )
    table = written(table, "spelling-forms")
    # Pointer doubling: ``up`` is a word further along the chain, ``root`` once it has no form.
    chain = table.select("word", F.coalesce("form", "word").alias("up"))
    while True:
        nxt = chain.alias("c").join(chain.alias("d"), F.col("c.up") == F.col("d.word")).select(F.col("c.word"), F.col("d.up"))
        nxt = written(nxt, "spelling-chain")
        if nxt.join(chain, ["word", "up"], "left_anti").isEmpty():
            break
        chain = nxt
    return table.join(chain.withColumnRenamed("up", "root"), "word").select(
        "word", "form", "root", "n", "n_near", F.col("form_n").cast("bigint").alias("form_n")
    )
