"""Spelling variants, repeated-window removal and the conversation trie against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from webcorpus.llm import conversation_trie, repeated_windows, spelling
from webcorpus.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, form string, n long"


def documents(spark, texts, parts=3, keys=None):
    """Rows of documents with extra columns whose names clash with the operators' output."""
    keys = keys or list(range(len(texts)))
    rows = [(k, t, "en", "s", None, "w", "f", 7) for k, t in zip(keys, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS).repartition(parts)


RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_spelling(keys, texts):
    counts = {}
    for key, text in zip(keys, texts, strict=True):
        for run in RUN.findall(text or ""):
            low = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{low}".encode())
            if h % 97 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1:]
            counts[low] = counts.get(low, 0) + 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    alphabet = {c for w in words for c in w}

    def neighbours(w):
        out = {w[:i] + w[i + 1:] for i in range(len(w))}
        out |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in alphabet}
        out |= {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in alphabet}
        return (out - {w}) & words.keys()

    near = {w: neighbours(w) for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    rows = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return rows


def variant_texts(seed, n_docs=120):
    rng = random.Random(seed)
    stems = ["quality", "standard", "Müller", "color", "theatre", "organise", "receive", "aaaaaaa", "ababab", "Ünïcode"]
    texts = []
    for _ in range(n_docs):
        words = []
        for _ in range(rng.randint(0, 40)):
            w = rng.choice(stems)
            r = rng.random()
            if r < 0.15:
                i = rng.randrange(len(w))
                w = w[:i] + w[i + 1:]
            elif r < 0.3:
                i = rng.randrange(len(w))
                w = w[:i] + rng.choice("aeioué") + w[i:]
            elif r < 0.4:
                i = rng.randrange(len(w))
                w = w[:i] + rng.choice("xyz") + w[i + 1:]
            words.append(w.upper() if rng.random() < 0.1 else w)
        texts.append(" ".join(words) + rng.choice(["", ".", " 42 ", "\n"]))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_spelling_variants_by_brute_force(spark, seed):
    texts = variant_texts(seed) + [None, "", "x" * 30000, "Colour colour COLOUR"] * 2
    keys = list(range(len(texts)))
    keys[-1] = None
    got = {tuple(r) for r in spelling.spelling_variants(documents(spark, texts, keys=keys)).collect()}
    assert got == brute_spelling(keys, texts)
    assert any(r[1] is not None for r in got) and any(r[4] > 0 for r in got)


def test_few_spelling_candidates_where_all_bigrams_are_common(spark, monkeypatch):
    # Every pair that is compared passes: what is left of it is the number of candidates, both ways.
    words = ["".join(w) for w in itertools.product("abc", "eio", "abc", "eio", "abc", "eio", "abc")]
    monkeypatch.setattr(spelling.F, "levenshtein", lambda *_: F.lit(1))
    table = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    pairs = {tuple(r) for r in spelling.near_pairs(table).collect()}
    near = {(a, b) for a in words for b in words if sum(x != y for x, y in zip(a, b, strict=True)) == 1}
    assert near <= pairs
    assert len(pairs) < 6 * len(near)


def test_spelling_of_nothing(spark):
    assert spelling.spelling_variants(documents(spark, [None, "", "a b"])).count() == 0
    assert spelling.spelling_variants(documents(spark, [])).count() == 0


def test_spelling_query_on_the_given_table(spark, sf):
    import pyarrow.parquet as pq

    table = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    got = {tuple(r) for r in QUERIES["op11_spelling_variants"](spark, sf).collect()}
    assert got == brute_spelling(table["doc_id"], table["text"])


def brute_trie(rows):
    """Nodes of the trie of rebuilt conversations, straight from the contract."""
    own = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own.setdefault(conv_id, []).append((turn is not None, turn if turn is not None else 0, role or "", text or ""))
    own = {c: [(t[2], t[3]) for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        built[c] = own.get(base, [])[:h] + ts[h:]
    members = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def subtree(node):
        below = [subtree(k) for k in children.get(node, [])]
        leaves = sum(b[0] for b in below) + (0 if node in children else 1)
        saved = sum(b[1] for b in below) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
        return leaves, saved

    out = set()
    for node, convs in members.items():
        leaves, saved = subtree(node)
        ends = sorted(c for c in convs if len(built[c]) == len(node))
        out.add((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children.get(node, [])),
                 leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def conversation_rows(seed, n=60):
    rng = random.Random(seed)
    openers = [("user", "hi"), ("system", "be brief"), ("user", None), (None, "héllo")]
    rows = []
    for c in rng.sample(range(0, 400), n):
        turns = [rng.choice(openers)] + [(rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "ccc", "ok", ""])) for _ in range(rng.randint(0, 7))]
        for i, (role, text) in enumerate(turns):
            rows.append((c, i if rng.random() > 0.05 else None, role, text))
        if rng.random() < 0.1:
            rows.append(rows[-1])
    rows += [(None, 0, "user", "lost"), (1000, None, None, None)]
    return rows


CONVS = "conv_id long, turn long, role string, text string, depth string, node string, n_convs int"


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_conversation_trie_by_brute_force(spark, seed):
    rows = conversation_rows(seed)
    frame = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], CONVS).repartition(3)
    got = {tuple(r) for r in conversation_trie.conversation_trie(frame).collect()}
    assert got == brute_trie(rows)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], CONVS)
    assert conversation_trie.conversation_trie(empty).count() == 0


def test_trie_of_a_long_chain_and_a_wide_root(spark):
    rows = [(100, i, "user", str(i)) for i in range(300)] + [(200 + i, 0, "user", f"w{i}") for i in range(50)]
    frame = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], CONVS)
    got = {tuple(r) for r in conversation_trie.conversation_trie(frame).collect()}
    assert got == brute_trie(rows)


def test_trie_query_on_the_given_table(spark, sf):
    import pyarrow.parquet as pq

    table = pq.read_table(f"{sf}/conversations.parquet", columns=["conv_id", "turn", "role", "text"]).to_pylist()
    got = {tuple(r) for r in QUERIES["op13_conversation_trie"](spark, sf).collect()}
    assert got == brute_trie([tuple(r.values()) for r in table])


def window_texts(seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "δέλτα", "ε", "zeta", "eta", "theta", "日本"]

    def para(n):
        return " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(n))

    shared, edge = para(90), para(60)
    texts = [para(200), shared + para(50), para(30) + shared, para(300), "x" * 1000, None, "", para(80) * 3, shared, shared]
    texts += [para(10), edge[:399], edge[:399], edge[:400] + "!", "?" + edge[:400], para(40) + shared[:401] + para(40)]
    texts += [para(150) for _ in range(5)] + [para(700) + shared + para(700)]
    return texts


@pytest.mark.parametrize("seed, chunk", [(6, 1 << 20), (7, 500), (8, 1)])
def test_repeated_windows_by_brute_force(spark, seed, chunk):
    texts = window_texts(seed)
    keys = list(range(len(texts)))
    keys[3] = None
    got = sorted(repeated_windows.repeated_windows(documents(spark, texts, keys=keys), chunk=chunk).collect(), key=str)
    want = sorted(((k, *r) for k, r in zip(keys, repeated_windows.brute_force(texts), strict=True)), key=str)
    assert [tuple(r) for r in got] == want
    assert sum(r[2] for r in want) > 0 and any(0 < r[2] < r[1] for r in want)


def test_near_copies_move_rows_by_edits_not_by_windows(spark, monkeypatch):
    rng = random.Random(9)
    text = [rng.choice("abcdefghij ") for _ in range(9000)]
    texts = ["".join("#" if k and i % 900 == 100 * k else c for i, c in enumerate(text)) for k in range(4)]
    moved, write = [], repeated_windows.written

    def counted(df, name):
        table = write(df, name)
        moved.append(table.count())
        return table

    monkeypatch.setattr(repeated_windows, "written", counted)
    got = sorted(tuple(r) for r in repeated_windows.repeated_windows(documents(spark, texts)).collect())
    assert got == [(k, *r) for k, r in enumerate(repeated_windows.brute_force(texts))]
    assert sum(moved) < sum(map(len, texts)) // 2, moved


def test_repeated_windows_of_nothing(spark):
    assert repeated_windows.repeated_windows(documents(spark, [])).count() == 0
    rows = repeated_windows.repeated_windows(documents(spark, [None, "", "short"])).collect()
    assert sorted(r.n_removed for r in rows) == [0, 0, 0]


def test_repeated_windows_query_on_the_given_table(spark, sf):
    import pyarrow.parquet as pq

    table = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    got = sorted(tuple(r) for r in QUERIES["op12_repeated_windows"](spark, sf).collect())
    want = sorted((k, *r) for k, r in zip(table["doc_id"], repeated_windows.brute_force(table["text"]), strict=True))
    assert got == want
