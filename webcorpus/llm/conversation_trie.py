"""A prefix trie of conversations, with subtree totals found by parallel tree contraction.

Every conversation is rebuilt from its own turns and the first turns of its base conversation, then named by the chain of
digests of its prefixes: the node of depth ``d`` is the SHA-256 of its parent's name and its ``d``-th turn. Nodes are one
aggregate over exploded prefixes, so a first turn that a third of all conversations share is combined in every task first.

Subtree totals are not summed level by level (a conversation of 400 turns would take 400 joins) but by tree contraction:
each round rakes all leaves into their parents and then compresses unary chains, a node leaving when its coin shows heads and
its parent's doesn't, so that no two neighbours leave together. A compressed node hands its own value and edge offset on to the
edge of its only child. Rounds are joins of aggregated rows, one per node, each round a written table; the expected number of
rounds grows with the logarithm of the node count. At the end the totals of compressed nodes are recovered by pointer jumping
along the children they were spliced to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcorpus.session import written

# Fixed values of the contract.
BASE_OF = 100  # conversation c borrows from c - c % 100
BORROWED_MOD = 6  # h = crc32(decimal c) % 6

VALUES = ["v1", "v2"]  # childless nodes, saved tokens


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns array<struct<role, text>>`` per distinct non-null ``conv_id``.

    Turns are ordered by ``turn`` (nulls first), ties by role and text, so repeated rows are interchangeable; a null role or
    text is empty. Conversation ``c`` is the first ``h`` turns of conversation ``c - c % 100`` (remainder as in SQL; all if
    fewer, none if it is absent) followed by its own turns after its first ``h``. Rows with a null ``conv_id`` are left out.
    """
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(
            F.col("turn").isNotNull().alias("k0"), F.col("turn").alias("k1"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    own = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("_own"))
    own = own.select("conv_id", F.transform("_own", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("own"))
    own = written(own, "trie-own")
    base = own.select(F.col("conv_id").alias("base"), F.slice("own", 1, BORROWED_MOD - 1).alias("lent"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % BORROWED_MOD).cast("int")
    joined = own.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % BASE_OF).alias("base"))
    joined = joined.join(base, "base", "left")
    turns = F.concat(
        F.slice(F.coalesce("lent", F.array().cast("array<struct<role:string,text:string>>")), 1, F.col("h")),
        F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0))),
    )
    return joined.select("conv_id", turns.alias("turns"))


def prefixes(conversations: DataFrame) -> DataFrame:
    """``conv_id, depth, node, parent, chars, ends``: one row per rebuilt conversation and depth 0 to its length.

    ``node`` names the sequence of its first ``depth`` turns (the root is the empty string), ``chars`` counts the code points
    of the last of them, ``ends`` tells that the conversation has exactly ``depth`` turns.
    """
    chain = F.aggregate(
        "turns",
        F.array(F.struct(F.lit("").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("chars"))),
        lambda acc, t: F.concat(acc, F.array(F.struct(
            F.sha2(F.concat_ws("\u0000", F.element_at(acc, -1)["node"], F.length(t["role"]).cast("string"), t["role"], t["text"]), 256).alias("node"),
            F.element_at(acc, -1)["node"].alias("parent"),
            F.length(t["text"]).alias("chars"),
        ))),
    )
    named = rebuilt(conversations).select("conv_id", F.size("turns").alias("_n"), F.posexplode(chain).alias("depth", "p"))
    return named.select(
        "conv_id", F.col("depth").cast("bigint").alias("depth"), "p.node", "p.parent", F.col("p.chars").cast("bigint").alias("chars"),
        (F.col("depth") == F.col("_n")).alias("ends"),
    )


def subtree_totals(nodes: DataFrame, values: list[str] = VALUES) -> DataFrame:
    """``node`` and the subtree sums of ``values`` of ``nodes(node, parent, *values)``; ``parent`` is null at roots.

    Rake and compress alternate until only finished roots are left; then compressed nodes take their child's total plus what
    they handed on. A forest works alike. Every node must name a parent that is a node.
    """
    spark = nodes.sparkSession
    kids = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("_nch")).withColumnRenamed("parent", "node")
    tree = nodes.select("node", "parent", *values).join(kids, "node", "left").select(
        "node", "parent", *values, *[F.lit(0).cast("bigint").alias(f"o_{v}") for v in values], F.coalesce("_nch", F.lit(0)).alias("nch")
    )
    tree = written(tree, "trie-contract")
    done = spark.createDataFrame([], "node string, " + ", ".join(f"{v} bigint" for v in values))
    spliced = spark.createDataFrame([], "node string, nxt string, " + ", ".join(f"{v} bigint" for v in values))
    round_no = 0
    while True:
        # Rake: leaves are finished; their totals and offsets go to their parents.
        leaves = tree.where("nch = 0")
        done = written(done.unionByName(leaves.select("node", *values)), "trie-done")
        raked = leaves.where("parent IS NOT NULL").groupBy("parent").agg(
            *[F.sum(F.col(v) + F.col(f"o_{v}")).alias(f"_add_{v}") for v in values], F.count("*").alias("_gone")
        ).withColumnRenamed("parent", "node")
        tree = tree.where("nch > 0").join(raked, "node", "left").select(
            "node", "parent", *[(F.col(v) + F.coalesce(f"_add_{v}", F.lit(0))).alias(v) for v in values],
            *[f"o_{v}" for v in values], (F.col("nch") - F.coalesce("_gone", F.lit(0))).alias("nch"),
        )
        tree = written(tree, "trie-contract")
        if tree.isEmpty():
            break
        # Compress: a unary node with heads whose parent is not a unary node with heads leaves; its child takes its place.
        round_no += 1
        heads = (F.xxhash64("node", F.lit(round_no)) % 2 == 0) & (F.col("nch") == 1) & F.col("parent").isNotNull()
        flagged = tree.select("*", heads.alias("_go"))
        parent_go = flagged.select(F.col("node").alias("parent"), F.col("_go").alias("_pgo"))
        going = flagged.join(parent_go, "parent", "left").where("_go AND NOT coalesce(_pgo, false)")
        going = written(going.select("node", "parent", *values, *[f"o_{v}" for v in values]), "trie-going")
        child = tree.join(going.select(
            F.col("node").alias("parent"), F.col("parent").alias("_up"), *[F.col(v).alias(f"_x_{v}") for v in values],
            *[(F.col(v) + F.col(f"o_{v}")).alias(f"_hand_{v}") for v in values],
        ), "parent", "left")
        # The leaving node's total is its own value, its child's old offset and its child's total.
        spliced = written(spliced.unionByName(child.where("_up IS NOT NULL").select(
            F.col("parent").alias("node"), F.col("node").alias("nxt"), *[(F.col(f"_x_{v}") + F.col(f"o_{v}")).alias(v) for v in values]
        )), "trie-spliced")
        tree = child.join(going.select("node"), "node", "left_anti").select(
            "node", F.coalesce("_up", "parent").alias("parent"), *values,
            *[(F.col(f"o_{v}") + F.coalesce(f"_hand_{v}", F.lit(0))).alias(f"o_{v}") for v in values], "nch",
        )
        tree = written(tree, "trie-contract")
    return expand(done, spliced, values)


def expand(done: DataFrame, spliced: DataFrame, values: list[str]) -> DataFrame:
    """Totals of spliced nodes: a spliced node's total is what it handed on plus its child's total, followed by pointer jumping."""
    while not spliced.isEmpty():
        targets = done.select(F.col("node").alias("nxt"), *[F.col(v).alias(f"_t_{v}") for v in values])
        known = spliced.join(targets, "nxt").select("node", *[(F.col(v) + F.col(f"_t_{v}")).alias(v) for v in values])
        rest = written(spliced.join(targets.select("nxt"), "nxt", "left_anti"), "trie-rest")
        done = written(done.unionByName(known), "trie-done")
        further = rest.alias("a").join(rest.alias("b"), F.col("a.nxt") == F.col("b.node"), "left").select(
            F.col("a.node"), F.coalesce(F.col("b.nxt"), F.col("a.nxt")).alias("nxt"),
            *[(F.col(f"a.{v}") + F.coalesce(F.col(f"b.{v}"), F.lit(0))).alias(v) for v in values],
        )
        spliced = written(further, "trie-spliced")
    return done


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` per trie node.

    ``conv_id`` is the smallest member; ``saved_tokens`` sums over the subtree each node's (members - 1) times the code points
    of its last text (0 at the root); ``ends_sha256`` hashes the comma-joined ascending ids of members that end there (empty
    string if none). A table without rows (or only null ids) gives no node, not even a root. Extra columns are not read.
    A node's list of ending ids is sorted in one task: 8 bytes per conversation that ends there.
    """
    rows = written(prefixes(conversations), "trie-prefixes")
    nodes = rows.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("depth").alias("depth"),
        F.min("parent").alias("parent"), F.min("chars").alias("chars"),
    )
    ends = rows.where("ends").groupBy("node").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("conv_id")), ","), 256).alias("ends_sha256")
    )
    kids = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids.withColumnRenamed("parent", "node"), "node", "left").join(ends, "node", "left")
    nodes = written(nodes.select(
        "node", "parent", "conv_id", "depth", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("bigint").alias("v1"),
        ((F.col("n_convs") - 1) * F.col("chars")).cast("bigint").alias("v2"),
    ), "trie-nodes")
    totals = subtree_totals(nodes.select("node", "parent", "v1", "v2"))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    totals = totals.select("node", F.col("v1").alias("n_leaves"), F.col("v2").alias("saved_tokens"))
    return nodes.drop("v1", "v2").join(totals, "node").join(parents, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
    )
