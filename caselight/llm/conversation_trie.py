"""Prefix trie of conversations, as a z-fast trie that grows by batches.

A conversation is a string whose letters are its turns. It goes by the hashes of
its prefixes, 128 bits each, one row of arrays a conversation; texts are hashed
where they are read and go no further. The trie is a table of compacted nodes: the
edge (lo, hi] of the conversation that owns it. A node's handle is its prefix of
that length in (lo, hi] that is divisible by the highest power of two.

To insert, each conversation finds its exit node by fat binary search: it joins
the table of handles on the prefix of the two-fattest length of what is left,
goes on below the node if it is found and shared whole, and above that length if
it is not; a conversation of n turns takes log n joins. Of all that leave the trie
at one place by one turn, the least inserts what it has left as an edge of its
own; the node it leaves is split there. The others go on from that place in the
next batch, so batches are as many as branchings lie above one another, and no
group of conversations is ever gathered.

Edges belong to the least member they have, so a node is named by (conv_id,
depth). At the end they are expanded into one node a turn. What a conversation
adds to the nodes above it is added up by place first: it knows the places where
its ancestors were left, one a batch at most.

Equal conversations are one from the start, with a count. Digests of members are
streamed over sorted rows, so a group's size takes no memory.

Defined results: turns are taken in the order of ``turn``, NULL first, those of
one number by a hash of role and text; a NULL role or text is empty; a repeated row is a
turn of its own. Rows without a conversation are left out. An empty table gives
no rows. Arrays take 24 bytes a turn, so a conversation's length is bounded by
memory at some ten million turns, its texts are not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselight.storage import written

NO_ONE = hashlib.sha256(b"").hexdigest()


def turns_of(
    conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv, at, one, two, chars): place, hashes and code points of every turn."""
    said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    hashed = conversations.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        F.xxhash64(*said).alias("one"),
        F.xxhash64(F.lit(1), *said).alias("two"),
        F.char_length(said[1]).cast("long").alias("chars"),
    )
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "one", "two")
    return hashed.select("conv", F.row_number().over(order).cast("long").alias("at"), "one", "two", "chars")


def rebuilt(turns: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """The turns of conversations rebuilt on those they share a block with, and
    (conv) of all, even of those that have none left.

    Conversation c begins with the first h turns of c - c % block, or all it has,
    h being the crc32 of c as text modulo ``most``; its own turns follow from
    the h-th on.
    """
    sizes = turns.groupBy("conv").agg(F.count("*").alias("size"))
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    asked = sizes.select("conv", head.alias("h"), (F.col("conv") - F.col("conv") % block).alias("base"))
    of = sizes.select(F.col("conv").alias("base"), F.col("size").alias("base_size"))
    asked = asked.join(of, "base", "left").withColumn("lent", F.least("h", F.coalesce("base_size", F.lit(0))))
    asked = written(asked.select("conv", "base", "h", "lent"), "rebuilt")
    own = turns.join(asked, "conv").where("at > h").withColumn("at", F.expr("lent + at - h"))
    first = turns.where(f"at < {most}").withColumnRenamed("conv", "base")
    lent = first.join(asked, "base").where("at <= h")
    columns = ["conv", "at", "one", "two", "chars"]
    return own.select(columns).unionByName(lent.select(columns)), asked.select("conv")


def _paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, len, p, q, chars): arrays of prefix hashes and code points."""
    here = turns.select(
        "conv", "at", "chars", F.xxhash64("at", "one", "two").alias("p"), F.xxhash64(F.lit(2), "at", "two", "one").alias("q")
    )
    so_far = Window.partitionBy("conv").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prefixes = here.select("conv", "at", F.expr("bit_xor(p)").over(so_far).alias("p"), F.expr("bit_xor(q)").over(so_far).alias("q"), "chars")
    each = F.sort_array(F.collect_list(F.struct("at", "p", "q", "chars")))
    listed = prefixes.groupBy("conv").agg(each.alias("turns"))
    arrays = [F.coalesce(F.col(f"turns.{c}"), F.array().cast("array<long>")).alias(c) for c in ("p", "q", "chars")]
    return convs.join(listed, "conv", "left").select("conv", F.expr("coalesce(size(turns), 0)").alias("len"), *arrays)


def _classes(paths: DataFrame) -> DataFrame:
    """(conv, n, ends): of equal conversations the least, how many there are, and
    the digest of all."""
    last = [F.when(F.col("len") > 0, F.element_at(c, -1)).otherwise(0).alias(f"last_{c}") for c in ("p", "q")]
    rows = paths.select("len", *last, "conv")
    key = ["len", "last_p", "last_q"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", "n", "ends"]
        kinds = [pa.int64(), pa.int64(), pa.string()]
        now, first, n, digest, out = None, 0, 0, hashlib.sha256(), []

        def made() -> pa.RecordBatch:
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for *here, conv in zip(*(batch.column(c).to_pylist() for c in [*key, "conv"])):
                if here != now:
                    if now is not None:
                        out.append((first, n, digest.hexdigest()))
                    now, first, n, digest = here, conv, 0, hashlib.sha256()
                digest.update(f",{conv}".encode() if n else str(conv).encode())
                n += 1
            if len(out) > 10_000:
                yield made()
                out.clear()
        if now is not None:
            out.append((first, n, digest.hexdigest()))
            yield made()

    dealt = rows.repartition(*key).sortWithinPartitions(*key, "conv")
    return dealt.mapInArrow(run, "conv long, n long, ends string")


def _same(at: str | Column, p: str = "h_p", q: str = "h_q") -> Column:
    """Whether the prefix of length ``at`` has these hashes."""
    return (F.get("p", at - F.lit(1)) == F.col(p)) & (F.get("q", at - F.lit(1)) == F.col(q))


def _nodes(chains: DataFrame, cuts: DataFrame) -> DataFrame:
    """The compacted nodes: edges of each chain between the places where others
    leave it."""
    inner = cuts.groupBy(F.col("owner").alias("conv")).agg(F.collect_set("at").alias("cuts"))
    ends = F.array_sort(F.array_union(F.coalesce("cuts", F.array().cast("array<int>")), F.array("from", "len")))
    edges = F.explode(F.expr("transform(sequence(1, size(ends) - 1), k -> struct(ends[k - 1] as lo, ends[k] as hi))"))
    cut = chains.join(inner, "conv", "left").withColumn("ends", ends)
    node = cut.select("conv", "path", "p", "q", edges.alias("edge")).select("conv", "path", "p", "q", "edge.*")
    handle = F.expr("hi & shiftleft(-1, length(bin(lo ^ hi)) - 1)")
    part = [F.slice(c, F.col("lo") + 1, F.col("hi") - F.col("lo")).alias(f"edge_{c}") for c in ("p", "q")]
    return node.select(F.col("conv").alias("node"), F.col("path").alias("node_path"), "lo", "hi", handle.alias("handle"), *part)


_STATE = ["conv", "n", "len", "p", "q", "a", "at_owner", "at_path"]
_NODE = ["node", "node_path", "lo", "hi", "edge_p", "edge_q"]


def _located(pending: DataFrame, nodes: DataFrame | None, steps: int) -> DataFrame:
    """Where each pending conversation leaves the trie: ``owner``, ``at`` and the
    ``path`` of places above."""
    if nodes is None:
        return pending.select(*_STATE, F.col("at_owner").alias("owner"), F.col("a").alias("at"), F.col("at_path").alias("path"))
    handles = nodes.select("*", F.expr("edge_p[handle - lo - 1]").alias("h_p"), F.expr("edge_q[handle - lo - 1]").alias("h_q"))
    now = pending.select(*_STATE, F.col("len").alias("b"), *(F.lit(None).cast(nodes.schema[c].dataType).alias(f"x_{c}") for c in _NODE))
    for _ in range(steps):
        # Nothing is asked for once a whole edge is not shared, or nothing is left.
        fat = F.expr("case when x_node is null and a < b then b & shiftleft(-1, length(bin(a ^ b)) - 1) end")
        now = now.withColumn("fat", fat).withColumns({"f_p": F.expr("get(p, fat - 1)"), "f_q": F.expr("get(q, fat - 1)")})
        met = now.join(handles, F.expr("fat = handle and f_p = h_p and f_q = h_q"), "left")
        whole = F.expr("node is not null and hi <= len and get(p, hi - 1) = edge_p[hi - lo - 1] and get(q, hi - 1) = edge_q[hi - lo - 1]")
        part = F.expr("node is not null") & ~F.coalesce(whole, F.lit(False))
        now = met.select(
            "conv", "n", "len", "p", "q",
            F.when(whole, F.col("hi")).otherwise(F.col("a")).alias("a"),
            F.when(whole, F.col("node")).otherwise(F.col("at_owner")).alias("at_owner"),
            F.when(whole, F.col("node_path")).otherwise(F.col("at_path")).alias("at_path"),
            F.when(F.expr("fat is not null and node is null"), F.col("fat") - 1).otherwise(F.col("b")).alias("b"),
            *(F.when(part, F.col(c)).otherwise(F.col(f"x_{c}")).alias(f"x_{c}") for c in _NODE),
        )
    # Whoever has met no exit node yet leaves by the child of the deepest node
    # shared whole, if there is one for its next turn.
    now = now.withColumns({"f_p": F.expr("get(p, a)"), "f_q": F.expr("get(q, a)")})
    now = now.withColumn("next", F.expr("case when x_node is null and a < len then a end"))
    child = nodes.select(*_NODE, F.expr("edge_p[0]").alias("h_p"), F.expr("edge_q[0]").alias("h_q"))
    met = now.join(child, F.expr("next = lo and f_p = h_p and f_q = h_q"), "left")
    met = met.select(*_STATE, *(F.coalesce(f"x_{c}", c).alias(c) for c in _NODE))
    shared = F.expr(
        "case when node is null then a else lo + size(filter(sequence(1, greatest(1, least(hi, len) - lo)), k ->"
        " k <= len - lo and get(p, lo + k - 1) = get(edge_p, k - 1) and get(q, lo + k - 1) = get(edge_q, k - 1))) end"
    )
    return met.select(
        *_STATE, F.coalesce("node", "at_owner").alias("owner"), shared.alias("at"), F.coalesce("node_path", "at_path").alias("path")
    )


def _grown(paths: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All edges, by owner, and the conversations that end within one."""
    place = "array<struct<owner:bigint,at:int>>"
    pending = paths.join(classes.select("conv", "n"), "conv").select(
        "conv", "n", "len", "p", "q",
        F.lit(0).alias("a"), F.lit(None).cast("long").alias("at_owner"), F.array().cast(place).alias("at_path"),
    )
    pending = written(pending, "pending")
    chains, ends, nodes = None, None, None
    while True:
        told = pending.agg(F.max(F.expr("length(bin(a ^ len))"))).first()[0]
        if told is None and chains is not None:
            return chains, ends
        told = told or 0
        found = _located(pending, nodes, told)
        above = F.when(F.col("owner").isNull(), F.col("path")).otherwise(F.concat("path", F.array(F.struct("owner", F.col("at").alias("at")))))
        found = written(found.withColumn("above", above.cast(place)), "located")
        over = found.where("at = len").select("conv", "n", "owner", "at", F.col("above").alias("path"))
        ends = written(over if ends is None else ends.unionByName(over), "ends")
        going = found.where("at < len")
        branch = [F.col("owner"), F.col("at"), F.expr("get(p, at)").alias("next_p"), F.expr("get(q, at)").alias("next_q")]
        least = going.groupBy(*branch).agg(F.min("conv").alias("conv")).select("conv")
        fresh = going.join(least, "conv").select("conv", "n", "owner", F.col("at").alias("from"), F.col("above").alias("path"), "len", "p", "q")
        chains = written(fresh if chains is None else chains.unionByName(fresh), "chains")
        cuts = chains.select("owner", F.col("from").alias("at")).unionByName(ends.where("at > 0").select("owner", "at"))
        nodes = written(_nodes(chains, cuts.where("owner is not null")), "trie-nodes")
        rest = going.join(least, "conv", "left_anti")
        rest = rest.select("conv", "n", "len", "p", "q", F.col("at").alias("a"), F.col("owner").alias("at_owner"), F.col("path").alias("at_path"))
        pending = written(rest, "pending")


def trie(turns: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """One row a node: conv_id (its smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256. ``turns`` are those
    of ``turns_of`` or ``rebuilt``; ``convs`` names conversations without turns
    too."""
    convs = turns.select("conv") if convs is None else convs.select("conv").unionByName(turns.select("conv"))
    paths = written(_paths(turns, convs.distinct()), "paths")
    classes = written(_classes(paths), "classes")
    chains, ends = _grown(paths, classes)

    children = chains.groupBy("owner", F.col("from").alias("at")).agg(F.count("*").alias("children"))
    tips = children.select(F.col("owner").alias("conv"), F.col("at").alias("len"), "children")
    leaf = F.when(F.col("children").isNull(), 1).otherwise(0).cast("long")
    chains = chains.join(paths.select("conv", "chars"), "conv").join(tips, ["conv", "len"], "left")
    chains = written(chains.select("conv", "n", "owner", "from", "path", "len", "chars", leaf.alias("leaf")), "edges-with-leaves")

    each = chains.select("path", "n", "leaf").unionByName(ends.select("path", "n", F.lit(0).cast("long").alias("leaf")))
    added = each.select(F.explode("path").alias("place"), "n", "leaf").groupBy("place.owner", "place.at")
    added = added.agg(F.sum("n").alias("more"), F.sum("leaf").alias("leaves"))
    nodes = chains.select(
        "conv", "owner", "from", "len", "n", "leaf", F.posexplode(F.expr("slice(chars, from + 1, len - from)")).alias("k", "chars")
    ).withColumn("depth", F.expr("from + 1 + k"))
    at = [F.col("owner").alias("conv"), F.col("at").alias("depth")]
    below = Window.partitionBy("conv").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nodes = nodes.join(added.select(*at, "more", "leaves"), ["conv", "depth"], "left")
    nodes = nodes.withColumn("n_convs", F.col("n") + F.sum(F.coalesce("more", F.lit(0))).over(below))
    nodes = nodes.withColumn("n_leaves", F.col("leaf") + F.sum(F.coalesce("leaves", F.lit(0))).over(below))
    nodes = nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("chars"))
    nodes = written(nodes.select("conv", "depth", "owner", "from", "len", "n_convs", "n_leaves", "saved"), "trie-expanded")

    totals = nodes.groupBy("conv").agg(F.sum("saved").alias("saved"))
    passed = chains.select("conv", F.explode("path").alias("place")).join(totals, "conv")
    passed = passed.groupBy("place.owner", "place.at").agg(F.sum("saved").alias("passed"))
    ended = chains.select("conv", F.col("conv").alias("owner"), F.col("len").alias("at")).unionByName(ends.select("conv", "owner", "at"))
    ended = ended.join(classes.select("conv", "ends"), "conv")
    told = nodes.join(passed.select(*at, "passed"), ["conv", "depth"], "left")
    told = told.join(ended.select(*at, "ends"), ["conv", "depth"], "left").join(children.select(*at, "children"), ["conv", "depth"], "left")
    saved = F.sum(F.col("saved") + F.coalesce("passed", F.lit(0))).over(below)
    on = F.when(F.col("depth") < F.col("len"), 1).otherwise(0)
    least = paths.agg(F.min("conv").alias("least"))
    inner = told.select(
        F.col("conv").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        F.when(F.col("depth") > F.col("from") + 1, F.col("conv")).otherwise(F.col("owner")).alias("parent"),
        "n_convs",
        (F.coalesce("children", F.lit(0)) + on).cast("long").alias("n_children"),
        "n_leaves",
        saved.alias("saved_tokens"),
        F.coalesce("ends", F.lit(NO_ONE)).alias("ends_sha256"),
    ).crossJoin(F.broadcast(least))
    inner = inner.select("conv_id", "depth", F.coalesce("parent", "least").alias("parent_conv_id"), *inner.columns[3:8])

    branches = chains.agg(F.count(F.when(F.col("owner").isNull(), 1)).alias("n_children"), F.coalesce(F.sum("leaf"), F.lit(0)).alias("leaves"))
    turnless = ended.where("owner is null").agg(F.max("ends").alias("ends"))
    all_saved = totals.agg(F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"))
    top = classes.agg(F.min("conv").alias("conv_id"), F.sum("n").alias("n_convs")).crossJoin(branches).crossJoin(turnless).crossJoin(all_saved)
    root = top.where("conv_id is not null").select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
        "n_children", F.greatest("leaves", F.lit(1)).cast("long").alias("n_leaves"), "saved_tokens",
        F.coalesce("ends", F.lit(NO_ONE)).alias("ends_sha256"),
    )
    return inner.unionByName(root)
