"""Prefix trie of conversations as a z-fast trie: compacted nodes found by hash.

A conversation is a string of turns; every distinct sequence of first turns is a node. Only compacted
nodes are kept: those where a conversation ends or paths part. A node's edge covers the depths from
below its parent to its own depth (its extent). Its handle is the prefix whose length is the two-fattest number
among these depths, the one divisible by the largest power of two. Nodes are a table keyed by the
hash of the handle.

Locating. A conversation of L turns looks for the deepest node that it passes by fat binary search on
depths (low, high]: it looks up its prefix of two-fattest length. A node whose extent it shares moves
`low` to the extent, a node whose extent it leaves is its exit node, nothing moves `high` below the
probe. That is about log2(L) rounds, each a join of one row per conversation with the table.

Inserting. Conversations are first reduced to distinct ones, then come in batches of falling `shares`. A batch is
located; only turns beyond the located nodes are unfolded, together with those old edges that a member of the batch
enters. Where paths part or end among those, nodes are made, and old edges are cut.

Expanding. Counts are summed over compacted nodes: a distinct conversation passes the nodes found on its
path. What a node adds to its ancestors' sums is added along the path of its smallest member. Then
every edge is unfolded into a row per depth.

Prefixes are known by 128 bits: sums modulo 2**32 in four lanes of hashes of (depth, MD5 of the turn). Such sums
can be formed in blocks, so no task needs a whole conversation: turns are numbered inside ranges of (conversation, turn), and
what runs along a conversation runs inside blocks of `BLOCK` depths and then over the blocks' totals.
The hash over the ids that end at a node is fed from packs of ids, made inside ranges; it has to be fed in order, by
one task a node, with `PACK` ids a row.

Turns are ordered by turn, null first, and by the turn's MD5 where turns tie. A null role or text is empty. Rows without
conv_id belong to no conversation and are left out. Repeated rows are turns of their own. An empty table has no
nodes. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotcast.sources.shared import drop_tables, settle

BLOCK = 4096
PACK = 512
SHARES = (1, 7)
LOW32 = 0xFFFFFFFF
KEY = ["k1", "k2"]


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbered(conversations: DataFrame, paths: list[str], *, conv_id="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """(conv_id, pos, digest, n_bytes): turns numbered from 0 in their conversation, without their texts."""
    who, what = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, what)))
    light = settle(
        conversations.select(
            F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), digest.alias("digest"), F.octet_length(what).cast("long").alias("n_bytes")
        ).where("conv_id is not null"),
        "turns",
        paths,
    )
    # equal rows may part between ranges, they are alike
    dealt = light.withColumn("tie", F.rand(0)).repartitionByRange(_parts(light), "conv_id", F.asc_nulls_first("turn"), "digest", "tie")
    dealt = settle(dealt.drop("tie").withColumn("span", F.spark_partition_id()), "spans", paths)
    order = [F.asc_nulls_first("turn"), "digest"]
    inside = dealt.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id", "span").orderBy(*order)).cast("long") - 1)
    counts = dealt.groupBy("conv_id", "span").count()
    earlier = F.sum("count").over(Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.withColumn("earlier", earlier).where("earlier is not null").drop("count")
    joined = inside.join(before, ["conv_id", "span"], "left")
    return joined.select("conv_id", (F.col("pos") + F.coalesce("earlier", F.lit(0))).alias("pos"), "digest", "n_bytes")


def along(rows: DataFrame, group: str, order: str, sums: dict[str, str], *, back: bool = False, mask: bool = False) -> DataFrame:
    """`rows` with running sums up to and including each row along `order` inside `group` (from its end with `back`).

    Inside blocks of `BLOCK` steps, then over the blocks' totals: no window holds a whole long group. With `mask` sums
    are modulo 2**32.
    """
    cut = F.expr(f"`{order}` div {BLOCK}")
    rows = rows.withColumn("block", cut)
    limit = (lambda c: c.bitwiseAND(F.lit(LOW32))) if mask else (lambda c: c)
    way = F.desc if back else F.asc
    inside = Window.partitionBy(group, "block").orderBy(way(order)).rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy(group).orderBy(way("block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(group, "block").agg(*(limit(F.sum(c)).alias(c) for c in sums))
    carried = totals.select(group, "block", *(limit(F.sum(c).over(outer)).alias(f"before_{c}") for c in sums), F.lag("block").over(
        Window.partitionBy(group).orderBy(way("block"))).alias("other")).where("other is not null").drop("other")
    run = rows.withColumns({name: F.sum(c).over(inside) for c, name in sums.items()}).join(carried, [group, "block"], "left")
    out = run.withColumns({name: limit(F.col(name) + F.coalesce(F.col(f"before_{c}"), F.lit(0))) for c, name in sums.items()})
    return out.drop("block", *(f"before_{c}" for c in sums))


def prefixes(turns: DataFrame, paths: list[str]) -> DataFrame:
    """(conv_id, d, k1, k2, p1, p2, n_bytes, upto): key of the first d turns and of the first d - 1, bytes of all d.

    `turns` has conv_id, d (1, 2, ...), digest, n_bytes.
    """
    x = [F.xxhash64(F.lit(salt), "d", "digest") for salt in (1, 2)]
    lanes = {"a": x[0].bitwiseAND(F.lit(LOW32)), "b": F.shiftrightunsigned(x[0], 32), "c": x[1].bitwiseAND(F.lit(LOW32)), "e": F.shiftrightunsigned(x[1], 32)}
    rows = turns.select("conv_id", "d", "n_bytes", *(v.alias(k) for k, v in lanes.items()))
    sums = along(rows, "conv_id", "d", {k: f"sum_{k}" for k in lanes}, mask=True)
    sums = along(sums, "conv_id", "d", {"n_bytes": "upto"})

    def key(hi, lo):
        return F.shiftleft(hi.bitwiseAND(F.lit(LOW32)), 32).bitwiseOR(lo.bitwiseAND(F.lit(LOW32)))

    own, less = {k: F.col(f"sum_{k}") for k in lanes}, {k: F.col(f"sum_{k}") - F.col(k) for k in lanes}
    named = {"k1": key(own["a"], own["b"]), "k2": key(own["c"], own["e"]), "p1": key(less["a"], less["b"]), "p2": key(less["c"], less["e"])}
    return settle(sums.select("conv_id", "d", *(v.alias(k) for k, v in named.items()), "n_bytes", "upto"), "prefixes", paths)


def two_fattest(low: str, high: str):
    """The number in (low, high] that the largest power of two divides."""
    shift = f"length(bin({low} ^ {high})) - 1"
    return F.expr(f"shiftleft(shiftright({high}, {shift}), {shift})")


def locate(batch: DataFrame, nodes: DataFrame, path: DataFrame, paths: list[str]) -> DataFrame:
    """(conv_id, length, low): the depth of the deepest node of the trie on every conversation's path."""
    probe = path.select("conv_id", F.col("d").alias("f"), *KEY)
    extent = path.select("conv_id", F.col("d").alias("depth"), F.col("k1").alias("x1"), F.col("k2").alias("x2"))
    handles = nodes.select(
        F.col("h_depth").alias("f"), F.col("h1").alias("k1"), F.col("h2").alias("k2"), "depth", F.col("k1").alias("e1"), F.col("k2").alias("e2"), "up_depth"
    )
    state, done = settle(batch.select("conv_id", "length", F.lit(0).cast("long").alias("low"), F.col("length").alias("high")), "search", paths), []
    while not state.isEmpty():
        tried = state.withColumn("f", two_fattest("low", "high")).join(probe, ["conv_id", "f"])
        found = tried.join(handles, ["f", *KEY], "left").join(extent, ["conv_id", "depth"], "left")
        shared = F.coalesce((F.col("x1") == F.col("e1")) & (F.col("x2") == F.col("e2")), F.lit(False))
        low = F.when(F.col("depth").isNull(), F.col("low")).when(shared, F.col("depth")).otherwise(F.col("up_depth"))
        high = F.when(F.col("depth").isNull(), F.col("f") - 1).when(shared, F.col("high")).otherwise(F.col("up_depth"))
        state = settle(found.select("conv_id", "length", low.alias("low"), high.alias("high")), "search", paths)
        done.append(state.where("low >= high"))
        state = state.where("low < high")
    out = batch.select("conv_id", "length", F.lit(0).cast("long").alias("low")).where("length = 0")
    for part in done:
        out = out.unionByName(part.drop("high"))
    return out


def unfold(edges: DataFrame, first, last) -> DataFrame:
    """A row per depth `d` from `first` to `last`; a long edge is dealt out in blocks before."""
    blocks = edges.withColumn("part", F.explode(F.sequence(first, last, F.lit(BLOCK).cast("long"))))
    spread = blocks.repartition(_parts(edges), *KEY, "part")
    return spread.withColumn("d", F.explode(F.sequence(F.col("part"), F.least(F.col("part") + BLOCK - 1, last)))).drop("part")


def insert(nodes: DataFrame | None, batch: DataFrame, path: DataFrame, paths: list[str]) -> DataFrame:
    """The table of nodes with a batch (conv_id, length) of distinct conversations in it.

    A node has depth, k1, k2, up_depth, u1, u2 (its parent), h_depth, h1, h2 (handle), n1, n2 (key at up_depth + 1), conv_id (a
    conversation on whose path it lies), from_bytes, to_bytes (bytes of all turns above and up to it).
    """
    batch = batch.where("length > 0")
    if nodes is None:
        placed = batch.withColumn("low", F.lit(0).cast("long"))
    else:
        placed = locate(batch, nodes, path, paths)
    columns = ["conv_id", "d", *KEY, "p1", "p2"]
    fresh = path.join(placed, "conv_id").where("d > low").select(*columns, (F.col("d") == F.col("length")).alias("stop"), F.col("low").alias("above"))
    touched = None
    if nodes is not None:
        entered = fresh.where("d = above + 1").select(F.col("d").alias("n_depth"), F.col("k1").alias("n1"), F.col("k2").alias("n2")).distinct()
        touched = settle(
            nodes.withColumn("n_depth", F.col("up_depth") + 1).join(entered, ["n_depth", "n1", "n2"], "left_semi").select("conv_id", "depth", *KEY, "up_depth"),
            "touched",
            paths,
        )
        edges = unfold(touched, F.col("up_depth") + 1, F.col("depth")).drop(*KEY).join(path, ["conv_id", "d"])
        fresh = fresh.unionByName(edges.select(*columns, (F.col("d") == F.col("depth")).alias("stop"), F.col("up_depth").alias("above")))
    fresh = settle(fresh, "fresh", paths)
    local = settle(fresh.groupBy("d", *KEY, "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.max("stop").alias("stop")), "local", paths)
    forks = local.groupBy((F.col("d") - 1).alias("d"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).count().where("count > 1").drop("count")
    marked = local.join(forks.withColumn("fork", F.lit(True)), ["d", *KEY], "left").where("stop or fork").select("d", *KEY, "conv_id")
    marked = settle(marked, "marked", paths)
    # the nearest node above, on the path of the node's own conversation
    on_path = fresh.join(marked.select("d", *KEY), ["d", *KEY], "left_semi").select("conv_id", "d", "above").withColumn("block", F.expr(f"d div {BLOCK}"))
    near = F.lag("d").over(Window.partitionBy("conv_id", "block").orderBy("d"))
    outer = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    far = on_path.groupBy("conv_id", "block").agg(F.max("d").alias("last")).withColumn("far", F.max("last").over(outer)).where("far is not null").drop("last")
    placed_above = on_path.withColumn("near", near).join(far, ["conv_id", "block"], "left")
    ups = placed_above.select("conv_id", "d", F.greatest("above", "near", "far").alias("up_depth"))
    made = marked.join(ups, ["conv_id", "d"]).withColumn("h_depth", two_fattest("up_depth", "d")).withColumn("n_depth", F.col("up_depth") + 1)
    at_handle = path.select("conv_id", F.col("d").alias("h_depth"), F.col("k1").alias("h1"), F.col("k2").alias("h2"))
    at_name = path.select(
        "conv_id", F.col("d").alias("n_depth"), F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.col("p1").alias("u1"), F.col("p2").alias("u2"),
        (F.col("upto") - F.col("n_bytes")).alias("from_bytes"),
    )
    at_extent = path.select("conv_id", "d", F.col("upto").alias("to_bytes"))
    made = made.join(at_handle, ["conv_id", "h_depth"]).join(at_name, ["conv_id", "n_depth"]).join(at_extent, ["conv_id", "d"])
    made = made.withColumnRenamed("d", "depth").drop("n_depth")
    if nodes is not None:
        made = made.unionByName(nodes.join(touched.select("depth", *KEY), ["depth", *KEY], "left_anti"))
    return settle(made, "nodes", paths)


def build(strings: DataFrame, path: DataFrame, paths: list[str], shares: Sequence[int] = SHARES) -> DataFrame:
    """The nodes of all distinct conversations (conv_id, length, k1, k2), inserted in batches of these shares."""
    nodes, low, total = None, 0, sum(shares)
    for share in shares:
        deal = F.pmod(F.xxhash64(*KEY), F.lit(total))
        nodes = insert(nodes, strings.where((deal >= low) & (deal < low + share)).select("conv_id", "length"), path, paths)
        low += share
    return nodes


def _packs(batches):
    """Consecutive ids of a node as text, `PACK` in a row."""
    rows, key, ids = [], None, []

    def out():
        made = pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(),) * 4 + (pa.string(),), strict=True)], names=["depth", *KEY, "first", "ids"]
        )
        rows.clear()
        return made

    for batch in batches:
        for *now, i in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != key or len(ids) == PACK:
                if ids:
                    rows.append((*key, ids[0], ",".join(map(str, ids))))
                key, ids = now, []
            ids.append(i)
        if len(rows) >= 1000:
            yield out()
    if ids:
        rows.append((*key, ids[0], ",".join(map(str, ids))))
    if rows:
        yield out()


def _hashes(batches):
    """The hash of a node's ids, fed pack by pack."""
    key, state, rows = None, None, []

    def out():
        kinds = (pa.int64(),) * 3 + (pa.string(),)
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["depth", *KEY, "ends_sha256"])
        rows.clear()
        return made

    for batch in batches:
        for *now, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now == key:
                state.update(b"," + ids.encode())
                continue
            if key is not None:
                rows.append((*key, state.hexdigest()))
            key, state = now, hashlib.sha256(ids.encode())
        if len(rows) >= 1000:
            yield out()
    if key is not None:
        rows.append((*key, state.hexdigest()))
    if rows:
        yield out()


def end_hashes(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256): the hash of the ascending ids (conv_id) that end at a node."""
    order = ["depth", *KEY, "conv_id"]
    packs = ends.select(*order).repartitionByRange(_parts(ends), *order).sortWithinPartitions(*order)
    packs = packs.mapInArrow(_packs, "depth long, k1 long, k2 long, first long, ids string")
    dealt = packs.repartition(_parts(ends), "depth", *KEY).sortWithinPartitions("depth", *KEY, "first")
    return dealt.mapInArrow(_hashes, "depth long, k1 long, k2 long, ends_sha256 string")


def node_table(turns: DataFrame, members: DataFrame, paths: list[str], shares: Sequence[int] = SHARES) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `turns` has conv_id, d, digest, n_bytes; `members` every conv_id, also those without turns.
    """
    every = prefixes(turns, paths)
    last = every.groupBy("conv_id").agg(F.max(F.struct("d", *KEY)).alias("last"))
    zero = F.lit(0).cast("long")
    ends = members.join(last, "conv_id", "left").select(
        "conv_id", F.coalesce("last.d", zero).alias("depth"), F.coalesce("last.k1", zero).alias("k1"), F.coalesce("last.k2", zero).alias("k2")
    )
    ends = settle(ends, "ends", paths)
    strings = ends.groupBy(F.col("depth").alias("length"), *KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_ends"))
    strings = settle(strings.where("length > 0"), "strings", paths)
    path = settle(every.join(strings.select("conv_id"), "conv_id", "left_semi"), "paths", paths)
    nodes = build(strings, path, paths, shares)

    children = nodes.groupBy(F.col("up_depth").alias("depth"), F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(F.count("*").alias("n_children"))
    at = ["depth", *KEY]
    passed = path.select("conv_id", F.col("d").alias("depth"), *KEY).join(nodes.select(*at, (F.col("to_bytes") - F.col("from_bytes")).alias("edge_bytes")), at)
    leafs = strings.withColumnRenamed("length", "depth").join(children, at, "left").select("conv_id", "n_ends", F.col("n_children").isNull().cast("long").alias("leaf"))
    passed = settle(passed.join(leafs, "conv_id"), "passed", paths)
    counts = passed.groupBy(*at).agg(F.sum("n_ends").alias("n_convs"), F.min("conv_id").alias("owner"), F.sum("leaf").alias("n_leaves"))
    counts = settle(counts, "counts", paths)
    own = F.when(F.col("owner") == F.col("conv_id"), (F.col("n_convs") - 1) * F.col("edge_bytes")).otherwise(0)
    weighed = passed.join(counts.select(*at, "owner", "n_convs"), at).select(*at, "conv_id", own.alias("own"))
    saved = along(weighed, "conv_id", "depth", {"own": "deeper"}, back=True).groupBy(*at).agg(F.sum("deeper").alias("saved"))
    full = nodes.drop("conv_id").join(counts, at).join(saved, at).join(children, at, "left")
    full = settle(full.withColumn("n_children", F.coalesce("n_children", zero)), "full", paths)

    top = ends.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    parents = counts.select(F.col("depth").alias("up_depth"), F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("owner").alias("parent"))
    parents = parents.unionByName(top.select(zero.alias("up_depth"), zero.alias("u1"), zero.alias("u2"), F.col("conv_id").alias("parent")))
    edges = full.join(parents, ["up_depth", "u1", "u2"])
    bytes_at = path.select(F.col("conv_id").alias("owner"), "d", (F.col("upto") - F.col("n_bytes")).alias("above_bytes"))
    rows = unfold(edges, F.col("up_depth") + 1, F.col("depth")).join(bytes_at, ["owner", "d"])
    hashes = end_hashes(ends)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    inside = F.col("d") < F.col("depth")
    spread = rows.join(hashes, at, "left").select(
        F.col("owner").alias("conv_id"),
        F.col("d").alias("depth"),
        F.when(F.col("d") == F.col("up_depth") + 1, F.col("parent")).otherwise(F.col("owner")).alias("parent_conv_id"),
        "n_convs",
        F.when(inside, F.lit(1).cast("long")).otherwise(F.col("n_children")).alias("n_children"),
        "n_leaves",
        (F.col("saved") - (F.col("n_convs") - 1) * (F.col("above_bytes") - F.col("from_bytes"))).alias("saved_tokens"),
        F.when(inside, nothing).otherwise(F.coalesce("ends_sha256", nothing)).alias("ends_sha256"),
    )
    below = full.where("up_depth = 0").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    root_hash = hashes.where("depth = 0").select("ends_sha256", zero.alias("depth"))
    root = top.crossJoin(below).withColumn("depth", zero).join(root_hash, "depth", "left").select(
        "conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
        F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), F.coalesce("saved", zero).alias("saved_tokens"),
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )
    return spread.unionByName(root)


def trie(conversations: DataFrame, *, shares: Sequence[int] = SHARES, **columns) -> DataFrame:
    """The nodes of the conversations as they stand; see `node_table`."""
    paths: list[str] = []
    turns = settle(numbered(conversations, paths, **columns), "numbered", paths)
    rows = turns.select("conv_id", (F.col("pos") + 1).alias("d"), "digest", "n_bytes")
    out = settle(node_table(rows, turns.select("conv_id").distinct(), paths, shares), "trie")
    drop_tables(conversations.sparkSession, paths)
    return out


def replayed(turns: DataFrame, every: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that open like the first of their `every`: turns (conv_id, d, digest, n_bytes) and all conv_ids.

    Conversation c takes the first h turns of c - c % every, h = crc32(c) % most, then its own after its first h.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("size"))
    members = sizes.select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    )
    bases = sizes.select(F.col("conv_id").alias("base"), "size")
    members = members.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("size", F.lit(0).cast("long"))))
    heads = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < most)).withColumnRenamed("conv_id", "base")
    opening = members.join(heads, "base").where("pos < h").select("conv_id", (F.col("pos") + 1).alias("d"), "digest", "n_bytes")
    rest = turns.join(members, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken") + 1).alias("d"), "digest", "n_bytes")
    return opening.unionByName(rest), members.select("conv_id")


def replayed_trie(conversations: DataFrame, every: int = 5, most: int = 9, **columns) -> DataFrame:
    """The nodes of `replayed` conversations."""
    paths: list[str] = []
    turns = settle(numbered(conversations, paths, **columns), "numbered", paths)
    rows, members = replayed(turns, every, most)
    out = settle(node_table(rows, members, paths), "trie")
    drop_tables(conversations.sparkSession, paths)
    return out


ORACLE = """
WITH own AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id
        ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT c, count(*) AS n, hex(encode(CAST(c AS VARCHAR))) AS h FROM own GROUP BY c),
members AS (SELECT c, c - c % 5 AS base, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
    lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1))))) % 9 AS h FROM sizes),
rebuilt AS (SELECT m.c, o.pos, o.r, o.t FROM members m JOIN own o ON o.c = m.base AND o.pos < m.h
    UNION ALL SELECT m.c, o.pos - m.h + least(m.h, coalesce(s.n, 0)), o.r, o.t
    FROM members m JOIN own o ON o.c = m.c AND o.pos >= m.h LEFT JOIN sizes s ON s.c = m.base),
path AS (SELECT c, pos + 1 AS d, strlen(t) AS bytes,
        string_agg(md5(strlen(r) || ':' || r || t), '') OVER (PARTITION BY c ORDER BY pos) AS key FROM rebuilt
    UNION ALL SELECT c, 0, 0, '' FROM members),
nodes AS (SELECT key, d, min(c) AS conv_id, count(*) AS n, any_value(bytes) AS bytes FROM path GROUP BY key, d),
families AS (SELECT left(key, 32 * (d - 1)) AS key, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN families USING (key)),
sums AS (SELECT left(key, 32 * a) AS key, sum((n - 1) * bytes) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
    FROM (SELECT *, unnest(range(d + 1)) AS a FROM full_nodes) GROUP BY 1),
ends AS (SELECT key, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(key, d) AS key FROM path GROUP BY c) GROUP BY key)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(v.n AS BIGINT) AS n_convs, CAST(v.n_children AS BIGINT) AS n_children,
    CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM full_nodes v JOIN sums USING (key) LEFT JOIN ends USING (key)
LEFT JOIN nodes u ON v.d > 0 AND u.key = left(v.key, 32 * (v.d - 1)) AND u.d = v.d - 1
"""
