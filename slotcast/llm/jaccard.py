"""N-gram Jaccard join by prefix index lists with set-relation skipping.

A document's set is its distinct 5-word shingles (A-Z lower-cased); a shorter text is one shingle.
Two documents link when 100 * |intersection| >= 75 * |union|. The result is exact.

Index lists. Tokens have one order: rare ones by hash, then the frequent ones (`frequent_tokens`) by
hash. Linked sets share a token among their first n - ceil(0.75 n) + 1, their prefix, so a set is
listed under these tokens only, with its size and the token's position in the set. Sets go by 64
bits of their digest (`id` below), so equal texts are one set and a doc_id plays no part in linking.

Skipping. The two skips of set-relation joins are applied to whole lists and blocks:

* Position: linked sets have a first common token, before which they share nothing. So two entries
  of a list need to be compared there only if 1 + min(sizes left after the token) reaches the needed
  overlap. It depends on (size, position) alone, so it is decided for a block of entries that
  agree in them, and whole blocks fall away before any set is read.
* Answers of a similar set: in every list, one set (the hub) is compared with the others, and
  what links to it takes over its component. The hub is the set with the largest share of frequent
  tokens: among near copies that is the one with the fewest edits, close to most others. Lists whose members are then in one component are
  skipped, as the answers of their members are known. In the other lists, only members outside the
  list's main component are compared with the rest. So a group of near copies costs as many
  comparisons as it has members and lists, not their square.

Sets that are close without being linked, as many copies with many edits are, pass these skips. Their
difference is bounded from below by parity sketches: every token flips one of `64 * WORDS` bits of its
set, so two sets differ in at least as many tokens as their sketches differ in bits. The join on a
token drops a pair whose difference is thus too large before it becomes a row. Entries carry the tokens before theirs, so
of all lists that a pair shares only that of its first common token gives a row.

Candidates are bounded once more by the exact overlap of their prefixes, then verified on whole sets,
which are the only sets ever moved.

Null and empty texts, and texts without words, have no shingles: n_shingles 0, linked with nothing,
component_id their own doc_id. A null doc_id counts as the largest id and shows as null. Rows that
share a doc_id, or have none, are linked by their own texts only, and told apart by 64 bits of these
(`part`). Repeated rows are equal texts and link. An empty table gives no rows. Other columns are
ignored by `link` and kept by `keep_first`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotcast.llm.components import components
from slotcast.llm.words import chunks, sequence_hash
from slotcast.sources.shared import drop_tables, release, settle

SHINGLE = 5
LAST_ID = (1 << 63) - 1
#: A token listed this often is frequent; at most MOST_FREQUENT of the most frequent are (8 bytes each are broadcast).
OFTEN = 16
MOST_FREQUENT = 1 << 20
SALTS = 64
# entries or shingles in a batch that a task hands on
HELD_ENTRIES = 1 << 17
WORDS = 16


BITS = [f"bits{i}" for i in range(WORDS)]


def shingle_sets(column: pa.Array):
    """(row, sorted distinct shingle hashes) of every text with words."""
    for chunk in chunks(column, lower=True):
        values, valid = chunk.grams(SHINGLE)
        for r in range(chunk.rows):
            lo, hi = chunk.bounds[r], chunk.bounds[r + 1]
            if hi - lo >= SHINGLE:
                yield chunk.first + r, np.unique(values[lo:hi][valid[lo:hi]])
            elif hi > lo:
                yield chunk.first + r, sequence_hash(chunk.hashes[lo:hi], int(hi - lo))


def set_key(values: np.ndarray) -> int:
    """64 bits of the digest of a set."""
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_size(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1


def needed(m: Column, n: Column) -> Column:
    """Smallest intersection of linked sets of these sizes."""
    return F.ceil((m + n) * 3 / F.lit(7))


def parity_sketch(values: np.ndarray) -> np.ndarray:
    """`WORDS` 64-bit words in which every token flips one bit."""
    at = (values >> np.uint64(7)) % np.uint64(64 * WORDS)
    odd = np.bincount(at.astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _profiles(batches):
    """Document, part, size, key and sketch of every row's set; size 0 and no key without words."""
    for batch in batches:
        sketch = np.zeros((batch.num_rows, WORDS), dtype=np.int64)
        n = np.zeros(batch.num_rows, dtype=np.int64)
        keys = [None] * batch.num_rows
        for row, values in shingle_sets(batch.column(2)):
            n[row] = len(values)
            sketch[row] = parity_sketch(values)
            keys[row] = set_key(values)
        columns = [batch.column(0), batch.column(1), pa.array(n), pa.array(keys, pa.int64()), *(pa.array(sketch[:, i]) for i in range(WORDS))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc", "part", "n", "id", *BITS])


def _counted(batches):
    """Counts of the tokens that may become part of a prefix by hash order."""
    for batch in batches:
        found = [values[: prefix_size(len(values)) + len(values) // 16] for _, values in shingle_sets(batch.column(0))]
        if found:
            token, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], names=["token", "n"])


def frequent_tokens(docs: DataFrame, often=OFTEN, most=MOST_FREQUENT) -> np.ndarray:
    """Sorted hashes of the tokens counted at least `often` times; the bar doubles until at most `most` are left."""
    counts = docs.select("text").mapInArrow(_counted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= often)
    paths: list[str] = []
    counts = settle(counts, "frequent", paths)
    bars = [often << i for i in range(40)]
    over = counts.agg(*[F.sum((F.col("n") >= b).cast("long")).alias(str(b)) for b in bars]).first()
    bar = next(b for b in bars if (over[str(b)] or 0) <= most)
    out = counts.where(F.col("n") >= bar).select("token").toArrow()["token"].to_numpy().astype(np.int64).view(np.uint64)
    drop_tables(docs.sparkSession, paths)
    return np.sort(out)


def _postings(shared):
    """Prefix entries (token, id, n, pos, frequent) of every set under the order of tokens."""

    def run(batches):
        frequent = shared.value
        names = ["token", "id", "n", "pos", "often", "share"]
        columns, held = [[] for _ in names], 0

        def out():
            tokens, keys, sizes, places, often, shares = (np.concatenate(c) for c in columns)
            for c in columns:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (tokens.view(np.int64), keys, sizes, places, often, shares)], names=names)

        for batch in batches:
            for _, values in shingle_sets(batch.column(0)):
                take = prefix_size(len(values))
                at = np.minimum(np.searchsorted(frequent, values), max(len(frequent) - 1, 0))
                hot = frequent[at] == values if len(frequent) else np.zeros(len(values), dtype=bool)
                order = np.concatenate((np.flatnonzero(~hot), np.flatnonzero(hot)))[:take]
                entries = (
                    values[order], np.full(take, set_key(values)), np.full(take, len(values), dtype=np.int32), np.arange(take, dtype=np.int32),
                    hot[order], np.full(take, hot.mean(), dtype=np.float32),
                )
                for c, x in zip(columns, entries, strict=True):
                    c.append(x)
                held += take
                if held >= HELD_ENTRIES:
                    yield out()
                    held = 0
        if held:
            yield out()

    return run


def _lists(docs: DataFrame, paths: list[str]) -> DataFrame:
    """Index lists with two entries or more, one entry per set."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_tokens(docs))
    entries = docs.select("text").mapInArrow(_postings(shared), "token long, id long, n int, pos int, often boolean, share float")
    release(docs.sparkSession)
    # a frequent token's list is spread over salts; it is known to be long, so only rare ones need their ends
    salt = F.when(F.col("often"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(F.lit(0))
    entries = entries.withColumn("salt", salt)
    alike = Window.partitionBy("token", "salt")
    several = entries.withColumn("least", F.min("id").over(alike)).withColumn("most", F.max("id").over(alike)).where("often OR least < most")
    # copies meet in the window's partitions, so this moves nothing
    once = several.dropDuplicates(["token", "salt", "id"]).select("token", "id", "n", "pos", "share")
    lists = settle(once, "lists", paths)
    release(docs.sparkSession)
    return lists


def _may_link(m: Column, n: Column, i: Column, j: Column) -> Column:
    """Size and position skip: the entries may link, and this may be their first common token."""
    least = needed(m, n)
    return (least <= F.least(m, n)) & (1 + F.least(m - i - 1, n - j - 1) >= least)


def _bounded(pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Candidates whose prefixes have enough in common. `pairs`: a, b with a < b; result also has sizes."""
    left, right = (
        prefixes.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("tokens").alias(f"tokens_{k}")) for k in ("a", "b")
    )
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    # beyond the shorter prefix at most the rest of that set is shared
    rest = F.greatest(*[F.floor(F.col(n) * 3 / F.lit(4)) for n in ("n_a", "n_b")])
    joined = pairs.join(left, "a").join(right, "b")
    return joined.where(common + rest >= needed(F.col("n_a"), F.col("n_b"))).select("a", "b", "n_a", "n_b")


def _whole_sets(batches):
    """(id, set) of every text with words, a few MB at a time."""
    keys, sets, held = [], [], 0
    for batch in batches:
        for _, values in shingle_sets(batch.column(0)):
            keys.append(set_key(values))
            sets.append(values.tobytes())
            held += len(values)
            if held >= HELD_ENTRIES:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], names=["id", "set"])
                keys, sets, held = [], [], 0
    if keys:
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], names=["id", "set"])


def _overlap(left: pa.Array, right: pa.Array) -> pa.Array:
    out = np.zeros(len(left), dtype=np.int64)
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        a, b = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
        out[i] = len(np.intersect1d(a, b, assume_unique=True))
    return pa.array(out)


def _verified(docs: DataFrame, pairs: DataFrame, rows: DataFrame, paths: list[str]) -> DataFrame:
    """The pairs that link, by their whole sets, each read from the one row that `rows` names for it."""
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    places = rows.join(ids, "id", "left_semi").select("doc", "part")
    texts = docs.join(places, ["doc", "part"], "left_semi").dropDuplicates(["doc", "part"])
    sets = settle(texts.select("text").mapInArrow(_whole_sets, "id long, set binary"), "sets", paths)
    release(docs.sparkSession)
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    both = both.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    shared = F.arrow_udf(_overlap, "long")(F.col("set_a"), F.col("set_b"))
    least = needed(F.col("n_a"), F.col("n_b"))
    return settle(both.select("a", "b", shared.alias("shared"), least.alias("least")).where("shared >= least").select("a", "b"), "links", paths)


def _members(lists: DataFrame, paths: list[str]) -> DataFrame:
    """Every entry of a list beside the list's hub, which is no member, with the number of entries."""
    central = F.struct((-F.col("share")).alias("rest"), "id", "n", "pos")
    hubs = lists.groupBy("token").agg(F.min(central).alias("hub"), F.count("*").alias("entries")).where("entries > 1")
    hubs = settle(hubs.select("token", "hub.id", "hub.n", "hub.pos", "entries").toDF("token", "hub", "hub_n", "hub_pos", "entries"), "hubs", paths)
    return settle(lists.drop("share").join(hubs, "token").where("id != hub"), "members", paths)


def _hub_pairs(members: DataFrame) -> DataFrame:
    near = members.where(_may_link(F.col("hub_n"), F.col("n"), F.col("hub_pos"), F.col("pos")))
    return near.select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct()


def _open_rows(members: DataFrame, known: DataFrame, sketches: DataFrame, prefixes: DataFrame, paths: list[str]) -> DataFrame:
    """Members of a list that are in different components and may link, id_ and id, once for all lists that both are in.

    The hub has been compared with all of its list, so lists of two entries are closed.
    """
    placed = members.where("entries > 2").select("token", "id", "n", "pos")
    placed = placed.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = settle(placed, "placed", paths)
    groups = placed.groupBy("token", "component").agg(F.count("*").alias("size"))
    main = groups.groupBy("token").agg(F.max(F.struct("size", "component")).alias("main"), F.count("*").alias("groups"))
    main = settle(main.where("groups > 1").select("token", F.col("main.component").alias("main")), "main", paths)
    before = F.slice("tokens", 1, F.array_position("tokens", F.col("token")).cast("int") - 1)
    placed = placed.join(main, "token").join(sketches, "id").join(prefixes.select("id", "tokens"), "id")
    placed = settle(placed.withColumn("before", before).drop("tokens"), "open", paths)
    left = placed.where("component != main").select("token", *[F.col(c).alias(f"{c}_") for c in ("id", "n", "pos", "component", "before", *BITS)])
    near = _may_link(F.col("n_"), F.col("n"), F.col("pos_"), F.col("pos"))
    apart = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"{b}_"))) for b in BITS), F.lit(0))
    near = near & (apart <= F.col("n_") + F.col("n") - 2 * needed(F.col("n_"), F.col("n")))
    once = (F.col("component") == F.col("main")) | (F.col("id_") < F.col("id"))
    # the bounds hold at the first common token, and its list has both
    first = ~F.arrays_overlap("before_", "before")
    return left.join(placed, "token").where((F.col("component_") != F.col("component")) & once & near & first).select("id_", "id")


def _open_pairs(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs of `_open_rows` that are not compared yet."""
    pairs = rows.select(F.least("id_", "id").alias("a"), F.greatest("id_", "id").alias("b")).distinct()
    return pairs.join(done, ["a", "b"], "left_anti")


def _linked(source: DataFrame, paths: list[str]) -> DataFrame:
    """(doc, part, n, component, first, first_part) for every row of `source` (doc not null, part, text) but repeated ones.

    `component` is null without words; `first` and `first_part` are its smallest row.
    """
    spark = source.sparkSession
    kinds = "doc long, part long, n long, id long, " + ", ".join(f"{b} long" for b in BITS)
    profiles = settle(source.mapInArrow(_profiles, kinds), "profiles", paths)
    rows = profiles.where("n > 0").groupBy("id").agg(F.min(F.struct("doc", "part")).alias("row")).select("id", "row.doc", "row.part")
    rows = settle(rows, "rows", paths)
    lists = _lists(source, paths)
    # in the order of tokens
    prefixes = lists.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).getField("token").alias("tokens"))
    prefixes = settle(prefixes, "prefixes", paths)
    release(spark)
    members = _members(lists, paths)
    hub_pairs = settle(_bounded(_hub_pairs(members), prefixes), "hub_pairs", paths)
    links = _verified(source, hub_pairs, rows, paths)
    known = settle(components(links, paths), "known", paths)
    sketches = profiles.where("n > 0").select("id", *BITS).dropDuplicates(["id"])
    release(spark)
    open_rows = _open_rows(members, known, sketches, prefixes, paths)
    open_pairs = settle(_bounded(_open_pairs(open_rows, hub_pairs.select("a", "b")), prefixes), "open_pairs", paths)
    more = _verified(source, open_pairs, rows, paths)
    edges = links.unionAll(more)
    release(spark)
    final = settle(components(edges, paths), "components", paths)
    placed = rows.join(final, "id", "left").withColumn("component", F.coalesce("component", "id"))
    firsts = placed.groupBy("component").agg(F.min(F.struct("doc", "part")).alias("first"))
    sets = settle(placed.join(firsts, "component").select("id", "component", F.col("first.doc").alias("first"), F.col("first.part").alias("first_part")), "placed", paths)
    return profiles.select("doc", "part", "n", "id").distinct().join(sets, "id", "left").drop("id")


def _keyed(docs: DataFrame, doc_id: str, text: str) -> tuple[Column, Column, DataFrame]:
    key, part = F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)), F.xxhash64(F.col(text))
    return key, part, docs.select(key.alias("doc"), part.alias("part"), F.col(text).alias("text"))


def link(docs: DataFrame, *, doc_id="doc_id", text="text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, both by the row's own text."""
    paths: list[str] = []
    key, part, source = _keyed(docs, doc_id, text)
    known = _linked(source, paths).withColumn("first", F.coalesce("first", "doc"))
    shown = F.when(F.col("first") == LAST_ID, F.lit(None)).otherwise(F.col("first"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), key.alias("doc"), part.alias("part")).join(known, ["doc", "part"])
    out = settle(rows.select("doc_id", F.col("n").alias("n_shingles"), shown.cast("long").alias("component_id")), "linked")
    drop_tables(docs.sparkSession, paths)
    return out


def keep_first(docs: DataFrame, *, doc_id="doc_id", text="text") -> DataFrame:
    """The row of `docs` with the smallest doc_id of each component, with all columns; among those of one doc_id by a hash of the text.

    Rows without words stay, but for repeats of a doc_id and text.
    """
    paths: list[str] = []
    key, part, source = _keyed(docs, doc_id, text)
    known = _linked(source, paths)
    later = known.where("doc != first OR part != first_part")
    dropped = settle(later.select(F.col("doc").alias("__doc"), F.col("part").alias("__part")), "dropped")
    drop_tables(docs.sparkSession, paths)
    rows = docs.withColumn("__doc", key).withColumn("__part", part).join(dropped, ["__doc", "__part"], "left_anti")
    return rows.dropDuplicates(["__doc", "__part", doc_id]).select(*docs.columns)


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (
             SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
     p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
     e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
     r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
     c AS (SELECT a, min(b) AS least FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id
"""
