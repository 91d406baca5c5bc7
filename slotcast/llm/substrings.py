"""Substring removal by seed and extend on winnowed anchors.

Words are compared unchanged. A window is `WINDOW` consecutive words of one document; it is a
repeat when the same words also start earlier (smaller doc_id, or same document and earlier
start). Every word that a repeat covers goes, which is the union of the maximal repeats over the
length threshold, less their first occurrence. Windows are judged on the input.

1. Seed. Every window names one anchor, its smallest k-gram hash (leftmost on ties), so equal
   windows name equal anchors and a document has about one anchor per (WINDOW - K + 2) / 2 words.
   Anchors are counted; only those that occur twice can hold a repeat (`_repeated`).
2. Join. Occurrences of repeated anchors are found by a join on the anchor. A frequent anchor is
   split by Spark's skew join; counts are pre-aggregated.
3. Extend. Around each occurrence the text is extended both ways as far as windows name this
   anchor: its block. Windows that start earlier in their own row are found there. Equal
   blocks (anchor and block hash) are grouped with their smallest doc_id; a block under a larger one
   is a repeat as a whole. Where an anchor has several blocks, the windows of the blocks under their
   smallest doc_id are compared one by one, again by hash and doc_id. No pairs of occurrences are
   formed, so a passage in a third of all documents costs as many rows as it has occurrences.
4. Remove. Runs of repeated windows return to their rows, by doc_id and a hash of the text (`part`).

Copies of a whole text are settled before: all but the smallest doc_id lose every word, and their
windows start later than those of that one, so they take no part in step 3.

Null and empty texts have no words: n_words 0, nothing removed, hash of the empty string. A null
doc_id counts as the largest. Rows that share a doc_id, or have none, each get their own result, and
neither is earlier than the other: a passage that only they share stays in all of them. An empty
table gives no rows. Other columns are ignored. Equality is judged by 128 hash bits (anchor and
window); rows under one doc_id are told apart by 64 bits of their texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotcast.llm.words import Chunk, chunks, mix, sequence_hash
from slotcast.sources.shared import drop_tables, release, settle

WINDOW = 20
K = 5
LAST_ID = (1 << 63) - 1


def anchors(chunk: Chunk, window: int = WINDOW, k: int = K):
    """Per anchor occurrence: its word, and the first and last window start that name it.

    Arrays are ordered by word. Also the hashes of the windows, by start word.
    """
    n = len(chunk.hashes)
    none = np.zeros(0, dtype=np.int64)
    if n < window:
        return none, none, none, np.zeros(0, dtype=np.uint64)
    _, valid = chunk.grams(window)
    starts = np.flatnonzero(valid)
    values = sequence_hash(chunk.hashes, k)
    best = np.arange(len(values))
    width, span = 1, window - k + 1
    while width < span:
        step = min(width, span - width)
        left, right = best[:-step], best[step:]
        best = np.where(values[right] < values[left], right, left)
        width += step
    named = best[starts]
    first = np.flatnonzero(np.concatenate(([True], named[1:] != named[:-1]))) if len(named) else none
    last = np.concatenate((first[1:], [len(named)])) - 1 if len(first) else none
    return named[first], starts[first], starts[last], sequence_hash(chunk.hashes, window)


def _seeds(with_place: bool):
    def run(batches):
        for batch in batches:
            ids, parts = batch.column(0), batch.column(1)
            for chunk in chunks(batch.column(2)):
                at, _, _, _ = anchors(chunk)
                if not len(at):
                    continue
                values = sequence_hash(chunk.hashes, K)[at].view(np.int64)
                if with_place:
                    row = np.searchsorted(chunk.bounds, at, side="right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(values),
                            ids.take(pa.array(chunk.first + row)),
                            parts.take(pa.array(chunk.first + row)),
                            pa.array((at - chunk.bounds[row]).astype(np.int32)),
                        ],
                        names=["anchor", "id", "part", "pos"],
                    )
                else:
                    values, counts = np.unique(values, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], names=["anchor", "n"])

    return run


def _own_repeats(row: np.ndarray, lo: np.ndarray, length: np.ndarray, flat: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Per block, how many of its windows start earlier in the same row, and their runs (o, n) from the block's start."""
    block = np.repeat(np.arange(len(lo)), length)
    order = np.lexsort((flat, hashes[flat], row[block]))
    same = (hashes[flat][order][1:] == hashes[flat][order][:-1]) & (row[block][order][1:] == row[block][order][:-1])
    own = np.zeros(len(flat), dtype=bool)
    own[order[1:][same]] = True
    head = np.concatenate(([True], block[1:] != block[:-1]))
    first = np.flatnonzero(own & (head | ~np.concatenate(([False], own[:-1]))))
    last = np.flatnonzero(own & (np.concatenate((head[1:], [True])) | ~np.concatenate((own[1:], [False]))))
    runs = pa.StructArray.from_arrays(
        [pa.array((flat[first] - lo[block[first]]).astype(np.int32)), pa.array((last - first + 1).astype(np.int32))], names=["o", "n"]
    )
    offsets = np.searchsorted(block[first], np.arange(len(lo) + 1)).astype(np.int32)
    return np.bincount(block[own], minlength=len(lo)), pa.ListArray.from_arrays(pa.array(offsets), runs)


def _blocks(batches):
    """Blocks of the listed anchor positions: anchor, block hash, place of the first window, window hashes, repeats of the own row.

    `fresh` is the number of windows that are no repeats of their own row.
    """
    for batch in batches:
        ids, parts, places = batch.column(0), batch.column(1), batch.column(3)
        for chunk in chunks(batch.column(2)):
            at, lo, hi, hashes = anchors(chunk)
            if not len(at):
                continue
            row = np.searchsorted(chunk.bounds, at, side="right") - 1
            listed = places.slice(chunk.first, chunk.rows)
            wanted = np.concatenate([chunk.bounds[r] + np.asarray(p, dtype=np.int64) for r, p in enumerate(listed.to_pylist()) if p is not None] or [np.zeros(0, np.int64)])
            keep = np.isin(at, wanted)
            at, lo, hi, row = at[keep], lo[keep], hi[keep], row[keep]
            if not len(at):
                continue
            value = sequence_hash(chunk.hashes, K)[at]
            total = np.zeros(len(hashes) + 1, dtype=np.uint64)
            spread = mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
            np.cumsum(spread, out=total[1:])
            block = mix((total[hi + 1] - total[lo]) * np.uint64(0x9E3779B97F4A7C15) + (hi - lo + 1).astype(np.uint64))
            length = hi - lo + 1
            flat = np.repeat(lo - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
            windows = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum(length))).astype(np.int32)), pa.array(hashes[flat].view(np.int64))
            )
            repeats, own = _own_repeats(row, lo, length, flat, hashes)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(value.view(np.int64)),
                    pa.array(block.view(np.int64)),
                    ids.take(pa.array(chunk.first + row)),
                    parts.take(pa.array(chunk.first + row)),
                    pa.array((lo - chunk.bounds[row]).astype(np.int32)),
                    pa.array(length.astype(np.int32)),
                    windows,
                    pa.array((length - repeats).astype(np.int32)),
                    own,
                ],
                names=["anchor", "block", "id", "part", "start", "n", "windows", "fresh", "own"],
            )


def kept_words(text: bytes, runs: list[tuple[int, int]], window: int = WINDOW) -> tuple[int, int, bytes]:
    """Words, removed words, and the kept words joined by a space; runs are (first window start, windows)."""
    words = text.split()
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, n in runs:
        gone[min(start, len(words))] += 1
        gone[min(start + n - 1 + window, len(words))] -= 1
    covered = np.cumsum(gone[:-1]) > 0
    return len(words), int(covered.sum()), b" ".join([w for w, c in zip(words, covered.tolist(), strict=True) if not c])


def _kept(batches):
    """Counts and hash of the kept words. Column 2 is null where all words go, else a list of runs."""
    for batch in batches:
        n_words, n_removed, digests = [], [], []
        for text, whole, runs in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            content = (text.as_py() or "").encode()
            spans = [(r["start"], r["n"]) for r in runs or []]
            if whole:
                spans = [(0, max(0, len(content.split()) - WINDOW + 1))] if len(content.split()) >= WINDOW else []
            words, removed, rest = kept_words(content, spans)
            n_words.append(words)
            n_removed.append(removed)
            digests.append(hashlib.sha256(rest).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def repeated_runs(docs: DataFrame, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(id, part) of later copies and (id, part, start, n) runs of repeated windows of the others.

    `docs` has the columns id (not null), part and text. `paths` collects the tables to delete afterwards.
    """
    spark = docs.sparkSession
    texts = docs.select("id", "part", F.md5("text").alias("digest"), (F.length("text") > 0).alias("any")).where("any")
    firsts = texts.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    copies = settle(texts.join(firsts, "digest").where("id > first").select("id", "part").distinct(), "copies", paths)

    counted = docs.mapInArrow(_seeds(False), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    repeated = settle(counted.where("n > 1").select("anchor"), "anchors", paths)
    release(spark)
    places = docs.mapInArrow(_seeds(True), "anchor long, id long, part long, pos int")
    places = settle(places.join(repeated, "anchor", "left_semi").select("id", "part", "pos"), "places", paths)
    release(spark)
    by_doc = places.join(copies, ["id", "part"], "left_anti").groupBy("id", "part").agg(F.collect_set("pos").alias("places"))
    blocks = docs.join(by_doc, ["id", "part"]).select("id", "part", "text", "places").mapInArrow(
        _blocks, "anchor long, block long, id long, part long, start int, n int, windows array<long>, fresh int, own array<struct<o int, n int>>"
    )
    blocks = settle(blocks, "blocks", paths)
    release(spark)

    own = blocks.where("fresh < n").select("id", "part", "start", F.explode("own").alias("run"))
    own = own.select("id", "part", (F.col("start") + F.col("run.o")).alias("start"), F.col("run.n").alias("n"))
    # a window of a block without fresh ones is compared where it starts first in its row
    blocks = blocks.where("fresh > 0")
    firsts = settle(blocks.groupBy("anchor", "block").agg(F.min("id").alias("first"), F.max("id").alias("last")), "firsts", paths)
    later = (
        blocks.select("anchor", "block", "id", "part", "start", "n")
        .join(firsts.where("last > first").select("anchor", "block", "first"), ["anchor", "block"])
        .where("id > first")
        .select("id", "part", "start", "n")
    )
    several = firsts.groupBy("anchor").agg(F.count("*").alias("blocks")).where("blocks > 1").select("anchor")
    compared = firsts.join(several, "anchor", "left_semi").select("anchor", "block", F.col("first").alias("id"))
    windows = (
        blocks.join(compared, ["anchor", "block", "id"])
        .select("anchor", "id", "part", "start", F.posexplode("windows").alias("o", "window"))
        .select("anchor", "window", "id", "part", (F.col("start") + F.col("o")).alias("start"))
    )
    windows = settle(windows, "windows", paths)
    release(spark)
    first_windows = windows.groupBy("anchor", "window").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("last > first")
    singles = windows.join(first_windows, ["anchor", "window"]).where("id > first").select("id", "part", "start", F.lit(1).alias("n"))
    return copies, settle(later.unionAll(singles).unionAll(own), "runs", paths)


def remove_repeats(docs: DataFrame, *, doc_id="doc_id", text="text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256. Intermediate tables stay in the shared folder until read."""
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID))
    part = F.xxhash64(F.col(text))
    source = docs.select(key.alias("id"), part.alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    paths: list[str] = []
    copies, runs = repeated_runs(source, paths)
    touched = runs.groupBy("id", "part").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    marks = touched.withColumn("whole", F.lit(False)).unionByName(copies.withColumn("whole", F.lit(True)), allowMissingColumns=True)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), key.alias("id"), part.alias("part"))
    rows = rows.join(marks, ["id", "part"], "left")
    kind = docs.schema[doc_id].dataType.simpleString()
    out = rows.select("doc_id", "text", "whole", "runs").mapInArrow(
        _kept, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string"
    )
    out = settle(out, "kept")
    drop_tables(docs.sparkSession, paths)
    return out
