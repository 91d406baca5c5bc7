"""Benchmark decontamination: size-partitioned MinHash containment search.

A text's set is its distinct 5-word shingles of lower-cased (A-Z) words; a test item of fewer
words is one shingle of all its words. A document contains an item when it holds at least
`threshold` of the item's shingles.

Items are partitioned by set size into powers of two. Each partition has its own sketch length:
the bottom-k MinHash of an item, k = U - ceil(threshold * U) + 1 for the partition's largest size
U. A document that lacks all k of them lacks more than a share of 1 - threshold, so no qualifying
document is lost: the sketch is a complete filter, not an approximate one. A document probes only
the partitions whose smallest set it could contain. Whoever hits a sketch is verified on all
shingles of the item.

Documents are only scanned: no shuffle, no text moved. Items are broadcast in blocks of bounded
bytes (`BLOCK_BYTES` of text), each block searched in all documents.

Null and empty texts have no shingles: they contain nothing and are contained nowhere. Repeated
rows of items are one item; repeated documents each give their rows. Empty tables give no rows.
Other columns are ignored, or carried through by `drop_contaminated`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotcast.llm.words import Chunk, chunks, sequence_hash

SHINGLE = 5
THRESHOLD = 0.75
BLOCK_BYTES = 8 << 20
HIT = "item_id bigint, item_shingles bigint, shared_shingles bigint, containment double"


def least_shared(size: int, threshold: float) -> int:
    """Smallest number of shared shingles that reaches the threshold."""
    return max(1, math.ceil(threshold * size - 1e-9))


def item_sets(texts: list[str | None]) -> list[tuple[int, np.ndarray]]:
    """Shingle length and sorted distinct shingle hashes of each text; length 0 without words."""
    out: list[tuple[int, np.ndarray]] = []
    for chunk in chunks(pa.array(texts, pa.string()), lower=True):
        for r in range(chunk.rows):
            words = chunk.hashes[chunk.bounds[r] : chunk.bounds[r + 1]]
            k = min(SHINGLE, len(words))
            out.append((k, np.unique(sequence_hash(words, k)) if k else words))
    return out


class Index:
    """Sketches of a block of items, by shingle length and size partition, and their whole sets."""

    def __init__(self, ids: list[int | None], texts: list[str | None], threshold: float = THRESHOLD):
        sets = item_sets(texts)
        self.ids = ids
        self.need = np.array([least_shared(len(s), threshold) if k else 0 for k, s in sets], dtype=np.int64)
        self.sets = [s for _, s in sets]
        parts: dict[tuple[int, int], list[int]] = {}
        for i, (k, s) in enumerate(sets):
            if k:
                parts.setdefault((k, int(len(s)).bit_length()), []).append(i)
        self.parts = []
        for (k, bits), members in sorted(parts.items()):
            largest, smallest = (1 << bits) - 1, 1 << (bits - 1)
            keep = largest - least_shared(largest, threshold) + 1
            keys = np.concatenate([self.sets[i][:keep] for i in members])
            owner = np.repeat(members, [min(keep, len(self.sets[i])) for i in members])
            order = np.argsort(keys, kind="stable")
            self.parts.append((k, least_shared(smallest, threshold), keys[order], owner[order]))

    def search(self, chunk: Chunk) -> Iterator[tuple[int, int, int]]:
        """(row of the chunk, item, shared shingles) of every document that contains an item."""
        grams = {k: chunk.grams(k) for k in {part[0] for part in self.parts}}
        rows = chunk.row_of_word()
        hit: set[tuple[int, int, int]] = set()
        for k, least, keys, owner in self.parts:
            values, valid = grams[k]
            able = np.diff(chunk.bounds) - k + 1 >= least
            at = np.searchsorted(keys, values)
            found = np.flatnonzero(valid & able[rows] & (keys[np.minimum(at, len(keys) - 1)] == values))
            for w in found.tolist():
                j = int(at[w])
                while j < len(keys) and keys[j] == values[w]:
                    hit.add((int(rows[w]), int(owner[j]), k))
                    j += 1
        sets: dict[tuple[int, int], np.ndarray] = {}
        for row, item, k in sorted(hit):
            if (row, k) not in sets:
                values, valid = grams[k]
                span = slice(chunk.bounds[row], chunk.bounds[row + 1])
                sets[row, k] = np.unique(values[span][valid[span]])
            shared = int(np.isin(self.sets[item], sets[row, k], assume_unique=True).sum())
            if shared >= self.need[item]:
                yield row, item, shared


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[tuple[list, list]]:
    """The items in blocks of about BLOCK_BYTES; the driver holds one block at a time."""
    rows = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text")).distinct()
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, math.ceil(total / BLOCK_BYTES))
    for b in range(n):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).orderBy("item_id", "text").collect()
        yield [r.item_id for r in block], [r.text for r in block]


def contained_items(
    docs: DataFrame, items: DataFrame, *, doc_id="doc_id", text="text", item_id="item_id", item_text="text", threshold=THRESHOLD
) -> DataFrame:
    """Pairs (doc_id, item_id, item_shingles, shared_shingles, containment) at or over the threshold."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = None
    for ids, texts in _blocks(items, item_id, item_text):
        found = source.mapInArrow(_pairs(Index(ids, texts, threshold)), f"doc_id {docs.schema[doc_id].dataType.simpleString()}, {HIT}")
        out = found if out is None else out.unionAll(found)
    return out


def _pairs(index: Index):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for chunk in chunks(batch.column(1), lower=True):
                found = list(index.search(chunk))
                if found:
                    size = [len(index.sets[i]) for _, i, _ in found]
                    shared = [s for _, _, s in found]
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array([chunk.first + r for r, _, _ in found])),
                            pa.array([index.ids[i] for _, i, _ in found], pa.int64()),
                            pa.array(size, pa.int64()),
                            pa.array(shared, pa.int64()),
                            pa.array([a / b for a, b in zip(shared, size, strict=True)], pa.float64()),
                        ],
                        names=["doc_id", "item_id", "item_shingles", "shared_shingles", "containment"],
                    )

    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, *, text="text", item_id="item_id", item_text="text", threshold=THRESHOLD) -> DataFrame:
    """`docs` without the rows that contain an item; all columns stay as they are."""
    for ids, texts in _blocks(items, item_id, item_text):
        docs = docs.where(~F.arrow_udf(_contaminated(Index(ids, texts, threshold)), "boolean")(F.col(text)))
    return docs


def _contaminated(index: Index):
    def run(column: pa.Array) -> pa.Array:
        mask = np.zeros(len(column), dtype=bool)
        for chunk in chunks(column, lower=True):
            for row, _, _ in index.search(chunk):
                mask[chunk.first + row] = True
        return pa.array(mask)

    return run


ORACLE = """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
     v AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark),
     q AS (SELECT DISTINCT least(5, len(w)) AS q FROM v WHERE len(w) > 0),
     d AS (SELECT DISTINCT doc_id, q, array_to_string(w[i : i + q - 1], ' ') AS s
           FROM (SELECT doc_id, w, q, unnest(range(1, len(w) - q + 2)) AS i FROM w CROSS JOIN q)),
     b AS (SELECT DISTINCT item_id, q, array_to_string(w[i : i + q - 1], ' ') AS s
           FROM (SELECT item_id, w, least(5, len(w)) AS q, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM v WHERE len(w) > 0)),
     n AS (SELECT item_id, count(*) AS item_shingles FROM b GROUP BY 1),
     p AS (SELECT doc_id, item_id, count(*) AS shared_shingles FROM d JOIN b USING (q, s) GROUP BY 1, 2)
SELECT doc_id, item_id, item_shingles, shared_shingles, shared_shingles / item_shingles AS containment
FROM p JOIN n USING (item_id) WHERE 4 * shared_shingles >= 3 * item_shingles
"""
