"""I-Match fingerprints with randomised lexicon subsets.

Terms are the distinct words of a text, lower-cased A-Z. The lexicon holds the terms whose inverse
document frequency, over all documents, lies in a band: in at least 1/`RARE` and at most 1/`COMMON`
of the documents. As document frequencies sum to the number of distinct terms of all documents, the
lexicon has at most RARE times the mean number of distinct terms per document, whatever the
number of documents; that is the size bound of its broadcast.

A fingerprint has a field per lexicon subset: the whole lexicon first, then `SUBSETS` random ones,
which keep a term with a chance of 1/16 down to 1/2048 so that long and short texts both have
subsets that hit a few of their terms. A field is the hash of the text's sorted distinct terms in
that subset, eight hex digits, zeros where there is none. A text with terms but none in the lexicon
has the hash of all its sorted distinct terms in the first field.

Likeness of two fingerprints: of the subsets that either text hits, the share with equal fields; it
estimates the overlap of their terms. It is 1 for two texts without terms and for equal texts, whose
fingerprints are equal always; texts with no term in the lexicon are at 1 with those of the same terms only.

Copies count in the document frequencies. So the terms of a text that over 1/`COMMON` of the documents
repeat, exactly or nearly, are out of the band: where that is all its terms, exact copies are at 1 and
edited ones at 0.

`neighbours` pairs each document with the next one in falling doc_id order (nulls last, ties by
text), the last with the first. Documents are dealt to ranges of doc_id and each range's top document
is also sent to the range above, so a text moves once and a task streams through its ranges.

Null and empty texts are texts without terms. Repeated rows are neighbours of each other. A lone
document is its own neighbour, an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotcast.llm.words import chunks, mix

RARE, COMMON = 1000, 5
SUBSETS = 48
FIRST_ID = -(1 << 63)
_SEEDS = mix(np.arange(1, SUBSETS + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def term_rows(column: pa.Array):
    """First row, row bounds and sorted distinct term hashes of consecutive rows."""
    for chunk in chunks(column, lower=True):
        rows = chunk.row_of_word()
        order = np.lexsort((chunk.hashes, rows))
        rows, terms = rows[order], chunk.hashes[order]
        if len(terms):
            new = np.concatenate(([True], (terms[1:] != terms[:-1]) | (rows[1:] != rows[:-1])))
            rows, terms = rows[new], terms[new]
        yield chunk.first, np.searchsorted(rows, np.arange(chunk.rows + 1)), terms


def _count(batches):
    for batch in batches:
        found = [terms for _, _, terms in term_rows(batch.column(0))]
        if found:
            terms, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n)], names=["term", "n"])


def lexicon(docs: DataFrame, *, text="text", rare=RARE, common=COMMON) -> np.ndarray:
    """Sorted hashes of the terms in the band, from the document frequencies of all documents."""
    total = docs.count()
    counts = docs.select(F.col(text).alias("text")).mapInArrow(_count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    kept = counts.where((F.col("n") * rare >= total) & (F.col("n") * common <= total)).select("term").toArrow()
    return np.sort(kept["term"].to_numpy().astype(np.int64).view(np.uint64))


class Fingerprints:
    """Fingerprint fields of texts for one lexicon."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        rate = np.concatenate(([64], np.repeat(np.arange(60, 52, -1), SUBSETS // 8)))
        self.member = [mix(terms ^ s) >> np.uint64(r) == 0 if r < 64 else np.ones(len(terms), bool) for s, r in zip(_SEEDS, rate.tolist(), strict=True)]

    def fields(self, column: pa.Array, others: bool = False) -> np.ndarray:
        """One row per text, one uint32 per subset; 0 where the text has no term of the subset.

        With `others`, texts that have terms but none of the lexicon get their first field from all of them.
        """
        out = np.zeros((len(column), SUBSETS + 1), dtype=np.uint32)
        for first, bounds, terms in term_rows(column):
            at = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
            known = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)
            every = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(terms), dtype=np.uint64)))
            every = every[bounds[1:]] - every[bounds[:-1]]
            filled = np.diff(bounds) > 0
            bounds = np.concatenate(([0], np.cumsum(known)))[bounds]
            at, terms = at[known], terms[known]
            for j, seed in enumerate(_SEEDS):
                value = np.where(self.member[j][at], mix(terms + seed), np.uint64(0)) if len(at) else terms
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
                total = total[bounds[1:]] - total[bounds[:-1]]
                field = (mix(total) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
                out[first : first + len(field), j] = np.where(total == 0, 0, field)
            if others:
                bare = np.flatnonzero(filled & (np.diff(bounds) == 0))
                out[first + bare, 0] = (mix(every[bare]) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal fields among the subsets that either hits, row by row; 1 where none is hit."""
    hit = ((a != 0) | (b != 0)).sum(axis=1)
    same = ((a == b) & (a != 0)).sum(axis=1)
    return np.where(hit == 0, 1.0, same / np.maximum(hit, 1))


def as_text(fields: np.ndarray) -> list[str]:
    return [row.astype(">u4").tobytes().hex() for row in fields]


def fingerprint(docs: DataFrame, terms: np.ndarray, *, text="text", name="fingerprint") -> DataFrame:
    """`docs` with a column of fingerprints."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(column: pa.Array) -> pa.Array:
        return pa.array(as_text(Fingerprints(shared.value).fields(column, others=True)), pa.string())

    return docs.withColumn(name, F.arrow_udf(run, "string")(F.col(text)))


NEAR = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
RUN_CHARS = 1 << 20


def _compare(shared):
    def flush(prints, ids, texts, types):
        """All but the last text are documents, each followed by its next one."""
        n = len(ids)
        if not n:
            return
        sizes = [len(t) for t in texts[:n]]
        edited = [t[: k - k // 2] + u[: k // 2] for t, u, k in zip(texts, texts[1:], sizes, strict=False)]
        own, other = (prints.fields(pa.array(t, pa.string()), others=True) for t in (texts, edited))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, types),
                pa.array(sizes, pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array(as_text(own[:-1])),
                pa.array(as_text(other)),
                pa.array(likeness(own[:-1], other)),
                pa.array(likeness(own[:-1], own[1:])),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches):
        prints = Fingerprints(shared.value)
        bucket, ids, texts, size, done, kind = None, [], [], 0, True, pa.int64()
        for batch in batches:
            kind = batch.column(1).type
            for b, i, extra, text in zip(*(batch.column(c) for c in range(4)), strict=True):
                b, extra, text = b.as_py(), extra.as_py(), text.as_py() or ""
                if b != bucket:
                    bucket, ids, texts, size, done = b, [], [], 0, False
                if done:
                    continue
                texts.append(text)
                if extra:
                    yield from flush(prints, ids, texts, kind)
                    ids, texts, size, done = [], [], 0, True
                    continue
                if size > RUN_CHARS:
                    yield from flush(prints, ids, texts, kind)
                    ids, texts, size = [], [text], 0
                ids.append(i.as_py())
                size += len(text)

    return run


def _deal(tops: np.ndarray):
    """Ranges that a doc_id goes to: its own (negative numbers mark the extra copy of a range's top)."""

    def run(keys: pa.Array) -> pa.Array:
        keys = keys.to_numpy(zero_copy_only=False)
        own = np.searchsorted(tops, keys)
        above = (own + 1) % len(tops)
        return pa.array([[o, -1 - a] if t else [o] for o, a, t in zip(own.tolist(), above.tolist(), (tops[own] == keys).tolist(), strict=True)], pa.list_(pa.int32()))

    return run


def neighbours(docs: DataFrame, *, doc_id="doc_id", text="text", rare=RARE, common=COMMON) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, both fingerprints, near_edited, near_next."""
    spark = docs.sparkSession
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(FIRST_ID))
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), key.alias("key"))
    shared = spark.sparkContext.broadcast(lexicon(source, rare=rare, common=common))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = source.select("key").repartitionByRange(4 * tasks, "key").groupBy(F.spark_partition_id()).agg(F.max("key").alias("top"))
    tops = np.sort(ranged.toArrow()["top"].to_numpy().astype(np.int64))
    kind = docs.schema[doc_id].dataType.simpleString()
    if not len(tops):
        return spark.createDataFrame([], f"doc_id {kind}, {NEAR}")
    place = F.arrow_udf(_deal(tops), "array<int>")(F.col("key"))
    dealt = source.withColumn("place", F.explode(place)).select(
        F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place")).alias("bucket"), "doc_id", (F.col("place") < 0).alias("extra"), "text", "key"
    )
    ordered = dealt.repartition(tasks, "bucket").sortWithinPartitions("bucket", "extra", F.desc("key"), "text")
    return ordered.select("bucket", "doc_id", "extra", "text").mapInArrow(_compare(shared), f"doc_id {kind}, {NEAR}")
