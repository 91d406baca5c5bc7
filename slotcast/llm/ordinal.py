"""Ordinal quality classifier: cumulative-link regression on graded ratings over hashed text.

Grades. `labels` rate some documents: 0 low quality, 1 good but toxic, 2 good and not toxic. One
weight vector is shared by all grades; ordered thresholds t1 < t2 cut its score into grades,
P(grade >= k) = sigmoid(score - t_k). The expected grade is the sum of the tail probabilities, and
a document is selected when P(grade >= 2) is at least `SELECT`.

Features are 0/1 and hashed to `1 << BITS` places: every distinct word of the whole text
(lower-cased A-Z, punctuation as a blank), the first `HEAD` bytes of longer words, and the level of each text statistic (share of
capitals, of digits, of signs, of words that repeat the word before, of distinct words; word
length; number of words).

Fitting. At most `SAMPLE` labelled documents, those with the smallest hash of the id, are read by a
broadcast of their ids (its size bound is SAMPLE), turned into features on the executors, and
fitted on the driver by AdaGrad on the likelihood with an L2 penalty. Only features of at least
`LEAST` sampled documents whose presence moves the share of a tail by `CLEAR` standard errors get a
weight; with hundreds of thousands of words the others would only fit noise. The fit is deterministic. Scoring is a scan of all
documents: no shuffle, whole texts.

Null and empty texts have no words and are scored by their statistics, like any other text.
Labels without a document, with a null quality, of good quality with a null toxic, or rated twice with different grades are left out of
the fit; without any usable label, or with fewer than two grades, the fit raises ValueError, but for
an empty table of documents, where the model is one without weights.
Repeated documents each give a row, an empty table of documents gives none. Other columns are
ignored by `rate`, kept by `select_documents`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotcast.llm.words import Chunk, chunks, head_hashes, mix

BITS = 20
SAMPLE = 40_000
LEAST = 8
CLEAR = 4.0
HEAD = 5
SELECT = 0.5
EPOCHS = 12
SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
GRADES = (0, 1, 2)


def _shares(chunk: Chunk, table: np.ndarray) -> np.ndarray:
    """Share of a row's bytes that the table marks."""
    total = np.concatenate(([0], np.cumsum(table[chunk.data])))
    size = np.diff(chunk.offsets)
    return (total[chunk.offsets[1:]] - total[chunk.offsets[:-1]]) / np.maximum(size, 1)


def _mark(members: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=np.int64)
    table[list(members)] = 1
    return table


_CAPITALS = _mark(bytes(range(65, 91)))
_DIGITS = _mark(bytes(range(48, 58)))
_SIGNS = _mark(SIGNS)
_STATS = 7


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, row bounds and feature places of consecutive rows; places are distinct within a row."""
    for raw, chunk in zip(chunks(column), chunks(column, lower=True, blanks=SIGNS), strict=True):
        rows, n = chunk.rows, np.diff(chunk.bounds)
        same = np.zeros(len(chunk.hashes) + 1, dtype=np.int64)
        if len(chunk.hashes) > 1:
            same[2:] = chunk.hashes[1:] == chunk.hashes[:-1]
            inner = chunk.bounds[:-1][n > 0]
            same[inner + 1] = 0
        same = np.cumsum(same)
        repeats = (same[chunk.bounds[1:]] - same[chunk.bounds[:-1]]) / np.maximum(n, 1)
        word_row = chunk.row_of_word()
        places = (word_row.astype(np.int64) << BITS) | (chunk.hashes >> np.uint64(64 - BITS)).astype(np.int64)
        places = np.unique(places)
        heads = head_hashes(chunk, HEAD)
        long = heads != 0
        heads = np.unique((word_row[long].astype(np.int64) << BITS) | (heads[long] >> np.uint64(64 - BITS)).astype(np.int64))
        distinct = np.bincount(places >> BITS, minlength=rows) / np.maximum(n, 1)
        letters = np.diff(np.concatenate(([0], np.cumsum(chunk.ends - chunk.starts)))[chunk.bounds]) / np.maximum(n, 1)
        stats = [
            np.ceil(_shares(raw, _CAPITALS) * 20),
            np.ceil(_shares(raw, _DIGITS) * 20),
            np.ceil(_shares(raw, _SIGNS) * 20),
            np.ceil(repeats * 20),
            np.floor(distinct * 10),
            np.minimum(np.floor(letters), 30),
            np.floor(np.log2(n + 1)),
        ]
        level = np.stack(stats, axis=1).astype(np.uint64) + np.arange(_STATS, dtype=np.uint64) * np.uint64(1000) + np.uint64(1)
        level = (mix(level * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)
        level |= np.arange(rows, dtype=np.int64)[:, None] << BITS
        places = np.unique(np.concatenate((places, heads, level.ravel())))
        yield chunk.first, np.searchsorted(places >> BITS, np.arange(rows + 1)), (places & ((1 << BITS) - 1)).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray  # float32 per place
    cuts: np.ndarray  # rising thresholds, one per grade above the lowest

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, one column each."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - scores[:, None], -40, 40)))

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for first, bounds, places in features(column):
            total = np.concatenate(([0.0], np.cumsum(self.weights[places], dtype=np.float64)))
            out[first : first + len(bounds) - 1] = np.diff(total[bounds])
        return out


def clear_places(counts: np.ndarray, rows: np.ndarray, *, least=LEAST, clear=CLEAR) -> np.ndarray:
    """Features of enough rows whose rows have a clearly other share of some tail.

    `counts`: rows that have a feature, by place and grade. `rows`: all rows by grade.
    """
    seen, total = counts.sum(axis=1), max(rows.sum(), 1)
    out = np.zeros(len(counts), dtype=bool)
    for k in GRADES[1:]:
        share = rows[k:].sum() / total
        error = np.sqrt(np.maximum(seen * share * (1 - share) * (1 - seen / total), 1e-9))
        out |= np.abs(counts[:, k:].sum(axis=1) - seen * share) > clear * error
    return out & (seen >= least)


def fit_model(bounds: np.ndarray, places: np.ndarray, grades: np.ndarray, *, epochs=EPOCHS, rate=0.3, penalty=1e-5) -> Model:
    """Maximum likelihood of the cumulative logit by AdaGrad over blocks of rows.

    The thresholds are a first cut plus exponentials, so they stay in order.
    """
    weights = np.zeros(1 << BITS)
    speed = np.full(1 << BITS, 1e-6)
    levels = len(GRADES) - 1
    share = [np.clip((grades >= k).mean(), 1e-3, 1 - 1e-3) for k in GRADES[1:]]
    start = np.array([-math.log(s / (1 - s)) for s in share])
    free = np.concatenate(([start[0]], np.log(np.maximum(np.diff(start), 0.1))))
    free_speed = np.full(levels, 1e-6)
    rng = np.random.default_rng(7)
    n, size = len(grades), 256
    for _ in range(epochs):
        order = rng.permutation(n)
        for block in np.array_split(order, max(1, n // size)):
            length = bounds[block + 1] - bounds[block]
            at = np.repeat(bounds[block] - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
            p, row = places[at], np.repeat(np.arange(len(block)), length)
            score = np.bincount(row, weights[p], minlength=len(block))
            cuts = np.cumsum(np.concatenate((free[:1], np.exp(free[1:]))))
            # P(grade = g) = upper - lower with tails of logistic form; bounds at both ends
            tail = 1 / (1 + np.exp(np.clip(cuts[None, :] - score[:, None], -40, 40)))
            tail = np.concatenate((np.ones((len(block), 1)), tail, np.zeros((len(block), 1))), axis=1)
            slope = tail * (1 - tail)
            g = grades[block]
            i = np.arange(len(block))
            prob = np.maximum(tail[i, g] - tail[i, g + 1], 1e-9)
            d_score = (slope[i, g] - slope[i, g + 1]) / prob
            d_cut = np.zeros((len(block), levels + 2))
            np.add.at(d_cut, (i, g), -slope[i, g] / prob)
            np.add.at(d_cut, (i, g + 1), slope[i, g + 1] / prob)
            d_cut = d_cut[:, 1:-1].sum(axis=0)
            d_free = np.array([d_cut[j:].sum() * (1.0 if j == 0 else math.exp(free[j])) for j in range(levels)]) / len(block)
            free_speed += d_free**2
            free += 0.1 * d_free / np.sqrt(free_speed)
            own, inverse = np.unique(p, return_inverse=True)
            grad = np.bincount(inverse, d_score[row]) / len(block) - penalty * weights[own]
            speed[own] += grad**2
            weights[own] += rate * grad / np.sqrt(speed[own])
    return Model(weights.astype(np.float32), np.cumsum(np.concatenate((free[:1], np.exp(free[1:])))))


def rated_ids(labels: DataFrame, *, doc_id="doc_id", quality="quality", toxic="toxic", sample=SAMPLE) -> DataFrame:
    """At most `sample` (id, grade) of documents with one usable grade, those whose ids hash lowest."""
    grade = F.when(F.col(quality) == 0, 0).when(F.col(quality).isNotNull(), F.when(F.col(toxic) == 1, 1).when(F.col(toxic) == 0, 2))
    rated = labels.select(F.col(doc_id).cast("long").alias("id"), grade.alias("grade")).where("id IS NOT NULL AND grade IS NOT NULL")
    one = rated.groupBy("id").agg(F.min("grade").alias("grade"), F.max("grade").alias("most")).where("grade = most")
    return one.select("id", "grade").orderBy(F.xxhash64("id"), "id").limit(sample)


def _tally(batches):
    """Rows of every grade that have a feature, by place; place -1 counts all rows."""
    for batch in batches:
        grades = batch.column(2).to_numpy(zero_copy_only=False)
        for first, bounds, places in features(batch.column(1)):
            grade = grades[first : first + len(bounds) - 1]
            of_place = np.repeat(grade, np.diff(bounds))
            found, at = np.unique(places, return_inverse=True)
            n = np.stack([np.bincount(at[of_place == g], minlength=len(found)) for g in GRADES], axis=1)
            found = np.concatenate(([-1], found))
            n = np.concatenate((np.bincount(grade, minlength=len(GRADES))[None, :], n))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *(pa.array(n[:, g], pa.int64()) for g in GRADES)], names=["place", "n0", "n1", "n2"])


def _extract(keep: np.ndarray):
    def run(batches):
        for batch in batches:
            for first, bounds, places in features(batch.column(1)):
                kept = keep[places]
                bounds, places = np.concatenate(([0], np.cumsum(kept)))[bounds], places[kept]
                rows = [places[bounds[i] : bounds[i + 1]].tobytes() for i in range(len(bounds) - 1)]
                part = batch.slice(first, len(rows))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(rows, pa.binary())], names=["id", "grade", "places"])

    return run


def fit(docs: DataFrame, labels: DataFrame, *, doc_id="doc_id", text="text", sample=SAMPLE) -> Model:
    """Fit on at most `sample` labelled documents. The driver sees counts per place and the clear features only."""
    rated = rated_ids(labels, sample=sample)
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(rated), "id").select("id", "text", "grade")
    tally = source.mapInArrow(_tally, "place int, n0 long, n1 long, n2 long").groupBy("place").agg(*[F.sum(f"n{g}").alias(f"n{g}") for g in GRADES])
    tally = tally.where(" + ".join(f"n{g}" for g in GRADES) + f" >= {LEAST} OR place = -1").toArrow()
    place = tally["place"].to_numpy()
    n = np.stack([tally[f"n{g}"].to_numpy() for g in GRADES], axis=1).astype(np.float64)
    rows = n[place == -1].sum(axis=0) if len(place) else np.zeros(len(GRADES))
    if (rows > 0).sum() < 2 and docs.isEmpty():
        return Model(np.zeros(1 << BITS, dtype=np.float32), np.arange(1.0, len(GRADES)))
    if (rows > 0).sum() < 2:
        raise ValueError("the labelled documents have fewer than two grades")
    counts = np.zeros((1 << BITS, len(GRADES)))
    counts[place[place >= 0]] = n[place >= 0]
    keep = clear_places(counts, rows)
    table = source.mapInArrow(_extract(keep), "id long, grade int, places binary").toArrow()
    table = table.sort_by([("id", "ascending"), ("places", "ascending")])
    ids = table["id"].to_numpy()
    table = table.take(pa.array(np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))))  # a document that is there twice counts once
    found = [np.frombuffer(b.as_py(), dtype=np.int32) for b in table["places"]]
    return fit_model(np.concatenate(([0], np.cumsum([len(p) for p in found]))), np.concatenate(found), table["grade"].to_numpy().astype(np.int64))


def rate(docs: DataFrame, model: Model, *, doc_id="doc_id", text="text", select=SELECT) -> DataFrame:
    """Per row: doc_id, expected_grade, p_good (tail probability of the best grade), selected."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            tails = model.tails(model.scores(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= select)],
                names=["doc_id", "expected_grade", "p_good", "selected"],
            )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, expected_grade double, p_good double, selected boolean"
    )


def select_documents(docs: DataFrame, model: Model, *, text="text", select=SELECT) -> DataFrame:
    """The rows of `docs` that the model selects, with all their columns."""

    def good(column: pa.Array) -> pa.Array:
        return pa.array(model.tails(model.scores(column))[:, -1] >= select)

    return docs.where(F.arrow_udf(good, "boolean")(F.col(text)))
