"""Spelling variants: words one edit apart, found by dynamic programming along sorted lists.

Words are maximal runs of letters, counted over all texts. To match a query word against a sorted list, the
rows of its edit matrix are kept for the current word's prefixes. A row is a band of three cells, as two
words one edit apart leave the diagonal by one at most. The next word in the list shares a prefix with the current
one (their LCP): the rows up to there stand, only the rows beyond are computed. Once a row holds nothing
under two, no word with that prefix can be near: the whole range of words that share it is skipped.

One list of all words would be one task, and every word would walk all of it. Words are dealt
so that the two words of a pair meet. Of two words one edit apart, the shorter m letters long, the first r letters or
the last m - r are equal, whatever r is. So a word goes to two groups, by its first half and by its
last half, for its own length and for the length below (as the longer word of a pair). A group of over
`GROUP` words is dealt again by the same rule on the letters not yet known to be equal, until the
groups are small or one letter is left, when a group holds at most the alphabet and its square. No pair is
lost and no group is cut off. A pair that meets twice counts once.

A word's form is its near word with the largest count, if that is at least `ratio` times its own
(ties: the smallest in code-point order). Counts grow by that ratio along forms, so following them
ends; roots come from doubling the pointers.

Words of texts are counted as they stand, or with planted slips (`slips`): of a document's run whose
checksum with the doc_id is divisible by 199, one letter is deleted. Null texts have no words, a null doc_id is written
as nothing. Repeated rows count again. An empty table gives no rows; other columns are ignored. Texts
are read in slices, runs of any length are kept whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotcast.sources.shared import drop_tables, settle

LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
GROUP = 128
SLICE = 1 << 20
COUNTED = 200_000
FAR = 9

# Fixed value: the letters of a word.
LETTERS = r"A-Za-zÀ-ÿ"


def slip(prefix: int, run: str) -> str:
    """The run, or the run without one letter where its checksum is divisible by 199."""
    h = zlib.crc32(run.encode(), prefix)
    return run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]


def _slices(text: str, gap: re.Pattern) -> Iterator[str]:
    """Parts of a text that end where no run goes on."""
    at = 0
    while at < len(text):
        found = gap.search(text, at + SLICE) if len(text) - at > SLICE else None
        end = found.end() if found else len(text)
        yield text[at:end]
        at = end


def count_words(docs: DataFrame, *, doc_id="doc_id", text="text", slips=False, least_length=LEAST_LENGTH) -> DataFrame:
    """(word, n) of all texts for words of at least `least_length` letters; A-Z are lower-cased, no other letters."""

    def run(batches):
        runs, gap = re.compile(f"[{LETTERS}]{{{least_length},}}"), re.compile(f"[^{LETTERS}]")
        counts: Counter[str] = Counter()

        def emit():
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for key, column in zip(batch.column(0), batch.column(1), strict=True):
                content, name = column.as_py(), key.as_py()
                prefix = zlib.crc32(f"{'' if name is None else name}:".encode())
                for part in _slices(content.encode().lower().decode(), gap) if content else ():
                    found = Counter(runs.findall(part))
                    if slips:
                        for word, n in found.items():
                            counts[slip(prefix, word)] += n
                    else:
                        counts.update(found)
                if len(counts) >= COUNTED:
                    yield emit()
        yield emit()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.char_length("word") >= least_length)


def matches(words: list[str]) -> Iterator[tuple[int, int]]:
    """Index pairs (i < k) of a sorted list of distinct words that are one edit apart."""
    shared = [0] * (len(words) + 1)
    for k in range(1, len(words)):
        a, b = words[k - 1], words[k]
        n = 0
        for x, y in zip(a, b, strict=False):
            if x != y:
                break
            n += 1
        shared[k] = n
    longest = max(map(len, words), default=0)
    rows = [(1, 0, 1)] * (longest + 1)
    for i, query in enumerate(words):
        size = len(query)
        k, same = i + 1, longest
        start = longest  # rows up to here hold for the words k - 1 and k
        while k < len(words):
            same = min(same, shared[k])  # of the query and word k: up to there the rows are (1, 0, 1)
            start = min(start, shared[k])
            word, depth = words[k], max(start, same)
            low, mid, high = (1, 0, 1) if depth <= same else rows[depth]
            if depth == same and depth >= size:
                high = FAR
            dead = 0
            for d in range(depth, len(word)):
                # one more letter of the word: cells against d, d + 1 and d + 2 letters of the query
                letter = word[d]
                left = mid + 1
                if 0 < d <= size and (x := low + (letter != query[d - 1])) < left:
                    left = x
                if d > size:
                    left = FAR
                if d < size:
                    x = mid + (letter != query[d])
                    mid = min(x, high + 1, left + 1)
                else:
                    mid = FAR
                if d + 1 < size:
                    high = min(high + (letter != query[d + 1]), mid + 1)
                else:
                    high = FAR
                low = left
                rows[d + 1] = (low, mid, high)
                if low > 1 and mid > 1 and high > 1:
                    dead = d + 1
                    break
            if dead:
                start = dead
                k += 1
                while k < len(words) and shared[k] >= dead:
                    same = min(same, shared[k])
                    k += 1
                continue
            start = len(word)
            off = size - len(word)
            if -1 <= off <= 1 and (low, mid, high)[off + 1] == 1:
                yield i, k
            k += 1


def _dealt(rows: DataFrame, i, j) -> DataFrame:
    """Group keys: length, and the letters known to be equal at both ends."""
    return rows.withColumn("i", i).withColumn("j", j).withColumn(
        "key",
        F.concat_ws("\0", "m", "i", "j", F.expr("substring(word, 1, i)"), F.expr("substring(word, char_length(word) - j + 1, j)")),
    )


def _halves(rows: DataFrame) -> DataFrame:
    """Every row twice: by the first half of the letters still open, and by the rest."""
    known = F.col("m") - F.col("i") - F.col("j")
    first = F.floor((known + 1) / 2).cast("int")
    sides = rows.withColumn("first", first).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    i = F.col("i") + F.when(F.col("side") == 0, F.col("first")).otherwise(0)
    j = F.col("j") + F.when(F.col("side") == 1, known - F.col("first")).otherwise(0)
    sides = sides.withColumn("new_i", i).withColumn("new_j", j)
    return _dealt(sides, F.col("new_i"), F.col("new_j")).select("word", "n", "m", "i", "j", "key")


def _pairs(batches):
    """Near pairs of every group; rows come sorted by key and word."""
    key, words, counts = None, [], []

    def close():
        found = list(matches(words))
        a, b = [i for i, _ in found], [k for _, k in found]
        return pa.RecordBatch.from_arrays(
            [pa.array([f[x] for x in xs], t) for xs in (a, b) for f, t in ((words, pa.string()), (counts, pa.int64()))],
            names=["a", "n_a", "b", "n_b"],
        )

    for batch in batches:
        for k, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                if len(words) > 1:
                    yield close()
                key, words, counts = k, [], []
            words.append(word)
            counts.append(n)
    if len(words) > 1:
        yield close()


def near_words(vocabulary: DataFrame, paths: list[str], group: int = GROUP) -> DataFrame:
    """(a, n_a, b, n_b), a < b: all pairs of words of `vocabulary` (word, n) that are one edit apart, once each."""
    lengths = F.array(F.char_length("word"), F.char_length("word") - 1)
    rows = vocabulary.select("word", "n", F.explode(lengths).alias("m"), F.lit(0).alias("i"), F.lit(0).alias("j")).where("m > 0")
    open_rows, done = settle(_halves(rows), "groups", paths), None
    while True:
        large = open_rows.where("m - i - j > 1").groupBy("key").count().where(F.col("count") > group).select("key")
        split = settle(_halves(open_rows.join(large, "key", "left_semi")), "groups", paths)
        kept = open_rows.join(large, "key", "left_anti")
        done = kept if done is None else done.unionByName(kept)
        if split.isEmpty():
            break
        open_rows = split
    parts = int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = done.select("key", "word", "n").repartition(parts, "key").sortWithinPartitions("key", "word")
    return lists.mapInArrow(_pairs, "a string, n_a long, b string, n_b long").distinct()


def roots(links: DataFrame, paths: list[str]) -> DataFrame:
    """(word, root) of acyclic `links` (word, form), by doubling."""
    now = links.select("word", F.col("form").alias("root"))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = settle(now.join(ahead, "root", "left"), "roots", paths)
        now = stepped.select("word", F.coalesce("next", "root").alias("root"))
        if stepped.where("next is not null").isEmpty():
            return now


def group_variants(
    docs: DataFrame, *, doc_id="doc_id", text="text", slips=False, least_length=LEAST_LENGTH, least_count=LEAST_COUNT, ratio=RATIO
) -> DataFrame:
    """Per word of the vocabulary: word, form, root, n, n_near, form_n."""
    paths: list[str] = []
    counted = count_words(docs, doc_id=doc_id, text=text, slips=slips, least_length=least_length)
    vocabulary = settle(counted.where(F.col("n") >= least_count), "vocabulary", paths)
    pairs = settle(near_words(vocabulary, paths), "pairs", paths)
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionAll(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))
    )
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    led = F.col("best.less") <= -ratio * F.col("n")
    formed = settle(
        vocabulary.join(best, "word", "left").select(
            "word",
            F.when(led, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(led, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
        paths,
    )
    ends = roots(formed.where("form is not null").select("word", "form"), paths)
    out = formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    out = settle(out, "variants")
    drop_tables(docs.sparkSession, paths)
    return out


ORACLE = """
WITH RECURSIVE runs AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS prefix,
        unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
    FROM documents),
counted AS (SELECT prefix, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (SELECT *, hex(encode(prefix || run)) AS h FROM counted),
sums AS (SELECT run, n, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
    lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1))))) AS crc FROM bytes),
slipped AS (SELECT n, CASE WHEN crc % 199 = 0
    THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word FROM sums),
vocabulary AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
holes AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM holes),
pairs AS (
    SELECT x.word, y.word AS near, y.n AS near_n FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
    UNION SELECT x.word, y.word, y.n FROM cut x JOIN vocabulary y ON y.word = x.a || x.b
    UNION SELECT y.word, x.word, x.n FROM cut x JOIN vocabulary y ON y.word = x.a || x.b),
ranked AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near,
    row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM pairs),
formed AS (SELECT v.word, v.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= 5 * v.n THEN r.near END AS form,
    CASE WHEN r.near_n >= 5 * v.n THEN r.near_n END AS form_n FROM vocabulary v LEFT JOIN ranked r ON r.word = v.word AND r.place = 1),
steps AS (SELECT word, word AS here, 0 AS depth FROM formed
    UNION ALL SELECT s.word, f.form, s.depth + 1 FROM steps s JOIN formed f ON f.word = s.here WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(here, depth) AS root FROM steps GROUP BY word)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM formed JOIN ends USING (word)
"""
