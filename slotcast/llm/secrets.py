"""Secret scans with DataFrame functions only: pattern spans plus sliding-window entropy spans.

Patterns give the base spans. For every character class in `CLASSES`, maximal runs of the class
are candidate strings. A window of `WINDOW` characters slides over a candidate; the counts of its
characters change by one in and one out per step, and with them the sum of c*log2(c), so a step
costs the same whatever the window. The entropy of a window is log2(WINDOW) - sum / WINDOW bits. A
candidate that the allow list does not name and that has a window over the class's threshold gives
a span from its first such window's start to its last one's end. The allow list suppresses entropy
spans only; base spans stay.

c*log2(c) is kept in whole 2**-20 parts, so sums are exact in any order.

All work is a projection: no shuffle, no Python. Positions come from the lengths of the gaps that
`split` leaves around the matches of `regexp_extract_all`, in code points, end exclusive.

A null or empty text has no spans: zero counts, empty `spans`, and the hash of the empty string.
Repeated rows each give a row, an empty table gives none, other columns are ignored by `scan` and
kept by `redact`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, in the order in which kinds are listed.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # the runs of [0-9a-f]+ with 16 or more characters
BASE = ("assign", "access", "hex")

WINDOW = 20
SCALE = 1 << 20
#: class: (characters, run pattern, bits per character that a window must reach)
CLASSES = {
    "hex_entropy": ("0123456789abcdef", r"[0-9a-f]{20,}", 3.0),
    "mixed_entropy": (
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-",
        r"[A-Za-z0-9+/_=-]{20,}",
        3.7,
    ),
}
#: Candidates that match one of these from start to end are not secrets by themselves.
ALLOWED = (
    r"[0-9]+",
    r"[A-Za-z+/_=-]+",
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
    r".*(EXAMPLE|[Ee]xample|[Ss]ample|[Dd]ummy|[Pp]laceholder|[Cc]hangeme).*",
    r".*(0123456789abcdef|abcdefghijklmnop|ABCDEFGHIJKLMNOP).*",
)
KINDS = BASE + tuple(CLASSES)
PART = [round(c * math.log2(c) * SCALE) if c else 0 for c in range(WINDOW + 1)]
SPAN = "array<struct<start:int,rank:int,end:int>>"


def most_parts(bits: float) -> int:
    """The largest sum of c*log2(c) parts whose window still has `bits` of entropy."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * SCALE)


def _matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, match, second group) of all matches, left to right."""
    regex = F.lit(pattern)
    whole = F.regexp_extract_all(text, regex, F.lit(0))
    second = F.regexp_extract_all(text, regex, F.lit(2)) if pattern == ASSIGN else whole
    parts = F.arrays_zip(
        whole.alias("m"), second.alias("g"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)).alias("gap")
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["m"])
        found = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"), x["g"].alias("g"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(found)).alias("out"))

    empty = F.array().cast("array<struct<start:int,end:int,m:string,g:string>>")
    folded = F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]
    return F.when(text.rlike(pattern), folded).otherwise(empty)


def _spans(matches: Column, kind: str) -> Column:
    """(start, rank, end) of the matches, which sorts as the contract lists spans."""
    return F.transform(
        matches, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end"))
    ).cast(SPAN)


def _entropy_window(candidate: Column, alphabet: str, bits: float) -> Column:
    """(first, last): where the first window with enough entropy begins and the last one ends; -1 without one."""
    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(alphabet), c))
    part = F.array(*[F.lit(p) for p in PART])
    start = F.struct(
        codes.alias("codes"),
        F.array_repeat(F.lit(0), len(alphabet)).alias("counts"),
        F.lit(0).alias("sum"),
        F.lit(-1).alias("first"),
        F.lit(-1).alias("last"),
    )

    def step(acc: Column, i: Column) -> Column:
        come = F.get(acc["codes"], i)
        go = F.when(i >= WINDOW, F.get(acc["codes"], i - WINDOW)).otherwise(F.lit(0))
        c_in = F.get(acc["counts"], come - 1)
        c_out = F.when(go > 0, F.get(acc["counts"], go - 1)).otherwise(F.lit(1))
        change = (F.get(part, c_in + 1) - F.get(part, c_in)) + F.when(go > 0, F.get(part, c_out - 1) - F.get(part, c_out)).otherwise(F.lit(0))
        total = acc["sum"] + F.when(come == go, F.lit(0)).otherwise(change)
        counts = F.transform(
            acc["counts"], lambda c, k: c + F.when(k == come - 1, 1).otherwise(0) - F.when(k == go - 1, 1).otherwise(0)
        )
        enough = (i >= WINDOW - 1) & (total <= most_parts(bits))
        return F.struct(
            acc["codes"].alias("codes"),
            counts.alias("counts"),
            total.alias("sum"),
            F.when(enough & (acc["first"] < 0), i - (WINDOW - 1)).otherwise(acc["first"]).alias("first"),
            F.when(enough, i + 1).otherwise(acc["last"]).alias("last"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.char_length(candidate) - 1), start, step, lambda acc: F.struct(acc["first"], acc["last"]))


def _entropy_spans(matches: Column, kind: str) -> Column:
    alphabet, _, bits = CLASSES[kind]
    allowed = "^(?:" + "|".join(ALLOWED) + ")$"
    rated = F.transform(
        F.filter(matches, lambda m: ~m["m"].rlike(allowed)),
        lambda m: F.struct(m["start"].alias("at"), _entropy_window(m["m"], alphabet, bits).alias("w")),
    )
    return F.transform(
        F.filter(rated, lambda r: r["w"]["first"] >= 0),
        lambda r: F.struct(
            (r["at"] + r["w"]["first"]).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (r["at"] + r["w"]["last"]).alias("end")
        ),
    ).cast(SPAN)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _with_spans(docs: DataFrame, text: str) -> DataFrame:
    """One struct column, named so that no input column has its name, with the spans of every kind."""
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    assign = F.filter(_matches(content, ASSIGN), lambda m: F.char_length(m["g"]) >= 12)
    access = F.filter(_matches(content, ACCESS), lambda m: F.char_length(m["m"]) >= 18)
    found = {"assign": _spans(assign, "assign"), "access": _spans(access, "access"), "hex": _spans(_matches(content, HEX), "hex")}
    found |= {kind: _entropy_spans(_matches(content, CLASSES[kind][1]), kind) for kind in CLASSES}
    return docs.withColumn(free_name(docs, "spans"), F.struct(*[c.alias(k) for k, c in found.items()]))


def free_name(docs: DataFrame, name: str) -> str:
    """`name`, with underscores added until no column of `docs` has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def scan(docs: DataFrame, *, doc_id="doc_id", text="text") -> DataFrame:
    """Per row: doc_id, counts of the base kinds, base_sha256 and all spans as text."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = _with_spans(docs, "text").select(
        "doc_id",
        *[F.size(f"spans.{k}").cast("bigint").alias(f"n_{k}") for k in BASE],
        F.array_sort(F.concat(*[F.col(f"spans.{k}") for k in BASE])).alias("base"),
        F.array_sort(F.concat(*[F.col(f"spans.{k}") for k in KINDS])).alias("all"),
    )
    return rows.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("all")).alias("spans")
    )


def redact(docs: DataFrame, *, text="text", n_chars: str | None = "n_chars", mark="[SECRET]") -> DataFrame:
    """`docs` with every span, overlapping ones as one, replaced by `mark`; other rows unchanged.

    `n_chars`, where it names a column, follows the new text in changed rows.
    """
    name = free_name(docs, "spans")
    content = F.col(f"`{text}`")
    spans = F.array_sort(F.concat(*[F.col(f"`{name}`.{k}") for k in KINDS]))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        cut = F.concat(acc["out"], F.substring(content, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, cut).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cleaned = F.aggregate(
        spans, start, step, lambda acc: F.concat(acc["out"], F.substring(content, acc["at"] + 1, F.char_length(content)))
    )
    # of its own step: an expression beside the new text would read that one
    new = free_name(docs, "cleaned")
    changed = _with_spans(docs, text).withColumn(new, F.when(F.size(spans) > 0, cleaned))
    columns = []
    for c in docs.columns:
        if c == text:
            columns.append(F.coalesce(F.col(new), content).alias(c))
        elif c == n_chars:
            columns.append(F.coalesce(F.char_length(new).cast(docs.schema[c].dataType), F.col(f"`{c}`")).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return changed.select(*columns)


def _oracle() -> str:
    """The same spans in DuckDB SQL; windows are counted anew at every place instead of incrementally."""

    def kind_rows(name: str, pattern: str, keep: str) -> str:
        quoted = pattern.replace("'", "''")
        return f"""
        SELECT doc_id, '{name}' AS kind, {KINDS.index(name)} AS rank, s AS start, s + length(m) AS "end", m FROM (
          SELECT doc_id, ms[i] AS m, gs[i] AS g,
                 list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS s
          FROM (SELECT doc_id, ms, gs, gaps, unnest(range(1, len(ms) + 1)) AS i FROM (
            SELECT doc_id, regexp_extract_all(text, '{quoted}') AS ms, regexp_extract_all(text, '{quoted}', {2 if name == "assign" else 0}) AS gs,
                   string_split_regex(text, '{quoted}') AS gaps FROM d)))
        WHERE {keep}"""

    base = [kind_rows("assign", ASSIGN, "length(g) >= 12"), kind_rows("access", ACCESS, "length(m) >= 18"), kind_rows("hex", HEX, "true")]
    allowed = ("^(?:" + "|".join(ALLOWED) + ")$").replace("'", "''")
    parts = "[" + ", ".join(map(str, PART)) + "]"
    more = []
    for kind, (_, pattern, bits) in CLASSES.items():
        runs = kind_rows(kind, pattern, f"NOT regexp_matches(m, '{allowed}')")
        more.append(f"""
        SELECT doc_id, kind, rank, min(start + o) AS start, max(start + o + {WINDOW}) AS "end" FROM (
          SELECT doc_id, kind, rank, start, m, o, substr(m, o + 1, {WINDOW}) AS w
          FROM (SELECT *, unnest(range(0, length(m) - {WINDOW - 1})) AS o FROM ({runs})))
        WHERE list_sum(list_transform(list_distinct(string_split(w, '')), lambda c: {parts}[length(w) - length(replace(w, c, '')) + 1])) <= {most_parts(bits)}
        GROUP BY doc_id, kind, rank, start, m""")
    spans = "\nUNION ALL\n".join(f'SELECT doc_id, kind, rank, start, "end" FROM ({q})' for q in base + more)
    listed = "string_agg(kind || ':' || start || ':' || \"end\", ',' ORDER BY start, rank, \"end\")"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
     s AS ({spans})
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(listed, '') AS spans
FROM d LEFT JOIN (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex, {listed} FILTER (rank < {len(BASE)}) AS base, {listed} AS listed
  FROM s GROUP BY doc_id) USING (doc_id)"""


ORACLE = _oracle()
