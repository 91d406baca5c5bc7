import hashlib
import random
import re

import pytest

from slotcast.llm import components, jaccard, substrings

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    w = WORD.findall(lower(text))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(rows):
    sets, parent = [(i, shingles(t)) for i, t in rows], {}
    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets}


def test_components_equal_all_pairs(spark, docs, corpus):
    got = [r for r in jaccard.link(docs).collect()]
    want = brute_components(corpus)
    assert len(got) == len(corpus) + 2
    for r in got:
        if r.doc_id is None:
            assert (r.n_shingles, r.component_id) == (1, None)
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]


def test_frequent_tokens_do_not_change_links(spark, docs, corpus, monkeypatch):
    monkeypatch.setattr(jaccard.frequent_tokens, "__defaults__", (2, 1 << 20))
    want = brute_components(corpus)
    assert {r.doc_id: r.component_id for r in jaccard.link(docs).collect() if r.doc_id is not None} == {i: c for i, (_, c) in want.items()}


def test_keep_first_keeps_columns_and_one_of_each_group(spark, docs, corpus):
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    want = {i for i, (_, c) in brute_components(corpus).items() if i == c}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(want)


def test_pairs_of_many_shared_lists_are_one_row(spark, monkeypatch):
    """Copies with too many edits to link to the hub share most of their lists; some link to each other."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 70):
        words = list(base)
        for at in rng.sample(range(10, 110, 10), rng.randrange(4, 9)):
            words[at] = "other"
        rows.append((i, " ".join(words)))
    found, open_rows = [], jaccard._open_rows

    def watched(*args):
        out = open_rows(*args)
        found.extend(tuple(sorted(r)) for r in out.collect())
        return out

    monkeypatch.setattr(jaccard, "_open_rows", watched)
    want = {i: c for i, (_, c) in brute_components(rows).items()}
    got = {r.doc_id: r.component_id for r in jaccard.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    assert len(found) > 20 and len(found) == len(set(found))


def linked_keys():
    """Null ids and shared ids of different texts, some linked to smaller ids, some to each other, some alone; repeated and empty rows."""
    def words(tag, n, edits=0):
        return " ".join(f"{tag}{i}" for i in range(n - edits)) + "".join(f" e{i}" for i in range(edits))

    rows = [(1, words("a", 60)), (2, words("b", 60)), (4, words("c", 60)), (4, words("d", 60)), (4, words("c", 60))]
    rows += [(5, words("d", 60, 3)), (5, words("f", 60)), (6, words("b", 60, 2)), (6, words("g", 60)), (7, words("f", 60, 1))]
    rows += [(None, words("a", 60, 2)), (None, words("h", 60)), (None, words("i", 60)), (None, words("i", 60, 3)), (None, words("j", 60).upper())]
    return rows + [(None, words("j", 60)), (None, "short one"), (None, ""), (None, None), (None, words("h", 60)), (8, ""), (8, words("k", 60))]


def brute_rows(rows):
    """Per row: size of its set, members of its component (row numbers)."""
    sets = [shingles(t) for _, t in rows]
    groups = [{i} for i in range(len(rows))]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b) and groups[i] is not groups[j]:
                groups[i] |= groups[j]
                for k in groups[j]:
                    groups[k] = groups[i]
    return sets, groups


def test_rows_without_id_or_with_a_shared_one_link_by_their_own_text(spark):
    rows = linked_keys()
    sets, groups = brute_rows(rows)
    ids = [[rows[k][0] for k in g if rows[k][0] is not None] for g in groups]
    want = sorted(str((d, len(s), min(i, default=None))) for (d, _), s, i in zip(rows, sets, ids, strict=True))
    got = jaccard.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(str(tuple(r)) for r in got) == want


def test_keep_first_keeps_unlinked_rows_without_id_or_with_a_shared_one(spark):
    rows = linked_keys()
    sets, groups = brute_rows(rows)
    kept = [(r.doc_id, r.text) for r in jaccard.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert len(kept) == len(set(kept))
    assert {r for r in kept if not shingles(r[1])} == {r for r in rows if not shingles(r[1])}
    for g in {frozenset(g) for g, s in zip(groups, sets, strict=True) if s}:
        least = min((rows[k][0] is None, rows[k][0] or 0) for k in g)
        left = [r for r in kept if r in {rows[k] for k in g}]
        assert len(left) == 1 and (left[0][0] is None, left[0][0] or 0) == least


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501)], "a long, b long")
    got = dict(map(tuple, components.components(edges, []).collect()))
    assert got == {i: 0 for i in range(101)} | {500: 500, 501: 500}


def brute_kept(rows, window=20):
    seen, out = set(), {}
    for i, text in rows:
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_removed_words_equal_a_scan_of_all_windows(spark, docs, corpus):
    want = brute_kept(corpus)
    got = substrings.remove_repeats(docs).collect()
    assert len(got) == len(corpus) + 2
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]


def brute_rows_kept(rows, window=20):
    """As brute_kept, by row: a window is a repeat of a smaller id (null is the largest) or of an earlier start in its row."""
    ranked = [(float("inf") if i is None else i, WORD.findall(t or "")) for i, t in rows]
    least = {}
    for rank, w in ranked:
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            least[key] = min(rank, least.get(key, rank))
    out = []
    for (i, _), (rank, w) in zip(rows, ranked, strict=True):
        gone, seen = [False] * len(w), set()
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen or least[key] < rank:
                gone[s : s + window] = [True] * window
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((str(i), len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def shared_keys():
    """Several rows with a null id, and ids of two texts: copies, passages of smaller ids, of each other, and of their own."""
    def words(tag, n):
        return " ".join(f"{tag}{i}" for i in range(n))

    base, passage, other = words("b", 60), words("p", 30), words("q", 25)
    rows = [(1, base), (2, words("x", 10) + " " + passage), (3, words("y", 50)), (3, passage + " " + words("z", 40)), (3, words("y", 50))]
    rows += [(None, base), (None, words("u", 60)), (None, words("v", 33) + " " + passage + " " + words("w", 5)), (None, None), (None, "")]
    rows += [(None, other + " " + words("m", 30)), (None, words("k", 7) + " " + other), (None, other + " k " + other), (None, words("u", 60))]
    return rows + [(9, words("s", 45)), (9, words("t", 12) + " " + words("s", 45)), (11, words("t", 5) + " " + words("s", 45) + " " + words("r", 30))]


def test_rows_without_id_or_with_a_shared_one_keep_their_own_words(spark):
    rows = shared_keys()
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_rows_kept(rows)


@pytest.mark.parametrize("run", [jaccard.link, jaccard.keep_first, substrings.remove_repeats])
def test_empty_table(no_docs, run):
    assert run(no_docs).count() == 0
