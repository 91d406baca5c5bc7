"""Prefix trie, token records and spelling variants against plain versions."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from slotcast.llm import prefix_trie, records, spelling
from slotcast.llm.queries import word_vocabulary
from slotcast.sources.shared import new_path

# -- conversations --------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, d long, k1 string, length long"


def plain_nodes(strings: dict[int, list[tuple[str, str]]]) -> set[tuple]:
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in strings.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    return {
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k],
         hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest())
        for k, m in members.items()
    }


def found_nodes(df) -> set[tuple]:
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows = [tuple(r) for r in df.select(*names).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def dialogues(rng, n, longest, texts=("a", "b", "é")):
    out = {}
    for c in range(n):
        if out and rng.random() < 0.6:
            turns = list(rng.choice(list(out.values())))
            turns = turns[: rng.randint(0, len(turns))] + [("u", rng.choice(texts)) for _ in range(rng.randint(0, 3))]
        else:
            turns = [(rng.choice("ua"), rng.choice(texts)) for _ in range(rng.randint(1, longest))]
        out[c * 3 - 7] = turns or [("u", "a")]
    return out


def as_table(spark, strings, extra=()):
    rows = [(c, t * 10, r, x, 1, "mine", 2) for c, turns in strings.items() for t, (r, x) in enumerate(turns)]
    return spark.createDataFrame([*rows, *extra], TURNS).repartition(3)


@pytest.mark.parametrize("seed, longest, shares", [(1, 6, (1, 7)), (2, 40, (1, 2, 3)), (3, 12, (1,))])
def test_trie_equals_plain_nodes(spark, monkeypatch, seed, longest, shares):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    strings = dialogues(random.Random(seed), 50, longest)
    strings[1000] = strings[1001] = [("u", "long")] * 33
    strings[1002] = [("u", "long")] * 32 + [("a", "other")]
    assert found_nodes(prefix_trie.trie(as_table(spark, strings), shares=shares)) == plain_nodes(strings)


def test_replayed_conversations_equal_sql(spark):
    rng = random.Random(9)
    strings = dialogues(rng, 60, 12)
    extra = [(4, None, None, "first", 0, None, None), (4, None, "u", None, 0, None, None), (4, 0, "u", "tie", 0, None, None),
             (4, 0, "u", "tie", 0, None, None), (4, 0, "a", "tie", 0, None, None), (None, 1, "u", "nobody", 0, None, None)]
    table = as_table(spark, strings, extra)
    con = duckdb.connect()
    con.register("conversations", table.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    rel = con.sql(prefix_trie.ORACLE)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert found_nodes(prefix_trie.replayed_trie(table)) == set(rel.project(",".join(names)).fetchall())


def test_turnless_conversations_belong_to_the_root(spark):
    # 1 takes the first crc32("1") % 9 turns of 0, which is absent, and has no turns beyond
    h = zlib.crc32(b"1") % 9
    table = as_table(spark, {1: [("u", "x")] * max(h, 1)})
    rows = found_nodes(prefix_trie.replayed_trie(table))
    assert rows == {(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())}


def test_no_conversations_no_nodes(spark):
    table = spark.createDataFrame([], TURNS)
    assert found_nodes(prefix_trie.trie(table)) == found_nodes(prefix_trie.replayed_trie(table)) == set()


def test_two_fattest(spark):
    pairs = spark.range(0, 70).crossJoin(spark.range(1, 71).toDF("high")).where("id < high").toDF("low", "high")
    for low, high, f in pairs.withColumn("f", prefix_trie.two_fattest("low", "high")).collect():
        assert f == max(range(low + 1, high + 1), key=lambda x: x & -x)


def test_many_ids_that_end_at_one_node(spark):
    n = 3 * prefix_trie.PACK + 5
    ends = spark.range(n).select(F.lit(2).cast("long").alias("depth"), F.lit(7).cast("long").alias("k1"), F.lit(8).cast("long").alias("k2"), F.col("id").alias("conv_id"))
    ((*_, digest),) = prefix_trie.end_hashes(ends.repartition(5)).collect()
    assert digest == hashlib.sha256(",".join(map(str, range(n))).encode()).hexdigest()


# -- records --------------------------------------------------------------------------------------


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_vocabulary())


def plain_crc32c(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_crc32c_equals_bitwise():
    assert records.crc32c([b"123456789"]).tolist() == [0xE3069283]
    rng = np.random.default_rng(3)
    parts = [rng.bytes(n) for n in (4, 5, 511, 512, 513, 1024, 3000, 8, 16)]
    assert records.crc32c(parts).tolist() == [plain_crc32c(p) for p in parts]
    assert records.crc32c([]).tolist() == []


TEXTS = [
    "Hello world, don't stop... A.B.C.", "", None, " \t\r\n ", "a\x1cb\x85c　d", "ÀÉÎ Straße ΣΑΣ ΟΔΟΣ İstanbul", "é café, Å ﬁ", "漢字, かな。🙂x",
    "<|endoftext|> and<|startoftext|>", "x" * 5000, "$%&! ?! 'tis it's, (1234) 5.5", "many words " * 9000, "µm ª º, naïve; ok?",
]


def test_ids_equal_the_library(monkeypatch):
    monkeypatch.setattr(records, "SLICE", 1000)
    monkeypatch.setattr(records, "TABLE", 20)
    coder, lib = records.Encoder(word_vocabulary()), library()
    for text in [t for t in TEXTS if t] * 2:
        assert np.frombuffer(coder.ids(text), coder.kind).tolist() == lib.encode(text, add_special_tokens=False).ids


def record_docs(spark):
    rows = [(i, t, "mine") for i, t in enumerate(TEXTS)] + [(None, "no id", "x"), (None, "no id either", "y"), (3, "same id", "z"), (5, TEXTS[5], "copy")]
    return spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(4)


def test_records_round_trip(spark):
    docs, lib = record_docs(spark), library()
    rows = records.round_trip(docs, word_vocabulary()).orderBy("start").collect()
    want = Counter()
    for r in docs.collect():
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 1]
        want[r.doc_id, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    keys = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert keys == sorted(keys)
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()


def test_files_follow_the_format_and_read_in_any_order(spark):
    docs = record_docs(spark)
    folder = new_path(spark, "records")
    manifest = records.write_records(docs, folder, word_vocabulary(), file_bytes=1)
    first = manifest.orderBy("part", "seq").first()
    with open(f"{first.path}.records", "rb") as file:
        data = file.read()
    length, of_length = struct.unpack_from("<QI", data)
    body, of_data = data[12 : 12 + length], struct.unpack_from("<I", data, 12 + length)[0]

    def mask(crc):
        return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF

    assert of_length == mask(plain_crc32c(data[:8])) and of_data == mask(plain_crc32c(body))
    in_order = records.read_records(manifest, folder).collect()
    shuffled = records.read_shuffled(manifest, folder, seed=5).collect()
    assert sorted((r.doc_id or -1, r.token_ids) for r in shuffled) == sorted((r.doc_id or -1, r.token_ids) for r in in_order)
    assert [r.position for r in shuffled] == sorted(r.position for r in shuffled)
    assert [r.doc_id for r in shuffled] != [r.doc_id for r in records.read_shuffled(manifest, folder, seed=6).collect()]


def test_a_changed_byte_is_noticed():
    frame = bytearray(next(records.frames([records.serialize(1, b"\x01\x00\x02\x00", 2)])))
    assert records.parse(records.unframe([bytes(frame)])[0])[1].tolist() == [1, 2]
    frame[-6] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        records.unframe([bytes(frame)])


def test_no_documents_no_records(spark):
    assert records.round_trip(record_docs(spark).limit(0), word_vocabulary()).count() == 0


# -- spelling -------------------------------------------------------------------------------------


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def random_words(rng, letters, n, longest):
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(n)})


@pytest.mark.parametrize("letters, longest", [("ab", 9), ("abcé", 6), ("a", 12)])
def test_matches_equal_brute_force(letters, longest):
    rng = random.Random(4)
    for _ in range(120):
        words = random_words(rng, letters, rng.randint(0, 60), longest)
        want = {(i, k) for k in range(len(words)) for i in range(k) if one_edit(words[i], words[k])}
        found = list(spelling.matches(words))
        assert set(found) == want and len(found) == len(want)


@pytest.mark.parametrize("group", [1, 8, 1000])
def test_dealt_groups_lose_no_pair(spark, group):
    words = random_words(random.Random(6), "abé", 400, 11)
    vocabulary = spark.createDataFrame([(w, len(w)) for w in words], "word string, n long")
    found = [(r.a, r.b) for r in spelling.near_words(vocabulary, [], group).collect()]
    assert len(found) == len(set(found))
    assert {tuple(sorted(p)) for p in found} == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}


def plain_variants(rows) -> dict:
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 6 and k >= 5}
    near = {w: [v for v in n if one_edit(v, w)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def spelling_rows():
    rng = random.Random(12)
    base = ["".join(rng.choice("aeioñßrst") for _ in range(rng.randint(6, 9))) for _ in range(30)]
    words = []
    for k, w in enumerate(base):
        words += [w] * 400 if k % 2 else [w.upper()] * 30
        for _ in range(4):
            i = rng.randrange(len(w))
            words += [w[:i] + rng.choice("xyé") + w[i + 1 :]] * rng.choice([3, 5, 16, 80])
    words += ["Chaines"] * 700 + ["chainez"] * 130 + ["chainezz"] * 20 + ["tie" + c + "wort" for c in "ab"] * 50 + ["tiewort"] * 5
    rng.shuffle(words)
    rows = [(i, rng.choice([" ", ", ", "\n", "-"]).join(words[i * 40 : i * 40 + 40])) for i in range(len(words) // 40 + 1)]
    return [*rows, (None, "chaines chaines"), (None, None), (7, None), (8, ""), rows[3], (9, "a×b÷c ÿÿÿÿÿÿ " * 6)]


def test_variants_equal_brute_force_and_sql(spark):
    rows = spelling_rows()
    docs = spark.createDataFrame([(*r, "mine", 1) for r in rows], "doc_id long, text string, word string, n long").repartition(3)
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_variants(docs, slips=True).collect()}
    assert found == plain_variants(rows)
    assert any(f is not None and r != f for f, r, *_ in found.values())
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    rel = con.sql(spelling.ORACLE).project("word, form, root, n, n_near, form_n").fetchall()
    assert {w: tuple(x) for w, *x in rel} == found


def test_long_texts_are_read_in_slices(spark, monkeypatch):
    gap = re.compile("[^a-z]")
    monkeypatch.setattr(spelling, "SLICE", 10)
    text = "abcdefghijklmnop q rstuvwxyzabc" * 3
    parts = list(spelling._slices(text, gap))
    assert "".join(parts) == text and len(parts) > 2
    assert [w for p in parts for w in re.findall("[a-z]+", p)] == re.findall("[a-z]+", text)


def test_no_documents_no_variants(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.group_variants(docs).count() == 0
