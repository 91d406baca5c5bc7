import base64
import hashlib
import io
import zipfile
import zlib

import numpy as np
import pytest

from slotcast.llm import html_blocks as hb
from slotcast.llm import wacz

PAGES = [
    (0, "http://a.example/ü x", "<p>one</p>"), (1, None, "<p>two</p>"), (2, "u", "<p>one</p>"), (3, "u", None), (4, "u", ""), (5, "u\r\nX: y", "é🙂" * 5000),
    (2, "again", "<p>one</p>"), (None, "n", "<p>one</p>"), (0, "b", "<p>one</p>"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, 1, "x") for p in PAGES], "page_id long, url string, html string, first int, digest string").repartition(3)


@pytest.mark.parametrize("least", [0, 11])
def test_records_come_back(pages, least):
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    got = sorted(wacz.round_trip(pages, least=least).collect(), key=str)
    want = []
    for i, _, h in PAGES:
        payload = (h or "").encode()
        whole = len(payload) < least or i == first[h or ""]
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        want.append((i, len(payload), digest, "response" if whole else "revisit", None if whole else first[h or ""]))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


class File(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("zip64", [False, True])
def test_archives_are_zip_files_and_records_are_read_by_range(zip64):
    records = [(wacz._gzip(wacz.record_bytes(i, f"u{i}", b"x" * i, None, False, "2024-01-01T00:00:00Z")), str(i)) for i in range(50)]
    content = wacz.pack(records, zip64)
    assert zipfile.ZipFile(io.BytesIO(content)).testzip() is None
    archive = wacz.Archive(File(content))
    assert [len(archive.record(at, n)["payload"]) for at, n in archive.index()] == list(range(50))


def test_zip64_directory():
    """All 32-bit fields replaced by their 64-bit forms."""
    import struct

    content = wacz.pack([(wacz._gzip(wacz.record_bytes(1, "u", b"abc", None, False, "d")), "1")])
    end = content.rfind(b"PK\x05\x06")
    count, size, at = struct.unpack_from("<H2I", content, end + 10)
    record = struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, size, at)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1)
    tail = struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    archive = wacz.Archive(File(content[:end] + record + locator + tail))
    assert [archive.record(*p)["payload"] for p in archive.index()] == [b"abc"]


def test_broken_files_are_errors():
    with pytest.raises(ValueError):
        wacz.Archive(File(b"no zip"))
    record = wacz.record_bytes(1, "u", b"abc", None, False, "d").replace(b"abc", b"abd")
    with pytest.raises(ValueError):
        wacz.parse_record(zlib.decompress(wacz._gzip(record), 31))


def test_leaves():
    page = """<html><head><title>t</title><style>p{}</style></head><body><!-- x > y --><nav><a href=1>Menu</a></nav>
      <article class="post main"><h1>A &amp; B</h1><p>one <b>two</b>
      three<p>open<br>next</article><script>"</p>"</script>tail</body></html>"""
    found = hb.leaves(page)
    assert [leaf.text for leaf in found] == ["Menu", "A & B", "one two three", "open", "next", "tail"]
    assert found[0].linked == 4 and "class:post" in found[1].path and "article" not in found[-1].path
    for broken in ("", "<", "<p", "</p></div>", "<p class='", "<script>never closed", "a<b>c", "<!-- open"):
        hb.leaves(broken)


LONG = {
    "nested": lambda n: "<div class='a b c'>x" * n,
    "unclosed": lambda n: "<a " * n,
    "quoted signs": lambda n: "<a \"x>\" " * n,
    "open quotes": lambda n: "<a '" * n,
    "declarations": lambda n: "<!a" * n,
    "skipped": lambda n: "<select>a" * n,
    "inline ends": lambda n: "<i><div>" + "<b>" * n + "</i>" * n,
    "strange ends": lambda n: "<div>" * n + "</p>" * n,
}


@pytest.mark.parametrize("kind", LONG)
def test_work_is_linear_in_the_page(kind):
    """Counted in calls, not seconds: twice the page is about twice the work."""
    import sys

    def work(n):
        calls = 0

        def count(frame, event, arg):
            nonlocal calls
            calls += event in ("call", "c_call")

        page = LONG[kind](n)
        hb.leaves(page)  # fills the tables of hashed words
        sys.setprofile(count)
        hb.leaves(page)
        sys.setprofile(None)
        return calls

    assert work(4000) < 2.2 * work(2000) + 100


def test_paths_are_whole_and_formulas_stay():
    deep = "".join(f"<div class='{' '.join(f'w{chr(97 + i)}{chr(97 + j)}' for j in range(12))}'>" for i in range(20)) + "<nav><p>x"
    (leaf,) = hb.leaves(deep)
    assert len(leaf.path) == 20 * 13 + 2 and "class:wal" in leaf.path and leaf.path[0] == "div"
    assert hb.vectors([leaf])[0, hb._place("class:wal", hb.TAG_PLACES)] == 1
    assert [x.text for x in hb.leaves("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> and<svg><text>y</text></svg>")] == ["so x=2 andy"]


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    model = hb.Labeller(width=5, hidden=3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, y, mask = rng.normal(size=(4, 2, 5)), rng.integers(0, 2, (4, 2)).astype(float), np.ones((4, 2))
    mask[3, 1] = 0

    def loss():
        p = hb._sigmoid(model.logits(x))
        return -(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum()

    for name, grad in model.gradients(x, y, mask).items():
        flat, at = model.p[name].reshape(-1), rng.integers(model.p[name].size)
        before, step = flat[at], 1e-4
        flat[at] = before + step
        up = loss()
        flat[at] = before - step
        down = loss()
        flat[at] = before
        assert abs((up - down) / (2 * step) - grad.reshape(-1)[at]) < 1e-4, name


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(1)
    words = [f"word{i}" for i in range(300)]
    texts = ["\n".join(" ".join(rng.choice(words, rng.integers(5, 60))) + "." for _ in range(rng.integers(1, 12))) for _ in range(60)]
    return hb.train(hb.composed(texts, 300), epochs=10), texts


def test_labels_of_new_pages(model):
    labeller, texts = model
    right = total = 0
    for found, y in hb.composed(texts, 60, seed=77):
        right += ((labeller.probabilities(found) >= 0.5) == y).sum()
        total += len(y)
    assert right / total > 0.97


MENU = "<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav>"
FOOT = "<footer><p>Copyright 2024 Example Ltd.</p><a href=/p>Privacy</a></footer>"
MET = "The committee met on Tuesday to discuss the results of the survey, and agreed that the plan would be revised before the spring."
ASKED = "Several members asked for figures by region, since the totals hide large differences between the coast and the hills."
ROWS = [(f"Area {i}", str(i * 3.5)) for i in range(1, 8)]
#: Pages written by hand, in layouts that `compose` does not copy, and the blocks of their articles.
BY_HAND = {
    "table": (
        f"{MENU}<article><h1>Survey results</h1><p>{MET}</p><table>" + "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in ROWS) + f"</table><p>{ASKED}</p></article>{FOOT}",
        ["Survey results", MET, *[x for row in ROWS for x in row], ASKED],
    ),
    "lists": (
        f"{MENU}<main><h1>Survey results</h1><p>{MET}</p><ol><li>Collect the forms</li><li>Count the answers twice</li></ol><dl><dt>Share</dt>"
        f"<dd>Part of all answers in a region</dd></dl><p>{ASKED}</p></main><aside><h3>Most read</h3><ul><li><a href=/1>Storm warning</a></li></ul></aside>{FOOT}",
        ["Survey results", MET, "Collect the forms", "Count the answers twice", "Share", "Part of all answers in a region", ASKED],
    ),
    "code and comments": (
        f"{MENU}<div class=post><h1>Reading files</h1><p>{MET}</p><pre><code>for line in open(name): print(line)</code></pre><p>{ASKED}</p></div>"
        f"<div class=comments><h3>2 comments</h3><div><p>Great post, thanks! I learned a lot.</p></div></div>{FOOT}",
        ["Reading files", MET, "for line in open(name): print(line)", ASKED],
    ),
    "nested": (
        f"<div class='aa bb cc dd ee ff'><div class='gg hh ii jj kk ll'><div class='mm nn oo pp'>{MENU}<div class='flex grid'><article class='content w-full'>"
        f"<h1>Survey results</h1><p>{MET}</p><p>{ASKED}</p></article></div>{FOOT}</div></div></div>",
        ["Survey results", MET, ASKED],
    ),
}


def test_pages_written_by_hand(model):
    labeller, _ = model
    got = {kind: hb.main_text(f"<html><body>{page}</body></html>", labeller).split("\n") for kind, (page, _) in BY_HAND.items()}
    assert got == {kind: want for kind, (_, want) in BY_HAND.items()}


def test_main_text_of_tables(spark, model):
    labeller, _ = model
    page = (
        "<html><body><nav class=menu><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul></nav><article><h1>Word1 word2</h1>"
        + "<p>Word3 word4 word5 word6 &lt;word7&gt; and   word8 word9 word10 word11 word12 word13.</p>" * 4
        + "</article><footer>&copy; 2024 site.example. All rights reserved.</footer></body></html>"
    )
    rows = [(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", None), (None, "u", page, "x"), (1, "u", page, "x")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = hb.extract(table, labeller).collect()
    line = "Word3 word4 word5 word6 <word7> and word8 word9 word10 word11 word12 word13."
    for r in got:
        assert r.n_chars == len(r.text)
        assert r.text == ("\n".join(["Word1 word2"] + [line] * 4) if r.page_id in (1, None) else "")
    assert len(got) == 5 and hb.extract(table.limit(0), labeller).count() == 0 and hb.sample_texts(table.limit(0)) == []
