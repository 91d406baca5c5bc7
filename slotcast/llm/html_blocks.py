"""Main text of web pages by a recurrent block labeller.

Parsing. A forgiving tag scanner turns a page into leaf blocks in page order: runs of text between
block-level tags, each with its tag path (names, with class and id words). Comments, scripts, styles
and other tags without visible text are skipped. Character references are decoded and white space
inside a block becomes one space.

Labelling. Each leaf is a vector: hashed tags of its path, hashed words, and a few shapes (length,
share of linked text, share of capitals and signs, place). A numpy bidirectional LSTM reads the
whole sequence of a page, so a leaf's label depends on all leaves before and after it. Leaves with a
content probability of one half or more are the main text, joined by newlines.

Training. The labeller is trained here, on pages composed by `compose` from text of the table's own
pages (at most `SAMPLE` pages): articles in several layouts with menus, headers, sidebars, notices,
adverts, forms, footers and comments around them, whose labels are known as they are put in. Class names
and semantic tags are left out or replaced at random, so the labeller uses words, shapes and order
besides names. The fit is deterministic and its size fixed.

Null and empty pages, and pages without visible text, give an empty text. Long pages are labelled in
whole; memory follows the page. Repeated pages each give a row, an empty table gives none. Other columns are
ignored.
"""

from __future__ import annotations

import bisect
import functools
import html
import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's own element classes.
SKIPPED = frozenset("script style noscript template annotation iframe object canvas audio video head select option textarea button".split())
RAW = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle semantics svg g text tspan"
    " a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup"
    " time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)

TAG_PLACES, WORD_PLACES, SHAPES = 192, 192, 12
HIDDEN = 24
SAMPLE = 200
PAGES, EPOCHS = 800, 12
#: Leaves that go through the network at once, and pages whose leaves are held at once.
TOGETHER, SLICE = 4096, 256

# a tag up to its `>` without a `<` on the way, so that all attempts together read a page once
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^<>\"']|\"[^\"<>]*\"|'[^'<>]*')*)>")
_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>\"'<]*)")
_SIGN = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


@functools.lru_cache(maxsize=1 << 17)
def _place(word: str, places: int) -> int:
    return zlib.crc32(word.encode()) % places


class Node:
    """An open tag with its class, id and role words; it shares the tags around it, so a path costs one node a tag."""

    __slots__ = ("above", "name", "words", "mask")

    def __init__(self, above: Node | None, name: str, words: tuple[str, ...]):
        self.above, self.name, self.words = above, name, words
        self.mask = above.mask if above else 0  # hashed places of the whole path
        for word in (name, *words):
            self.mask |= 1 << _place(word, TAG_PLACES)


@dataclass
class Leaf:
    node: Node | None
    text: str
    linked: int  # characters inside links

    @property
    def path(self) -> tuple[str, ...]:
        """Tag names and their class, id and role words, from the root."""
        tags, at = [], self.node
        while at:
            tags.append((at.name, *at.words))
            at = at.above
        return tuple(w for tag in reversed(tags) for w in tag)


_P_STOPS = ("div", "article", "section", "main", "td", "body")
_LI_STOPS = ("ul", "ol", "menu")


@dataclass
class _Scan:
    stack: list[Node] = field(default_factory=list)
    depths: dict[str, list[int]] = field(default_factory=dict)  # places in the stack by name
    blocks: list[int] = field(default_factory=list)  # places of tags that are not inline
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    leaves: list[Leaf] = field(default_factory=list)
    node: Node | None = None

    def flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                self.leaves.append(Leaf(self.node, text, min(self.linked, len(text))))
            self.parts, self.linked = [], 0

    def depth(self, name: str) -> int:
        found = self.depths.get(name)
        return found[-1] if found else -1

    def open(self, name: str, words: tuple[str, ...]) -> None:
        inline = name in INLINE
        if not inline:
            self.flush()
            if name in CLOSES_P and self.depth("p") > max(map(self.depth, _P_STOPS)):
                self._cut(self.depth("p"))
            if name == "li" and self.depth("li") > max(map(self.depth, _LI_STOPS)):
                self._cut(self.depth("li"))
        if name not in VOID:
            self.depths.setdefault(name, []).append(len(self.stack))
            if not inline:
                self.blocks.append(len(self.stack))
            self.stack.append(Node(self.stack[-1] if self.stack else None, name, words))

    def close(self, name: str) -> None:
        depth, inline = self.depth(name), name in INLINE
        if not inline:
            self.flush()
        # an inline end tag does not reach out of its block
        if depth >= 0 and not (inline and self.blocks and self.blocks[-1] > depth):
            self._cut(depth)

    def _cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.depths[self.stack.pop().name].pop()
        while self.blocks and self.blocks[-1] >= depth:
            self.blocks.pop()

    def add(self, text: str) -> None:
        if not self.parts:
            self.node = self.stack[-1] if self.stack else None
        self.parts.append(text)
        if self.depths.get("a"):
            self.linked += len(" ".join(text.split()))


class _Tags:
    """Ends of tags whose attributes hold `<` or odd quotes. Signs met on a way that found no end are known to lead nowhere."""

    def __init__(self, page: str):
        self.page, self.signs, self.lost = page, None, set()

    def end(self, at: int) -> int:
        """Place of the `>` that ends attributes starting at `at`, outside quotes; -1 without one."""
        if self.signs is None:
            self.signs = [m.start() for m in _SIGN.finditer(self.page)]
            nearest, self.partner = {}, [-1] * len(self.signs)
            for i in range(len(self.signs) - 1, -1, -1):
                sign = self.page[self.signs[i]]
                self.partner[i] = nearest.get(sign, -1)
                nearest[sign] = i
        i, way = bisect.bisect_left(self.signs, at), []
        while 0 <= i < len(self.signs) and i not in self.lost:
            if self.page[self.signs[i]] == ">":
                return self.signs[i]
            way.append(i)
            i = self.partner[i] + 1 or -1
        self.lost.update(way)
        return -1


def leaves(page: str) -> list[Leaf]:
    """Leaf blocks of a page in order. One cursor goes through the page; work and memory are linear in its length."""
    scan, tags, at, n = _Scan(), _Tags(page), 0, len(page)
    last_end, unclosed = page.rfind(">"), set()
    text_from = 0
    while True:
        start = page.find("<", at)
        if start < 0:
            break
        found = _TAG.match(page, start)
        if found:
            closing, name, rest = found.groups()
            at = found.end()
        elif page.startswith("<!--", start):
            closing, name, rest = "", "", ""
            at = page.find("-->", start + 4) + 3
            at = at if at > 2 else n
        else:
            head = _NAME.match(page, start)
            other = page.startswith(("<!", "<?"), start)
            end = -1 if start > last_end else tags.end(head.end()) if head else page.find(">", start) if other else -1
            if end < 0:
                at = start + 1  # a sign of the text
                continue
            closing, name, rest = (head.group(1), head.group(2), page[head.end() : end]) if head else ("", "", "")
            at = end + 1
        if start > text_from:
            scan.add(page[text_from:start])
        text_from = at
        name = name.lower()
        if not name:
            continue
        if closing:
            scan.close(name)
            continue
        alone = rest.rstrip().endswith("/")
        if name in SKIPPED or name in RAW:
            if not alone:
                stop = None if name in unclosed else _end_tag(name).search(page, at)
                if stop is None:
                    unclosed.add(name)
                at = text_from = stop.end() if stop else (n if name in RAW else at)
            continue
        words: list[str] = []
        for a in _ATTRIBUTE.finditer(rest) if rest else ():
            value = a.group(2) or a.group(3) or a.group(4) or ""
            words += [f"{a.group(1).lower()}:{w}" for w in _WORD.findall(value.lower())]
        scan.open(name, tuple(words))
        if alone and name not in VOID:
            scan.close(name)
    if n > text_from:
        scan.add(page[text_from:])
    scan.flush()
    return scan.leaves


@functools.lru_cache(maxsize=64)
def _end_tag(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\s*>", re.I)


#: Kinds of bytes: 1 capital, 2 digit, 3 sign, 4 blank, 0 other.
_KINDS = np.zeros(256, dtype=np.uint8)
_KINDS[65:91] = 1
_KINDS[48:58] = 2
_KINDS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 3
_KINDS[32] = 4


def vectors(page: list[Leaf]) -> np.ndarray:
    """One row per leaf: tag path, words, shapes."""
    n = len(page)
    out = np.zeros((n, TAG_PLACES + WORD_PLACES + SHAPES), dtype=np.float32)
    masks = b"".join([(leaf.node.mask if leaf.node else 0).to_bytes(TAG_PLACES // 8, "little") for leaf in page])
    out[:, :TAG_PLACES] = np.unpackbits(np.frombuffer(masks, np.uint8), bitorder="little").reshape(n, TAG_PLACES)
    for i, leaf in enumerate(page):
        row = out[i]
        words = _WORD.findall(leaf.text.lower())
        row[[TAG_PLACES + _place(word, WORD_PLACES) for word in set(words)]] = 1 / (1 + len(words)) ** 0.5
        size = len(leaf.text)
        kinds = np.bincount(_KINDS[np.frombuffer(leaf.text.encode(), dtype=np.uint8)], minlength=5)
        row[TAG_PLACES + WORD_PLACES :] = (
            min(1.0, math.log1p(size) / 8),
            leaf.linked / size,
            kinds[1] / size,
            kinds[3] / size,
            kinds[2] / size,
            min(1.0, kinds[4] / 60),
            float(leaf.text[-1] in ".!?"),
            i / n,
            (n - 1 - i) / n,
            float(size > 80),
            float("©" in leaf.text or "·" in leaf.text),
            min(1.0, n / 60),
        )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with a logistic output per leaf, in numpy."""

    def __init__(self, width: int = TAG_PLACES + WORD_PLACES + SHAPES, hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for side in ("f", "b"):
            self.p["wx" + side] = rng.normal(0, 0.1, (width, 4 * hidden))
            self.p["wh" + side] = rng.normal(0, hidden**-0.5 / 2, (hidden, 4 * hidden))
            bias = np.zeros(4 * hidden)
            bias[hidden : 2 * hidden] = 1  # forget gate open at first
            self.p["c" + side] = bias
        self.p["out"] = rng.normal(0, 0.1, 2 * hidden)
        self.p["bias"] = np.zeros(1)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, x: np.ndarray, side: str) -> tuple[np.ndarray, list]:
        """Hidden states (time, batch, hidden) of sequences x (time, batch, width)."""
        h_size = self.hidden
        inner = x @ self.p["wx" + side] + self.p["c" + side]
        h = np.zeros((x.shape[1], h_size), dtype=np.float32)
        c = np.zeros_like(h)
        states, kept = np.zeros((*x.shape[:2], h_size), dtype=np.float32), []
        for t in range(x.shape[0]) if side == "f" else range(x.shape[0] - 1, -1, -1):
            z = inner[t] + h @ self.p["wh" + side]
            i, f, o = (_sigmoid(z[:, k * h_size : (k + 1) * h_size]) for k in range(3))
            g = np.tanh(z[:, 3 * h_size :])
            before = (h, c)
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            states[t] = h
            kept.append((t, i, f, o, g, tc, *before))
        return states, kept

    def logits(self, x: np.ndarray) -> np.ndarray:
        forward, backward = self._run(x, "f")[0], self._run(x, "b")[0]
        return np.concatenate((forward, backward), axis=2) @ self.p["out"] + self.p["bias"]

    def probabilities(self, page: list[Leaf]) -> np.ndarray:
        return next(self.of_pages([page]))

    def of_pages(self, pages: list[list[Leaf]]):
        """Content probabilities of every leaf of every page. Pages of equal length go through together."""
        by_length: dict[int, list[int]] = {}
        for i, page in enumerate(pages):
            by_length.setdefault(len(page), []).append(i)
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        for length, members in by_length.items():
            step = max(1, TOGETHER // max(1, length))
            for at in range(0, len(members) if length else 0, step):
                part = members[at : at + step]
                found = _sigmoid(self.logits(np.stack([vectors(pages[i]) for i in part], axis=1)))
                for j, i in enumerate(part):
                    out[i] = found[:, j]
        yield from out

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over the unmasked leaves. y, mask: (time, batch)."""
        runs = {side: self._run(x, side) for side in ("f", "b")}
        both = np.concatenate((runs["f"][0], runs["b"][0]), axis=2)
        d = (_sigmoid(both @ self.p["out"] + self.p["bias"]) - y) * mask / max(mask.sum(), 1)
        grad = {"out": np.einsum("tb,tbh->h", d, both), "bias": d.sum(keepdims=True).reshape(1)}
        d_both = d[:, :, None] * self.p["out"]
        hs = self.hidden
        for n, side in enumerate(("f", "b")):
            d_states = d_both[:, :, n * hs : (n + 1) * hs]
            dh = np.zeros(x.shape[1:2] + (hs,), dtype=np.float32)
            dc = np.zeros_like(dh)
            dz_all = np.zeros((*x.shape[:2], 4 * hs), dtype=np.float32)
            d_wh = np.zeros_like(self.p["wh" + side])
            for t, i, f, o, g, tc, h0, c0 in reversed(runs[side][1]):
                dh = dh + d_states[t]
                dc = dc + dh * o * (1 - tc**2)
                dz = np.concatenate((dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)), axis=1)
                dz_all[t] = dz
                d_wh += h0.T @ dz
                dh = dz @ self.p["wh" + side].T
                dc = dc * f
            grad["wx" + side] = np.tensordot(x, dz_all, axes=((0, 1), (0, 1)))
            grad["wh" + side] = d_wh
            grad["c" + side] = dz_all.sum(axis=(0, 1))
        return grad


def train(pages: list[tuple[list[Leaf], np.ndarray]], *, epochs: int = EPOCHS, rate: float = 6e-3, batch: int = 8, seed: int = 11) -> Labeller:
    """Adam over batches of pages of similar length, with steps that shrink to nothing."""
    model, rng = Labeller(), np.random.default_rng(seed)
    pages = sorted(((vectors(p), y) for p, y in pages if p), key=lambda p: len(p[1]))
    blocks = [pages[i : i + batch] for i in range(0, len(pages), batch)]
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for _ in range(epochs):
        for b in rng.permutation(len(blocks)):
            longest = max(len(y) for _, y in blocks[b])
            x = np.zeros((longest, len(blocks[b]), TAG_PLACES + WORD_PLACES + SHAPES), dtype=np.float32)
            y = np.zeros((longest, len(blocks[b])), dtype=np.float32)
            mask = np.zeros_like(y)
            for j, (v, labels) in enumerate(blocks[b]):
                x[: len(labels), j], y[: len(labels), j], mask[: len(labels), j] = v, labels, 1
            step += 1
            for k, g in model.gradients(x, y, mask).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g**2
                model.p[k] -= rate * (1 - step / (epochs * len(blocks) + 1)) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
    return model


# Words with which sites name the parts of a page.
_PARTS = {
    "nav": "nav menu navbar navigation breadcrumb topbar",
    "header": "header masthead banner site-header logo",
    "aside": "sidebar aside related widget trending",
    "notice": "cookie notice consent alert gdpr popup",
    "ad": "ad ads advert sponsored promo banner-ad",
    "form": "form newsletter subscribe search login signup",
    "comments": "comments comment-list responses discussion disqus reply",
    "footer": "footer site-footer copyright bottom colophon",
    "body": "article content post entry main-text story post-body",
}
_LAYOUT = "container wrapper row col grid flex inner outer page layout block box p-4 mx-auto w-full md:flex".split()
_SAYINGS = {
    "nav": "Home|About us|Contact|News|Products|Blog|Archive|Login|Next page|Previous",
    "header": "The Daily Site|Welcome|Search this site|Your trusted source",
    "aside": "Related articles|Most read|You may also like|Popular tags|Follow us",
    "notice": "We use cookies to improve your experience.|Accept all|This site uses cookies. Read our privacy policy.|Please enable JavaScript.",
    "ad": "Sponsored|Advertisement|Buy now and save 50%|Limited offer: order today!|Click here",
    "form": "Subscribe to our newsletter|Your e-mail|Sign up|Search|Send|Name|Password",
    "comments": "Great post, thanks!|Reply|Posted by anna 3 days ago|I disagree with this.|Log in to comment|2 comments",
    "footer": "© 2024 Example Ltd. All rights reserved.|Privacy|Terms of use|Imprint|Back to top|Contact",
}


def compose(texts: list[str], rng: np.random.Generator) -> tuple[str, str]:
    """A made page around paragraphs of `texts`, and its main text. Content is marked by a private character while composing."""

    def sentence() -> str:
        words = texts[rng.integers(len(texts))].split()
        start = rng.integers(max(1, len(words) - 12))
        return " ".join(words[start : start + rng.integers(3, 14)])

    def some(kind: str) -> str:
        if rng.random() < 0.5:
            sayings = _SAYINGS[kind].split("|")
            return sayings[rng.integers(len(sayings))]
        return html.escape(sentence())

    def named(kind: str) -> str:
        if rng.random() < 0.25:
            return ""
        words = _PARTS[kind].split()
        return f' {"id" if rng.random() < 0.3 else "class"}="{words[rng.integers(len(words))]}"'

    def site() -> str:
        word = "".join(c for c in sentence().split()[0].lower() if c.isalpha()) or "site"
        return f"{word}.example.{('com', 'net', 'org')[rng.integers(3)]}"

    def link(kind: str) -> str:
        return f'<a href="/{rng.integers(99)}">{some(kind)}</a>'

    def tag(kind: str, own: str, p: float = 0.6) -> tuple[str, str]:
        name = own if rng.random() < p else "div"
        return f"<{name}{named(kind)}>", f"</{name}>"

    def listing(kind: str, most: int = 9) -> str:
        return "<ul>" + "".join(f"<li>{link(kind)}</li>" for _ in range(rng.integers(2, most))) + "</ul>"

    def part(kind: str) -> str:
        start, end = tag(kind, {"nav": "nav", "header": "header", "aside": "aside", "form": "form", "comments": "section", "footer": "footer"}.get(kind, "div"))
        inner = {
            "nav": lambda: listing("nav"),
            "header": lambda: f"<div>{some('header')}</div>" + (f"<p>{some('header')}</p>" if rng.random() < 0.5 else ""),
            "aside": lambda: f"<h3>{some('aside')}</h3>" + listing("aside", 6) + (f"<p>{html.escape(sentence())}</p>" if rng.random() < 0.5 else ""),
            "notice": lambda: f"<p>{some('notice')}</p>",
            "ad": lambda: some("ad") if rng.random() < 0.6 else f"<p>{html.escape(sentence())} {html.escape(sentence())}.</p>",
            "form": lambda: f"<label>{some('form')}</label><input name=q><p>{some('form')}</p>",
            "comments": lambda: f"<h3>{some('comments')}</h3>" + "".join(f"<div><p>{html.escape(sentence())} {some('comments')}</p></div>" for _ in range(rng.integers(1, 5))),
            "footer": lambda: f"&copy; {site()} &middot; {html.escape(sentence())}." if rng.random() < 0.6 else f"<p>{some('footer')}</p>" + listing("footer", 4),
        }[kind]()
        return start + inner + end

    def words(most: int) -> str:
        return " ".join(sentence().split()[: rng.integers(1, most)]) or "-"

    def data() -> tuple[str, list[str]]:
        """A table, a list, terms or code within the article, and its lines."""
        kind, lines = rng.integers(5), []

        def line(text: str) -> str:
            lines.append(text)
            return MARK + html.escape(text)

        def cell() -> str:
            return line(words(5) if rng.random() < 0.5 else f"{rng.integers(10000) / 10 ** rng.integers(4):g}")

        if kind < 2:
            width = rng.integers(2, 5)
            rows = ["".join(f"<{tag}>{cell()}</{tag}>" for _ in range(width)) for tag in ["th", *["td"] * rng.integers(2, 10)]]
            return f"<table{named('body')}>" + "".join(f"<tr>{r}</tr>" for r in rows) + "</table>", lines
        if kind == 2:
            name = ("ul", "ol")[rng.integers(2)]
            return f"<{name}>" + "".join(f"<li>{line(words(12))}</li>" for _ in range(rng.integers(2, 9))) + f"</{name}>", lines
        if kind == 3:
            return "<dl>" + "".join(f"<dt>{line(words(4))}</dt><dd>{line(words(12))}</dd>" for _ in range(rng.integers(2, 6))) + "</dl>", lines
        code = "; ".join(f"{words(3)}({rng.integers(99)}) = {words(3)}" for _ in range(rng.integers(1, 6)))
        return f"<pre><code>{line(' '.join(code.split()))}</code></pre>", lines

    def wrapped(inner: str) -> str:
        """Page-wide containers with classes that say nothing of the content."""
        for _ in range(rng.integers(0, 5) if rng.random() < 0.4 else 0):
            made = ("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 8))) for _ in range(rng.integers(0, 7)))
            classes = " ".join([_LAYOUT[c] for c in rng.integers(0, len(_LAYOUT), rng.integers(1, 4))] + list(made))
            inner = f'<div class="{classes}">{inner}</div>'
        return inner

    main, body = [], []
    paragraphs = [p for p in texts[rng.integers(len(texts))].split("\n") if p.strip()]
    if rng.random() < 0.4:
        paragraphs = paragraphs[: rng.integers(1, 4)]
    for _ in range(rng.integers(0, 4)):  # articles also hold odd lines
        odd = (
            " ".join(sentence().split()[: rng.integers(1, 4)]),
            " ".join([sentence().split()[0]] * int(rng.integers(3, 40))),
            " | ".join(sentence().split()) + " |",
            some(("footer", "notice", "ad")[rng.integers(3)]),
        )[rng.integers(4)]
        paragraphs.insert(int(rng.integers(0, len(paragraphs) + 1)), html.unescape(odd) or "-")
    for i, text in enumerate(paragraphs):
        clean = " ".join(text.split())
        main.append(clean)
        marked = MARK + html.escape(clean)
        kind = rng.random()
        if i == 0 and rng.random() < 0.8:
            head = clean[: 60 + rng.integers(60)].strip()
            body.append(f"<h1>{MARK}{html.escape(head)}</h1>")
            main.insert(0, head)
        if kind < 0.12:
            body.append(f"<p><b>{marked}<br>")
        elif kind < 0.2:
            body.append(f"<h2>{marked}</h2>")
        elif kind < 0.27:
            body.append(f"<ul><li>{marked}</li></ul>")
        elif kind < 0.33:
            body.append(f"<blockquote>{marked}</blockquote>")
        elif kind < 0.4:
            body.append(f"<div>{marked}</div>")
        else:
            body.append(f"<p>{marked}</p>")
        if rng.random() < 0.04:
            body.append(part("ad"))
        if rng.random() < 0.05:
            made, lines = data()
            body.append(made)
            main += lines
    start, end = tag("body", "article" if rng.random() < 0.7 else "main", 0.65) if rng.random() < 0.96 else ("", "")
    pick = lambda kind, p: part(kind) if rng.random() < p else ""
    before = [pick("notice", 0.3), pick("header", 0.4), pick("nav", 0.8), pick("ad", 0.5), pick("aside", 0.2), pick("form", 0.15)]
    after = [pick("comments", 0.35), pick("aside", 0.3), pick("form", 0.25), pick("ad", 0.25), pick("nav", 0.15), pick("footer", 0.85), pick("notice", 0.1)]
    page = f"<html><head><title>{html.escape(sentence())}</title></head><body>" + wrapped("".join(before) + wrapped(start + "".join(body) + end) + "".join(after)) + "</body></html>"
    return page, "\n".join(main)


MARK = "\ue000"


def composed(texts: list[str], pages: int = PAGES, seed: int = 3) -> list[tuple[list[Leaf], np.ndarray]]:
    """Training pages: leaves without marks, and 1 for those that were marked as content."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(pages if texts else 0):
        found = leaves(compose(texts, rng)[0])
        labels = np.array([MARK in leaf.text for leaf in found], dtype=np.float32)
        for leaf in found:
            leaf.text = leaf.text.replace(MARK, "").strip() or "-"
        out.append((found, labels))
    return out


def prose(page: str) -> list[str]:
    """Blocks of a page to compose from: at most 40, unlinked, of more than 20 and at most 2,000 characters, without footer signs."""
    return [leaf.text[:2000] for leaf in leaves(page) if len(leaf.text) > 20 and not leaf.linked and not set("©·") & set(leaf.text)][:40]


def sample_texts(pages: DataFrame, *, html_column="html", sample=SAMPLE) -> list[str]:
    """`prose` of at most `sample` pages, those whose html hashes lowest."""

    def run(batches):
        for batch in batches:
            texts = []
            for page in batch.column(0):
                texts.append("\n".join(prose(page.as_py() or "")))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])

    chosen = pages.select(F.col(html_column).alias("html")).where("length(html) > 0").distinct()
    low = pages.select(F.xxhash64(html_column).alias("h")).distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if low is None:
        return []
    return sorted(r.text for r in chosen.where(F.xxhash64("html") <= low).mapInArrow(run, "text string").collect() if r.text)


def fit(pages: DataFrame, *, html_column="html", sample=SAMPLE) -> Labeller:
    return train(composed(sample_texts(pages, html_column=html_column, sample=sample)))


def main_texts(pages: list[str | None], model: Labeller) -> list[str]:
    found = [leaves(page or "") for page in pages]
    return [
        "\n".join(leaf.text for leaf, p in zip(page, probabilities.tolist(), strict=True) if p >= 0.5)
        for page, probabilities in zip(found, model.of_pages(found), strict=True)
    ]


def main_text(page: str | None, model: Labeller) -> str:
    return main_texts([page], model)[0]


def extract(pages: DataFrame, model: Labeller, *, page_id="page_id", url="url", html_column="html") -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    weights = model.p
    kinds = [pages.schema[c].dataType.simpleString() for c in (page_id, url)]

    def run(batches):
        labeller = _from_weights(weights)
        for batch in batches:
            texts: list[str] = []
            for at in range(0, batch.num_rows, SLICE):
                texts += main_texts(batch.column(2).slice(at, SLICE).to_pylist(), labeller)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html_column).alias("html"))
    return rows.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")


def _from_weights(weights: dict[str, np.ndarray]) -> Labeller:
    model = Labeller()
    model.p = weights
    return model



