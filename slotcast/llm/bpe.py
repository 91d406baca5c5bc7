"""Byte-level BPE as a bounded-lookahead streaming transducer, and its decoder.

Encoding. A text is read in slices of `SLICE` characters and cut into pieces (the special token's
string, then the pattern of the vocabulary). A piece's tokens follow from the encodings of its
prefixes: the encoding of a prefix is that of a shorter prefix plus one last token, so each
position has one parent position. The last token of prefix i is the longest vocabulary string
ending at i that may follow the last token of its parent; whether two tokens may be neighbours is
decided by undoing their merges along the seam. Tokens up to a position on which the parents of
all open positions agree can never change: they are emitted and forgotten. Only positions within
the lookahead stay.

Slices end before the last two pieces found in them, whatever the script, so what is held besides the text
is a slice of its pieces. `sufficient_lookahead` computes from the merge list how far that can be at most: a chain of merges
of falling priority, each of whose right part can take in the start of the next, times the
longest token. It is a guard: exceeding it means that the list is no proper merge list.

Pieces up to `KEPT` bytes are kept in a bounded table with their tokens, longer ones (a line of
100,000 letters) go through the transducer byte by byte, in constant memory.

Decoding is a state machine from bytes to characters: tokens give bytes, an incremental UTF-8
decoder emits each character once its last byte is there, and broken bytes become U+FFFD as in the
tokenizers library.

Null and empty texts have no tokens: n_tokens 0 and the hash of the empty string twice. Repeated
rows each give a row, an empty table gives none, other columns are ignored. Documents are only
scanned; nothing is shuffled.
"""

from __future__ import annotations

import array
import codecs
import ctypes
import functools
import gc
import hashlib
import heapq
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the pre-tokenisation pattern of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SLICE = 1 << 16
KEPT = 64
TABLE = 800_000
IDS_TABLE = 100_000
SEAMS = 500_000
ONE = (1,)
#: Characters from which a piece alone in its slice is fed on in parts, and the tokens of a part.
PART = 4096


def byte_letters() -> dict[str, int]:
    """The printable letter of every byte, as vocabulary files write it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Transducer:
    """A merge list with the tables for streaming encoding and decoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        self.ids = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        merges = [tuple(m if isinstance(m, list) else m.split(" ", 1)) for m in spec["model"]["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for r, (a, b) in enumerate(merges):
            left, right = (bytes(letters[c] for c in x) for x in (a, b))
            pair, whole = (self.ids[left], self.ids[right]), self.ids[left + right]
            if pair not in self.rank:
                self.rank[pair] = r
                self.parts.setdefault(whole, pair)
                self.made.setdefault(whole, r)
        self.longest = max(map(len, self.ids))
        # A token that its own merges do not give back never comes out of the merge list.
        self.usable = {t: i for t, i in self.ids.items() if i in self.parts or len(t) == 1}
        ends: dict[bytes, set[int]] = {}
        for t in self.usable:
            if len(t) > 1:
                ends.setdefault(t[-2:], {1}).add(len(t))
        #: lengths of the tokens with these last two bytes, longest first
        self.sizes = {end: tuple(sorted(found, reverse=True)) for end, found in ends.items()}
        self.pattern = regex.compile(PATTERN)
        self.marks = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.table: dict[str, tuple[int, str, bytes]] = {}
        self.ids_table: dict[str, tuple[int, ...]] = {}
        self.seams: dict[tuple[int, int], bool] = {}

    @functools.cached_property
    def lookahead(self) -> int:
        return sufficient_lookahead(self)

    def neighbours(self, left: int, right: int) -> bool:
        """Whether the merge list leaves `left` and `right` side by side in the encoding of their bytes.

        The latest merge on either side of the seam is undone step by step. Where the two parts that
        then meet at the seam would have merged before it, the tokens cannot stand side by side.
        """
        key = (left, right)
        known = self.seams.get(key)
        if known is not None:
            return known
        answer, limit = True, len(self.rank)
        while answer:
            answer = self.rank.get((left, right), limit) >= limit
            made_l, made_r = self.made.get(left, -1), self.made.get(right, -1)
            if made_l > made_r:
                limit, left = made_l, self.parts[left][1]
            elif made_r >= 0:
                # of two merges of one rank the left one comes first: a seam merge of this rank would win
                limit, right = made_r + 1, self.parts[right][0]
            else:
                break
        if len(self.seams) >= SEAMS:
            self.seams.clear()
        self.seams[key] = answer
        return answer

    def stream(self, data: Iterator[int]) -> Iterator[int]:
        """Token ids of one piece, byte by byte, each emitted once no later byte can change it."""
        parent: dict[int, tuple[int, int]] = {}  # position: (parent position, last token)
        base, n, recent = 0, 0, bytearray()
        due = 4 * self.longest
        for byte in data:
            recent.append(byte)
            if len(recent) > self.longest:
                del recent[0]
            n += 1
            for size in self.sizes.get(bytes(recent[-2:]), ONE):
                if size > n - base or size > len(recent):
                    continue
                token = self.usable.get(bytes(recent[len(recent) - size :]))
                if token is None:
                    continue
                at = n - size
                if at == base:
                    before = self._last
                    if base == 0 or before is None or self.neighbours(before, token):
                        parent[n] = (at, token)
                        break
                elif at in parent and self.neighbours(parent[at][1], token):
                    parent[n] = (at, token)
                    break
            if n - base >= due:
                base = yield from self._emit(parent, base, n)
                if n - base > self.lookahead:
                    raise ValueError("the merge list is not proper: its encoding is not stable within the lookahead")
                due = n - base + 2 * self.longest
        out = []
        at = n
        while at > base:
            at, token = parent[at]
            out.append(token)
        yield from reversed(out)

    _last: int | None = None

    def _emit(self, parent: dict[int, tuple[int, int]], base: int, n: int):
        """Emit the tokens on which all positions that may still become parents agree: those up to their nearest common ancestor."""
        open_ = {leaf for leaf in range(max(base + 1, n - self.longest + 1), n + 1) if leaf in parent}
        latest = [-leaf for leaf in open_]
        heapq.heapify(latest)
        while len(open_) > 1:
            at = -heapq.heappop(latest)
            open_.discard(at)
            before = parent[at][0] if at > base else base
            if before not in open_:
                open_.add(before)
                heapq.heappush(latest, -before)
        stop = at = open_.pop() if open_ else base
        tokens = []
        while at > base:
            at, token = parent[at]
            tokens.append(token)
        if tokens:
            self._last = tokens[0]
            yield from reversed(tokens)
        for at in [p for p in parent if p <= stop]:
            del parent[at]
        return stop

    def whole(self, data: bytes) -> list[int]:
        """Token ids of a short piece: the same parents as in `stream`, read off at its end."""
        usable, seams, longest = self.usable.get, self.seams.get, self.longest
        token = usable(data)
        if token is not None:
            return [token]
        back, last = [0], [-1]
        for end in range(1, len(data) + 1):
            for start in range(max(0, end - longest), end):
                token = usable(data[start:end])
                if token is not None:
                    if start == 0:
                        break
                    side = seams((last[start], token))
                    if side or (side is None and self.neighbours(last[start], token)):
                        break
            back.append(start)
            last.append(token)
        out, at = [], len(data)
        while at:
            out.append(last[at])
            at = back[at]
        out.reverse()
        return out

    def piece(self, text: str) -> Iterator[int]:
        data = text.encode()
        if len(data) <= KEPT:
            return iter(self.whole(data))
        self._last = None
        return self.stream(iter(data))

    def entry(self, text: str) -> tuple[int, str, bytes]:
        """Number of tokens, their ids as text, and their bytes."""
        known = self.table.get(text)
        if known is None:
            ids = list(self.piece(text))
            known = (len(ids), ",".join(map(str, ids)), b"".join(self.bytes_of[i] for i in ids))
            if len(text) <= KEPT:
                if len(self.table) >= TABLE:
                    self.table.clear()
                self.table[text] = known
        return known

    def pieces(self, text: str) -> Iterator[tuple[list[str], int | None]]:
        """Pieces of a text in order, in lists; with the id where the only piece is a special token."""
        at = 0
        if self.marks is not None and any(m in text for m in self.special):
            for found in self.marks.finditer(text):
                yield from ((p, None) for p in self._plain(text[at : found.start()]))
                yield [found.group()], self.special[found.group()]
                at = found.end()
        yield from ((p, None) for p in self._plain(text[at:] if at else text))

    def _plain(self, text: str) -> Iterator[list[str]]:
        """Pattern pieces, a slice of the text at a time.

        The pattern covers every character and looks one character ahead, so more text can only change the last
        two pieces of a slice (an apostrophe and a letter may become one): the next slice starts before them.
        """
        at, size = 0, len(text)
        while size - at > SLICE:
            stop = at + SLICE
            found = self.pattern.findall(text, at, stop)
            if len(found) > 2:
                at = stop - len(found.pop()) - len(found.pop())
            else:
                found = [self.pattern.match(text, at).group()]
                at += len(found[0])
            yield found
        if at < size:
            yield self.pattern.findall(text, at)

    def encode(self, text: str) -> list[int]:
        """Token ids of a text, short pieces by way of a bounded table."""
        out: list[int] = []
        known = self.ids_table
        for pieces, special in self.pieces(text):
            if special is not None:
                out.append(special)
                continue
            for piece in pieces:
                ids = known.get(piece)
                if ids is None:
                    ids = tuple(self.piece(piece))
                    if len(piece) <= KEPT:
                        if len(known) >= IDS_TABLE:
                            known.clear()
                        known[piece] = ids
                out += ids
        return out

    def ids_of(self, text: str) -> Iterator[int]:
        for pieces, special in self.pieces(text):
            if special is not None:
                yield special
            else:
                for piece in pieces:
                    yield from self.piece(piece)

    def decode(self, ids: Iterator[int]) -> Iterator[str]:
        """Characters as soon as their bytes are complete."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield decoder.decode(self.bytes_of[i])
        yield decoder.decode(b"", final=True)

    def entries(self, pieces: list[str]) -> Iterator[list[tuple[int, str, bytes]]]:
        """Entries of pieces; a piece that fills a slice alone comes in parts."""
        known, entry = self.table.get, self.entry
        if len(pieces) == 1 and len(pieces[0]) > PART:
            for ids in itertools.batched(self.piece(pieces[0]), PART):
                yield [(len(ids), ",".join(map(str, ids)), b"".join(self.bytes_of[i] for i in ids))]
        else:
            yield [known(p) or entry(p) for p in pieces]

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, hash of the ids, hash of the decoded text; both hashes are fed slice by slice."""
        n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for pieces, special in self.pieces(text):
            parts = self.entries(pieces) if special is None else [[(1, str(special), self.bytes_of[special])]]
            for entries in parts:
                ids_hash.update((("," if n else "") + ",".join([e[1] for e in entries])).encode())
                text_hash.update(decoder.decode(b"".join([e[2] for e in entries])).encode())
                n += sum([e[0] for e in entries])
        text_hash.update(decoder.decode(b"", final=True).encode())
        return n, ids_hash.hexdigest(), text_hash.hexdigest()


def sufficient_lookahead(t: Transducer) -> int:
    """Bytes beyond a boundary after which it is settled.

    A merge at the left of a boundary can be undone by a later byte only through a chain of
    merges of falling priority, each meeting the next at its right part's first byte. The longest
    such chain over the list, by first byte of the right part and last byte of the left part,
    bounds the number of tokens to look at; each is at most the longest token.
    """
    # longest chain ending at a merge, kept per byte on which the next merge must meet it
    best = np.zeros(256, dtype=np.int64)
    for (left, right), _ in sorted(t.rank.items(), key=lambda x: -x[1]):
        first, last = t.bytes_of[left][0], t.bytes_of[right][0]
        best[first] = max(best[first], best[last] + 1)
    return int(best.max()) * t.longest


@functools.lru_cache(maxsize=2)
def load(path: str) -> Transducer:
    """The tables of a vocabulary file, once per Python worker."""
    return Transducer(path)


def digests(docs: DataFrame, vocabulary: str, *, doc_id="doc_id", text="text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256. `vocabulary` is a path that executors can read."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        t = load(vocabulary)
        for batch in batches:
            rows = [t.digest(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.string()),
                    pa.array([r[2] for r in rows], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def hand_back() -> None:
    """Give freed memory back to the system; a worker's allocators keep it for its next tasks, which may never need as much."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # a C library without it


def id_lists(t: Transducer, column: pa.Array) -> pa.Array:
    """Token ids of every text; they are held once, at four bytes each."""
    ids, ends = array.array("i"), [0]
    for x in column:
        ids.extend(t.encode(x.as_py() or ""))
        ends.append(len(ids))
    values = pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(ids)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def encoder(vocabulary: str):
    """Columns of texts to columns of token ids."""

    def encode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for column in columns:
                yield id_lists(load(vocabulary), column)
        finally:
            # the worker goes on to other stages, without these tables and their memory
            load.cache_clear()
            hand_back()

    return encode


def tokenize(docs: DataFrame, vocabulary: str, *, text="text", ids="token_ids") -> DataFrame:
    """`docs` with an array of token ids in place of a column of that name or as a new one."""
    return docs.withColumn(ids, F.arrow_udf(encoder(vocabulary), "array<int>")(F.col(text)))
