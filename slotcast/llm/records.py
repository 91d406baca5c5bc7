"""Token ids as length-delimited binary records, with an offset index per file for shuffled reads.

A file is a sequence of frames: length of the record (64-bit little-endian), masked CRC-32C of those
eight bytes, the record, masked CRC-32C of the record. Readers of that common record format can read
it. A record is a serialized sequence: document id (64-bit), number of ids (32-bit), bytes per id (2
where the vocabulary has at most 65,536 entries, else 4), whether there is a document id, two zero bytes, and the
ids, little-endian. Beside `x.records` stands `x.index`: offset and length (64-bit each) of every
record, so that record k of a file is found by two range reads, in any order.

Writing. Rows are dealt by ranges of (doc_id, hash of the text) and sorted inside a range, so files in
order of (part, seq) hold the documents in ascending order of doc_id. A task encodes, frames and
writes a few MB at a time and begins a new file after `FILE_BYTES`. File names are those of a task's
attempt; the manifest, written as a table, names the files that count, so what a lost executor
leaves behind is never read. The ids before a file follow from the manifest in two levels of sums.

Encoding is the tokenizers library's. The vocabulary's pattern never crosses white space, and neither does its
normalisation, so a text is cut at spaces and line feeds, and each distinct piece is kept in a bounded table. A new
piece is cut into runs of letters, digits and runs of signs, as the pattern does; the library encodes
those that are new too, words many at a time. Memory follows `SLICE` characters or the longest run without a blank.

Null ids come first, rows of one id by the hash of their text; a null or empty text is the end id
alone. Repeated rows each have a record. An empty table makes no files and no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotcast.llm.wacz import filesystem
from slotcast.sources.shared import drop_tables, new_path, settle

FILE_BYTES = 64 << 20
FLUSH = 2 << 20
SLICE = 1 << 18
KEPT = 64
TABLE = 800_000
HEAD = struct.Struct("<qIBBxx")
ENTRY = np.dtype([("offset", "<u8"), ("length", "<u8")])
MANIFEST = "part int, seq int, path string, n_records long, n_tokens long, bytes long"
FILES_PER_SUM = 1024

# Letters and digits up to U+00FF, as the vocabulary's pattern classes them.
_PARTS = re.compile("[A-Za-zªµºÀ-ÖØ-öø-ÿ]+|[0-9²³¹¼½¾]|[^A-Za-zªµºÀ-ÖØ-öø-ÿ0-9²³¹¼½¾]+")

# The reflected polynomial of CRC-32C and the constant of the mask.
POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """CRC of eight bytes from its four 16-bit parts, and the effect of 8, 16, ... 512 zero bytes on a CRC."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(POLYNOMIAL), byte >> 1).astype(np.uint32)

    def zeros(x: np.ndarray, n: int) -> np.ndarray:
        for _ in range(n):
            x = byte[x & 255] ^ (x >> 8)
        return x

    pair = np.arange(1 << 16, dtype=np.uint32)
    word = np.stack([zeros(pair, 8 - 2 * k) for k in range(4)])
    shifts = [(zeros(pair, 8), zeros(pair << 16, 8))]
    for _ in range(6):
        low, high = shifts[-1]
        shifts.append(tuple(low[t & 0xFFFF] ^ high[t >> 16] for t in (low, high)))
    return word, shifts


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of every byte string of four bytes or more, all in step.

    Zero bytes in front leave a register of zero as it is, so strings are aligned at their ends to blocks of 512
    bytes; words, then halves of a block, then blocks are joined by the effect of the bytes that follow.
    """
    word, shifts = _tables()
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    if len(parts) and sizes.min() < 4:
        raise ValueError("shorter than the register")
    blocks = -(-sizes // 512)
    ends = np.cumsum(blocks) * 512
    data = np.zeros(int(ends[-1]) if len(parts) else 0, dtype=np.uint8)
    for part, end, size in zip(parts, ends.tolist(), sizes.tolist(), strict=True):
        data[end - size : end] = np.frombuffer(part, np.uint8)
    for k in range(4):
        data[ends - sizes + k] ^= 0xFF
    lanes = data.view("<u2").reshape(-1, 4)
    crc = word[0][lanes[:, 0]]
    for k in range(1, 4):
        crc = crc ^ word[k][lanes[:, k]]
    for low, high in shifts[:6]:
        left = crc[0::2]
        crc = low[left & 0xFFFF] ^ high[left >> 16] ^ crc[1::2]
    low, high = shifts[6]
    firsts = ends // 512 - blocks
    out = np.zeros(len(parts), dtype=np.uint32)
    order = np.argsort(-blocks, kind="stable")
    falling = blocks[order]
    for k in range(int(falling[0]) if len(parts) else 0):
        now = order[: int(np.searchsorted(-falling, -k, side="left"))]
        old = out[now]
        out[now] = low[old & 0xFFFF] ^ high[old >> 16] ^ crc[firsts[now] + k]
    return out ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


def frames(records: list[bytes]) -> Iterator[bytes]:
    """Every record with its length and both checksums."""
    lengths = [struct.pack("<Q", len(r)) for r in records]
    of_length, of_data = masked(crc32c(lengths)).tolist(), masked(crc32c(records)).tolist()
    for length, a, record, b in zip(lengths, of_length, records, of_data, strict=True):
        yield b"".join((length, struct.pack("<I", a), record, struct.pack("<I", b)))


def unframe(found: list[bytes]) -> list[bytes]:
    """The records of whole frames; ValueError where a length or a checksum does not fit."""
    records = [f[12:-4] for f in found]
    of_length, of_data = masked(crc32c([f[:8] for f in found])).tolist(), masked(crc32c(records)).tolist()
    for f, a, record, b in zip(found, of_length, records, of_data, strict=True):
        if struct.unpack_from("<QI", f) != (len(record), a) or struct.unpack_from("<I", f, len(f) - 4)[0] != b:
            raise ValueError("a record does not match its checksum")
    return records


class _Known(dict):
    """Ids by piece, those of a full earlier table while they are asked for; `new` collects pieces looked up in vain."""

    def __init__(self, earlier: dict[str, bytes]):
        super().__init__({"": b""})
        self.earlier, self.new = earlier, set()

    def __missing__(self, piece: str) -> bytes | None:
        ids = self.earlier.get(piece)
        if ids is None:
            self.new.add(piece)
        else:
            self[piece] = ids
        return ids


class Encoder:
    """Ids of whole texts by the tokenizers library, each distinct piece between blanks once."""

    def __init__(self, path: str):
        # Spark runs a worker per core, threads of the library's own would compete with them
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.kind = np.dtype("<u2" if self.library.get_vocab_size(True) <= 1 << 16 else "<u4")
        self.known = _Known({})
        self.ending = np.zeros(self.library.get_vocab_size(True), dtype=bool)
        self.ending[[i for t, i in self.library.get_vocab(False).items() if t.endswith("</w>")]] = True
        if self._library_ids(["a a", "A1,", "a", "1", ","])[:2] != [b"".join(self._library_ids(x)) for x in (["a", "a"], ["a", "1", ","])]:
            raise ValueError("the vocabulary does not fold case or joins what stands apart here")

    def _library_ids(self, pieces: list[str]) -> list[bytes]:
        return [np.array(f.ids, self.kind).tobytes() for f in self.library.encode_batch_fast(pieces, add_special_tokens=False)]

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only, encoded as one text and cut after each token that ends a word."""
        ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.kind)
        ends = np.flatnonzero(self.ending[ids]) + 1
        if len(ends) != len(words):
            return self._library_ids(words)
        data, cuts = ids.tobytes(), (ends * self.kind.itemsize).tolist()
        return [data[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Pieces up to U+00FF are lower-cased and cut where the pattern cuts them; apostrophes and special tokens go whole."""
        known, earlier = self.known, self.known.earlier
        cut, needed, whole = {}, set(), []
        for piece in pieces:
            plain = piece.isascii() or max(piece) < "\u0100"
            if piece.isalpha():
                found = (piece.lower() if plain else piece,)
            elif plain and piece.isprintable() and "'" not in piece and "<|" not in piece:
                found = _PARTS.findall(piece.lower())
            else:
                whole.append(piece)
                continue
            cut[piece] = found
            needed.update(found)
        ready, words, signs = {}, [], []
        for part in needed:
            ids = known[part] if part in known else earlier.get(part)
            if ids is None:
                (words if part.isalpha() else signs).append(part)
            else:
                ready[part] = ids
        out = dict(zip(words, self._word_ids(words), strict=True)) if words else {}
        if signs or whole:
            out.update(zip(signs + whole, self._library_ids(signs + whole), strict=True))
        ready.update(out)
        for piece, found in cut.items():
            out[piece] = ready[found[0]] if len(found) == 1 else b"".join([ready[x] for x in found])
        return out

    def ids(self, text: str) -> bytes:
        """The ids as little-endian integers of `kind`."""
        out, at = [], 0
        while at < len(text):
            end = len(text) if len(text) - at <= SLICE else self._blank(text, at + SLICE)
            pieces = text[at:end].replace("\n", " ").split(" ")
            at = end
            found = list(map(self.known.__getitem__, pieces))
            if self.known.new:
                new, self.known.new = self.known.new, set()
                learnt = self._learn(new)
                for i in [i for i, b in enumerate(found) if b is None]:
                    found[i] = learnt[pieces[i]]
                self.known.update((p, b) for p, b in learnt.items() if len(p) <= KEPT)
                if len(self.known) > TABLE:
                    self.known = _Known(dict(self.known))
            out.append(b"".join(found))
        return b"".join(out)

    @staticmethod
    def _blank(text: str, at: int) -> int:
        ends = [e for e in (text.find(" ", at), text.find("\n", at)) if e >= 0]
        return min(ends) if ends else len(text)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def serialize(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return HEAD.pack(doc_id or 0, len(ids) // width, width, doc_id is not None) + ids


def parse(record: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, n, width, named = HEAD.unpack_from(record)
    ids = np.frombuffer(record, f"<u{width}", offset=HEAD.size)
    if len(ids) != n:
        raise ValueError("a record does not hold as many ids as it says")
    return doc_id if named else None, ids


class _Files:
    """Files of one task's attempt; each `flush` appends frames, each `close` gives the manifest's row."""

    def __init__(self, folder: str):
        self.files, self.base = filesystem(folder)
        self.part, self.seq, self.out = TaskContext.get().partitionId(), 0, None
        self.records: list[bytes] = []
        self.size = 0

    def add(self, record: bytes) -> None:
        self.records.append(record)
        self.size += len(record)

    def flush(self) -> None:
        if not self.records:
            return
        if self.out is None:
            self.path = f"{self.base}/{uuid.uuid4().hex}"
            self.out, self.at, self.tokens, self.index = self.files.open_output_stream(f"{self.path}.records"), 0, 0, []
        for record, frame in zip(self.records, frames(self.records), strict=True):
            self.out.write(frame)
            self.index.append((self.at + 12, len(record)))
            self.at += len(frame)
            self.tokens += HEAD.unpack_from(record)[1]
        self.records, self.size = [], 0

    def close(self) -> pa.RecordBatch:
        self.out.close()
        with self.files.open_output_stream(f"{self.path}.index") as out:
            out.write(np.array(self.index, ENTRY).tobytes())
        row = (self.part, self.seq, self.path, len(self.index), self.tokens, self.at)
        self.out, self.seq = None, self.seq + 1
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=MANIFEST.replace(",", "").split()[::2])


def write_records(
    docs: DataFrame, folder: str, vocabulary: str, *, end_id: int = 1, doc_id="doc_id", text="text", file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Encode all texts, append `end_id` to each and write them into `folder`; the manifest, itself a written table.

    `vocabulary` is a file of the tokenizers library that executors can read.
    """
    files, base = filesystem(folder)
    files.create_dir(base)

    def run(batches):
        coder, out = encoder(vocabulary), _Files(folder)
        end, width = np.array([end_id], coder.kind).tobytes(), coder.kind.itemsize
        for batch in batches:
            for key, content in zip(batch.column(0), batch.column(1), strict=True):
                out.add(serialize(key.as_py(), coder.ids(content.as_py() or "") + end, width))
                if out.size >= FLUSH:
                    out.flush()
                    if out.at >= file_bytes:
                        yield out.close()
        out.flush()
        if out.out is not None:
            yield out.close()

    keyed = docs.select(F.col(doc_id).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartitionByRange(parts, F.asc_nulls_first("key"), "tie").sortWithinPartitions(F.asc_nulls_first("key"), "tie")
    return settle(dealt.select("key", "text").mapInArrow(run, MANIFEST), "manifest")


_BEFORE = (Window.unboundedPreceding, -1)


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with `start`, the number of ids in all files before each.

    Sums of a part, sums of `FILES_PER_SUM` parts, then windows over each: no task sees all files.
    """
    block = F.expr(f"part div {FILES_PER_SUM}")
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    sums = parts.groupBy(block.alias("block")).agg(F.sum("n").alias("n"))
    blocks = sums.select("block", F.sum("n").over(Window.orderBy("block").rowsBetween(*_BEFORE)).alias("earlier"))
    inside = parts.select("part", block.alias("block"), F.sum("n").over(Window.partitionBy(block).orderBy("part").rowsBetween(*_BEFORE)).alias("near"))
    firsts = inside.join(blocks, "block").select("part", (F.coalesce("earlier", F.lit(0)) + F.coalesce("near", F.lit(0))).alias("first"))
    own = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(*_BEFORE))
    return manifest.withColumn("own", F.coalesce(own, F.lit(0))).join(firsts, "part").withColumn("start", F.col("first") + F.col("own")).drop("own", "first")


def _spread(df: DataFrame, *by: str) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _records_of(files, path: str) -> Iterator[list[bytes]]:
    """Records of one file in order, a few MB at a time, found through its index."""
    with files.open_input_file(f"{path}.index") as file:
        index = np.frombuffer(file.read(), ENTRY)
    with files.open_input_file(f"{path}.records") as file:
        at = 0
        while at < len(index):
            first = int(index["offset"][at]) - 12
            reach = index["offset"][at:] + index["length"][at:] + np.uint64(4)
            n = max(1, int(np.searchsorted(reach, first + FLUSH, side="right")))
            file.seek(first)
            data = file.read(int(reach[n - 1]) - first)
            cut = [int(x) - first for x in reach[:n]]
            yield unframe([data[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=True)])
            at += n


def read_records(manifest: DataFrame, folder: str, *, digest: bool = False) -> DataFrame:
    """Per record: doc_id, start (ids of all records before it), n_tokens, and token_ids.

    With `digest`, ids_crc32 stands in place of token_ids: the CRC-32 of the ids as 32-bit integers.
    """

    def run(batches):
        files, _ = filesystem(folder)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for records in _records_of(files, path):
                    found = [parse(r) for r in records]
                    sizes = np.array([len(ids) for _, ids in found], np.int64)
                    starts = start + np.cumsum(sizes) - sizes
                    start += int(sizes.sum())
                    if digest:
                        last = pa.array([zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in found], pa.int64())
                    else:
                        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                        last = pa.ListArray.from_arrays(offsets, np.concatenate([ids for _, ids in found]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array(starts), pa.array(sizes), last], names=names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "token_ids"]
    kind = "ids_crc32 long" if digest else "token_ids array<int>"
    files = _spread(with_starts(manifest).select("path", "start"), "path")
    return files.mapInArrow(run, f"doc_id long, start long, n_tokens long, {kind}")


def read_shuffled(manifest: DataFrame, folder: str, seed: int) -> DataFrame:
    """All records (position, doc_id, token_ids) in an order that `seed` decides, each read by its range.

    Only places are shuffled. `position` grows from partition to partition and inside each; it is a hash.
    """

    def places(batches):
        files, _ = filesystem(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with files.open_input_file(f"{path}.index") as file:
                    index = np.frombuffer(file.read(), ENTRY)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(index), pa.string()), pa.array(index["offset"].astype(np.int64)), pa.array(index["length"].astype(np.int64))],
                    names=["path", "offset", "length"],
                )

    def run(batches):
        files, _ = filesystem(folder)
        for batch in batches:
            wanted = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            at = 0
            while at < len(wanted):
                stop, size = at, 0
                while stop < len(wanted) and (stop == at or size + wanted[stop][3] <= FLUSH):
                    size += wanted[stop][3]
                    stop += 1
                some, at, found = wanted[at:stop], stop, []
                for _, path, offset, length in some:
                    with files.open_input_file(f"{path}.records") as file:
                        file.seek(offset - 12)
                        found.append(file.read(length + 16))
                rows = [parse(r) for r in unframe(found)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in some], pa.int64()), pa.array([i for i, _ in rows], pa.int64()), pa.array([ids.astype(np.int32) for _, ids in rows], pa.list_(pa.int32()))],
                    names=["position", "doc_id", "token_ids"],
                )

    index = _spread(manifest.select("path"), "path").mapInArrow(places, "path string, offset long, length long")
    placed = index.withColumn("position", F.xxhash64(F.lit(seed), "path", "offset"))
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartitionByRange(parts, "position").sortWithinPartitions("position").select("position", "path", "offset", "length")
    return ordered.mapInArrow(run, "position long, doc_id long, token_ids array<int>")


def round_trip(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Write all documents, read all records back as digests, delete the files."""
    spark = docs.sparkSession
    folder = new_path(spark, "records")
    out = settle(read_records(write_records(docs, folder, vocabulary, **options), folder, digest=True), "digests")
    drop_tables(spark, [folder])
    return out
