"""Token-id files of transposed planes.

A file holds the ids of a run of texts, in order. Ids are cut into blocks of a fixed
number; a block, as little-endian unsigned 32-bit integers, is transposed into 4 byte
planes (or 32 bit planes), and each plane is one zstandard frame. High planes are
all but constant and shrink to nothing. Layout:

    "TWPLANE1" | frames | index (zstandard of JSON) | index length, 8 bytes | "TWPLANE1"

The index lists, for every block, its place, its number of ids and its frames' lengths,
and the texts' ids and lengths, so any text is read from the blocks it lies in alone.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from .scratch import materialize, new_path, open_fs, trim, write_atomic

MAGIC = b"TWPLANE1"
BLOCK_IDS = 1 << 16
#: A partition starts another file beyond so many compressed bytes or texts, so that a task's memory does not grow with its partition.
FILE_BYTES, FILE_TEXTS = 64 << 20, 500_000
#: Cached pieces of a worker; beyond, the cache starts anew.
CACHE_PIECES = 1_000_000
#: Bytes of text that are cut and looked up at a time.
ENCODE_BYTES = 1 << 19
#: Pieces of one call of the library, whose results hold about a KB each.
CALL_PIECES = 4096
_ENCODERS: dict[str, PieceEncoder] = {}


# Classes of bytes: 1 letter, 2 digit, 3 other ASCII that is no white space, 4 apostrophe, 5 blank, 6 TAB..CR, 0 not known.
# U+001C..U+001F are left unknown: they count as white space in some libraries only.
_CLASS = np.zeros(256, np.uint8)
for _b in range(128):
    _c = chr(_b)
    _CLASS[_b] = 5 if _c == " " else 6 if 9 <= _b <= 13 else 4 if _c == "'" else 1 if _c.isalpha() else 2 if _c.isdigit() else 0 if 0x1C <= _b <= 0x1F else 3

# The character that stands for each byte in a byte-level vocabulary, little-endian: printable Latin-1 itself, the others in order from U+0100.
_ALPHABET = np.arange(256, dtype="<u4")
_OTHERS = np.r_[0:33, 127:161, 173]
_ALPHABET[_OTHERS] = 256 + np.arange(len(_OTHERS))


class PieceEncoder:
    """Encodes texts with the tokenizers library, each distinct piece once.

    Texts are cut only where the byte-level pre-tokenizer always cuts (between a visible
    character and white space before it or after, and between letters, digits and
    punctuation other than the apostrophe), so the ids of the pieces, put together, are the
    ids of the text. A piece that is one pre-token for certain (a blank or none, then letters alone, digits alone or
    other ASCII alone) goes to the library's model as it is, in the byte-level alphabet; any other piece through the whole library.
    A text with an added token in it, and any text of a tokenizer of another kind, is encoded whole.
    """

    def __init__(self, path: str):
        # One thread for each task: more would hold memory arenas of their own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        pre = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        whole = self.tokenizer.normalizer or self.tokenizer.truncation or self.tokenizer.padding
        self.cuts = not whole and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.added = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)  # ascending hashes of the cached pieces
        self.begin = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text)."""
        ids, counts = [], []
        for i in range(0, len(texts), CALL_PIECES):
            each = [x.ids for x in self.tokenizer.encode_batch_fast(texts[i : i + CALL_PIECES], add_special_tokens=False)]
            counts.append(np.fromiter(map(len, each), np.int64, len(each)))
            ids.append(np.fromiter(chain.from_iterable(each), np.uint32, int(counts[-1].sum())))
        return np.concatenate(ids), np.concatenate(counts)

    def _starts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where pieces begin, classes of the bytes)."""
        kind = _CLASS[data]
        for lead, odd in ((0xC3, (0x97, 0xB7)), (0xD0, ()), (0xD1, ())):  # two-byte letters
            at = np.flatnonzero(data[:-1] == lead)
            at = at[~np.isin(data[at + 1], odd)]
            kind[at] = kind[at + 1] = 1
        a, b = kind[:-1], kind[1:]
        seen_a, seen_b = (a >= 1) & (a <= 4), (b >= 1) & (b <= 4)
        cut = (b >= 5) & seen_a
        alone = np.zeros(len(a), bool)  # after one white-space character by itself; within and after a longer run the pre-tokenizer looks ahead
        alone[1:] = seen_a[:-1]
        cut |= (a == 6) & seen_b & alone
        cut |= (a != b) & (a >= 1) & (a <= 3) & (b >= 1) & (b <= 3)
        start = np.zeros(len(data), bool)
        start[1:] = cut
        # A blank goes with what follows it; a run of white space is not cut within.
        edges = offsets[:-1][np.diff(offsets) > 0]
        start[edges] = True
        return np.flatnonzero(start), kind

    def _new(self, data: np.ndarray, raw: bytes, kind: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces [start, end), ids per piece)."""
        first = starts + ((data[starts] == 0x20) & (ends - starts > 1))
        turns = np.concatenate([[0], np.cumsum(kind[1:] != kind[:-1])])  # where the class changes, so far
        single = (kind[first] >= 1) & (kind[first] <= 3) & (turns[first] == turns[ends - 1])
        text, tokenize = _ALPHABET[data].tobytes().decode("utf-32-le"), self.model.tokenize  # a character for each byte
        own = np.flatnonzero(single)
        each: list[list[int]] = [[]] * len(starts)
        for i, s, e in zip(own.tolist(), starts[own].tolist(), ends[own].tolist(), strict=True):
            each[i] = [x.id for x in tokenize(text[s:e])]
        rest = np.flatnonzero(~single)
        if len(rest):
            ids, count = self._library([raw[s:e].decode() for s, e in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)])
            for i, x in zip(rest.tolist(), np.split(ids, np.cumsum(count)[:-1]), strict=True):
                each[i] = x.tolist()
        count = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter(chain.from_iterable(each), np.uint32, int(count.sum())), count

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text)."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        raw = data.tobytes()
        if not self.cuts or any(x in raw for x in self.added):
            return self._library([raw[offsets[i] : offsets[i + 1]].decode() for i in range(n)])
        starts, kind = self._starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        hashes = tk.span_hashes(data, starts, ends, lower=False)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > CACHE_PIECES:
            self.clear()
        slot = np.searchsorted(self.known, distinct)
        found = np.zeros(len(distinct), bool)
        inner = slot < len(self.known)
        found[inner] = self.known[slot[inner]] == distinct[inner]
        new = np.flatnonzero(~found)
        if len(new):
            at = first[new]
            ids, count = self._new(data, raw, kind, starts[at], ends[at])
            begin = len(self.ids) + np.cumsum(count) - count
            self.known = np.insert(self.known, slot[new], distinct[new])
            self.begin = np.insert(self.begin, slot[new], begin)
            self.count = np.insert(self.count, slot[new], count.astype(np.int32))
            self.ids = np.concatenate([self.ids, ids])
            slot = slot + np.cumsum(~found) - ~found
        of = slot[inverse]
        count, begin = self.count[of].astype(np.int64), self.begin[of]
        total = np.cumsum(count)
        ids = self.ids[np.arange(int(total[-1])) + np.repeat(begin - (total - count), count)]
        text_of = np.searchsorted(offsets, starts, "right") - 1
        return ids, np.bincount(text_of, weights=count, minlength=n).astype(np.int64)


def encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(raw[:, i]).tobytes() for i in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        raw = np.stack([np.frombuffer(x, np.uint8) for x in planes], 1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(x, np.uint8), count=n, bitorder="little") for x in planes], 1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


class PlaneWriter:
    """Builds one file; only compressed planes and one open block are kept."""

    def __init__(self, planes: str, block_ids: int, level: int):
        self.kind, self.block_ids, self.packer = planes, block_ids, zstandard.ZstdCompressor(level=level)
        self.body, self.size, self.blocks = [MAGIC], len(MAGIC), []
        self.open: list[np.ndarray] = []
        self.waiting = 0
        self.doc_ids: list[int | None] = []
        self.lengths: list[np.ndarray] = []

    def add(self, doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> None:
        self.doc_ids += doc_ids
        self.lengths.append(lengths)
        self.open.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block_ids:
            flat = np.concatenate(self.open)
            whole = len(flat) // self.block_ids * self.block_ids
            for i in range(0, whole, self.block_ids):
                self._block(flat[i : i + self.block_ids])
            self.open, self.waiting = [flat[whole:]], len(flat) - whole

    def _block(self, ids: np.ndarray) -> None:
        frames = [self.packer.compress(x) for x in to_planes(ids, self.kind)]
        self.blocks.append([self.size, len(ids), [len(x) for x in frames]])
        self.body += frames
        self.size += sum(map(len, frames))

    def finish(self) -> bytes:
        rest = np.concatenate(self.open) if self.open else np.zeros(0, np.uint32)
        if len(rest):
            self._block(rest)
        lengths = np.concatenate(self.lengths).tolist() if self.lengths else []
        index = self.packer.compress(json.dumps({"planes": self.kind, "block_ids": self.block_ids, "blocks": self.blocks, "doc_ids": self.doc_ids, "lengths": lengths}).encode())
        return b"".join([*self.body, index, len(index).to_bytes(8, "little"), MAGIC])


class PlaneReader:
    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} is not a whole token file")
        n = int.from_bytes(tail[:8], "little")
        self.unpacker = zstandard.ZstdDecompressor()
        index = json.loads(self.unpacker.decompress(self.file.read_at(n, size - 16 - n)))
        self.blocks, self.block_ids, self.doc_ids = index["blocks"], index["block_ids"], index["doc_ids"]
        self.lengths = np.array(index["lengths"], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self._last: tuple[int, np.ndarray] | None = None

    def block(self, i: int) -> np.ndarray:
        if self._last is None or self._last[0] != i:
            place, n, sizes = self.blocks[i]
            raw = self.file.read_at(sum(sizes), place)
            cuts = np.cumsum([0, *sizes])
            self._last = i, from_planes([self.unpacker.decompress(raw[cuts[k] : cuts[k + 1]]) for k in range(len(sizes))], n)
        return self._last[1]

    def ids(self, k: int):
        """The ids of text number k of this file, a block's share at a time."""
        at, end = int(self.starts[k]), int(self.starts[k + 1])
        while at < end:
            i = at // self.block_ids
            stop = min(end, (i + 1) * self.block_ids)
            yield self.block(i)[at - i * self.block_ids : stop - i * self.block_ids]
            at = stop


_MANIFEST = "part int, number int, file string, n_docs long, n_ids long"


def _write(batches, folder: str, tokenizer: str, end_id: int, planes: str, block_ids: int, level: int, file_bytes: int, file_texts: int):
    part = TaskContext.get().partitionId()
    out, number, n_ids = PlaneWriter(planes, block_ids, level), 0, 0
    enc = encoder(tokenizer)

    def finished():
        uri = f"{folder}/part-{part:08d}-{number:06d}.twp"
        write_atomic(uri, out.finish())
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "file": [uri], "n_docs": pa.array([len(out.doc_ids)]), "n_ids": pa.array([n_ids])})

    for batch in batches:
        names = batch.column("doc_id").to_pylist()
        for first, end, data, offsets in tk.chunks(batch.column("text"), ENCODE_BYTES):
            ids, lengths = enc.encode(data, offsets)
            ends = np.cumsum(lengths)
            out.add(names[first:end], lengths + 1, np.insert(ids, ends, np.uint32(end_id)))
            n_ids += len(ids) + end - first
            if out.size >= file_bytes or len(out.doc_ids) >= file_texts:
                yield finished()
                out, number, n_ids = PlaneWriter(planes, block_ids, level), number + 1, 0
    if out.doc_ids:
        yield finished()
    # A tokenizer and its pieces are some 200 MB, which a worker would keep through tasks of other kinds.
    _ENCODERS.clear()
    trim()


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 2, planes: str = "byte", block_ids: int = BLOCK_IDS, level: int = 3, file_bytes: int = FILE_BYTES, file_texts: int = FILE_TEXTS) -> DataFrame:
    """Encode ``docs(doc_id, text)`` in ascending doc_id order and write plane files; returns the manifest (part, number, file, n_docs, n_ids, start).

    Null and empty texts have the end id alone. Rows of one doc_id stand by text; a
    null doc_id comes first and is kept. Other columns are not read. An empty table
    writes no file and gives an empty manifest. The manifest has a row per file.
    """
    folder = folder or new_path(docs.sparkSession, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The text's beginning parts ranges of one doc_id; it orders as the text does.
    rows = rows.repartitionByRange("doc_id", F.substring("text", 1, 16)).sortWithinPartitions("doc_id", "text")
    made = rows.mapInArrow(partial(_write, folder=folder, tokenizer=tokenizer, end_id=end_id, planes=planes, block_ids=block_ids, level=level, file_bytes=file_bytes, file_texts=file_texts), _MANIFEST)
    made = materialize(made, "manifest")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _read(batches):
    for batch in batches:
        for uri, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
            file = PlaneReader(uri)
            n = len(file.doc_ids)
            for lo in range(0, n, 5000):
                hi = min(lo + 5000, n)
                crc = []
                for k in range(lo, hi):
                    c = 0
                    for ids in file.ids(k):
                        c = zlib.crc32(ids.astype("<u4").tobytes(), c)
                    crc.append(c)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(file.doc_ids[lo:hi], pa.int64()), "start": pa.array(file.starts[lo:hi] + start), "n_tokens": pa.array(file.lengths[lo:hi]), "ids_crc32": pa.array(crc, pa.int64())})


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every text, decoded from the files that a manifest names."""
    manifest = materialize(manifest, "files")
    files = manifest.count()
    return manifest.repartition(max(1, files)).select("file", "start").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
