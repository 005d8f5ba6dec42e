"""Token ids packed into fixed-length rows by best-fit decreasing.

Each task encodes its documents with a public byte-level BPE vocabulary, splits
documents longer than a row into consecutive pieces without losing a token, and
gathers pieces up to ``WINDOW`` tokens. A window is packed by best-fit
decreasing: pieces from long to short, each into the row with the least free
space that still holds it, found by a segment tree over free space. Windows are
packed apart from each other, so nothing is shuffled and memory is bounded.

A packed row has the ids as a little-endian matrix row (``uint16`` or ``uint32``,
padded), the cumulative segment lengths, and the positions where positions
restart from 0. Segments tell their document, their first token's place in it,
and so allow an exact return to the documents.

Defined cases: a null or empty text has no tokens and no segment; repeated
documents are packed each; a null id is carried as null; very long texts are
encoded in pieces that give the same ids; columns other than id and text are
ignored, whatever their names; an empty table packs no row.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from loomtext.llm.common import bounded_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Word pattern of that vocabulary, a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LENGTH = 2048
WINDOW = 4_000_000
PAD = 0
#: Texts are encoded in pieces of about this many characters, cut before a space that starts a word.
PIECE = 100_000

_ENCODINGS: dict[str, tiktoken.Encoding] = {}


def encoding(path: str = VOCABULARY) -> tiktoken.Encoding:
    if path not in _ENCODINGS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODINGS[path] = tiktoken.Encoding("loomtext", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def encode(text: str | None, vocabulary: str = VOCABULARY) -> np.ndarray:
    """All token ids of a text.

    Long texts are encoded in pieces that are cut where the word pattern always
    ends a word (before a single space between two letters), so ids are the same.
    """
    enc = encoding(vocabulary)
    if not text:
        return np.zeros(0, np.uint32)
    if len(text) <= PIECE:
        return np.array(enc.encode_ordinary(text), np.uint32)
    out, at = [], 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and not (text[end] == " " and text[end - 1].isalpha() and text[end + 1 : end + 2].isalpha()):
            end += 1
        out.append(np.array(enc.encode_ordinary(text[at:end]), np.uint32))
        at = end
    return np.concatenate(out)


def decode(ids: np.ndarray, vocabulary: str = VOCABULARY) -> str:
    return encoding(vocabulary).decode_bytes([int(i) for i in ids]).decode()


class FreeSpace:
    """Segment tree over free space 0..length: the least space that is at least some need, in O(log length)."""

    def __init__(self, length: int) -> None:
        self.base = 1 << length.bit_length()
        self.count = [0] * (2 * self.base)

    def add(self, space: int, n: int) -> None:
        i = self.base + space
        while i:
            self.count[i] += n
            i >>= 1

    def least(self, need: int) -> int | None:
        i = self.base + need
        if self.count[i]:
            return need
        while i > 1:
            if not i & 1 and self.count[i + 1]:  # to the right of a left child
                i += 1
                while i < self.base:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.base
            i >>= 1
        return None


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Rows of piece numbers, best-fit decreasing; equal lengths keep their order."""
    rows: list[list[int]] = []
    open_rows: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free space
    tree = FreeSpace(capacity)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        space = tree.least(need)
        if space is None:
            row = len(rows)
            rows.append([])
            space = capacity
        else:
            row = open_rows[space].pop()
            tree.add(space, -1)
        rows[row].append(i)
        if space > need:
            open_rows[space - need].append(row)
            tree.add(space - need, 1)
    return rows


SCHEMA = pa.schema([
    ("input_ids", pa.binary()), ("id_bytes", pa.int32()), ("n_tokens", pa.int32()), ("cu_seqlens", pa.list_(pa.int32())),
    ("position_resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("doc_offsets", pa.list_(pa.int64())),
])
COLUMNS = "input_ids binary, id_bytes int, n_tokens int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<bigint>, doc_offsets array<bigint>"


def _pack(pieces: list[tuple], length: int, dtype: np.dtype, pad: int) -> Iterator[pa.RecordBatch]:
    rows = best_fit(np.array([len(p[2]) for p in pieces], np.int64), length)
    for a in range(0, len(rows), 512):
        out: list[list] = [[] for _ in SCHEMA]
        for row in rows[a : a + 512]:
            own = [pieces[i] for i in row]
            ids = np.full(length, pad, dtype)
            ends = np.cumsum([len(p[2]) for p in own])
            ids[: ends[-1]] = np.concatenate([p[2] for p in own])
            cumulative = [0, *ends.tolist()]
            values = (ids.tobytes(), dtype.itemsize, cumulative[-1], cumulative, cumulative[:-1], [p[0] for p in own], [p[1] for p in own])
            for c, v in zip(out, values, strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, SCHEMA, strict=True)], schema=SCHEMA)


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, length: int = LENGTH, window: int = WINDOW, pad: int = PAD) -> DataFrame:
    """Packed rows of all documents; ids must be integers."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        dtype = np.dtype("<u2" if encoding(vocabulary).n_vocab <= 1 << 16 else "<u4")
        pieces, size = [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(text.as_py(), vocabulary).astype(dtype)
                for at in range(0, len(ids), length):
                    pieces.append((doc, at, ids[at : at + length]))
                size += len(ids)
                if size >= window:
                    yield from _pack(pieces, length, dtype, pad)
                    pieces, size = [], 0
        if pieces:
            yield from _pack(pieces, length, dtype, pad)

    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").mapInArrow(run, COLUMNS)


def segments(row) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc id, place of the first token in the document, ids) of each segment of a packed row."""
    ids = np.frombuffer(row["input_ids"], f"<u{row['id_bytes']}")
    for doc, at, a, b in zip(row["doc_ids"], row["doc_offsets"], row["cu_seqlens"][:-1], row["cu_seqlens"][1:], strict=True):
        yield doc, at, ids[a:b]


def positions(row) -> np.ndarray:
    """Position ids of a packed row, which restart at each reset; padding has position 0."""
    out = np.zeros(len(row["input_ids"]) // row["id_bytes"], np.int32)
    for a, b in zip(row["cu_seqlens"][:-1], row["cu_seqlens"][1:], strict=True):
        out[a:b] = np.arange(b - a)
    return out


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet shards, whose binary column concatenates to the id matrix."""
    packed.write.parquet(path)
