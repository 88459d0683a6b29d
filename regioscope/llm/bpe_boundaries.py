"""Byte-level BPE with forced boundaries.

Two neighbouring bytes that stand side by side in no vocabulary token can
never be joined by a merge: between them every encoding has a boundary.
A text is cut at these places (found for a whole Arrow batch with one table
look-up per byte), each fragment is encoded on its own, and the ids are
concatenated.  Fragments repeat a great deal, so each task keeps a bounded
table of those already encoded.

Cuts must also leave the pre-tokeniser's pattern alone.  It looks only
forward, so a cut is harmless where both sides are encoded as in the whole
text: never after white space (``\\s+(?!\\S)`` looks at what follows a run),
never inside a UTF-8 character, and before an apostrophe only after an ASCII
letter or digit (a contraction may begin there).

Null and empty texts give no ids and decode to an empty text.  The text of a
special token stands for that token, as the library reads it.  Every row is
encoded on its own and gives one row: repeated and null ids stay as they are,
other columns are left out whatever their names, and no rows give none.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regioscope.llm.bytescan import text_buffers

#: Fragments that a task remembers, and the longest one that it remembers.
REMEMBERED, LONGEST = 400_000, 64

# Fixed values of byte-level BPE: white space, and the pre-tokeniser's pattern.
WHITE = r"\t-\r \x85\xa0  -     　"
PATTERN = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+"
           rf"|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
WIDE_WHITE = regex.compile(
    rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary:
    itself where it prints, else the next code point from 256 on."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printing)]
    return {chr(b): b for b in printing} | {chr(256 + i): b for i, b in enumerate(rest)}


class BoundaryBPE:
    """One vocabulary file: cut table, merges, and the bytes of each id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        raw = {t: bytes(letters[c] for c in t) for t in spec["model"]["vocab"]}
        vocab = spec["model"]["vocab"]
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for t, i in vocab.items():
            self.bytes_of[i] = raw[t]
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.byte_id = [0] * 256
        for t, i in vocab.items():
            if len(raw[t]) == 1:
                self.byte_id[raw[t][0]] = i
        # the pair of ids that each merge joins, packed, and by rank its result
        self.rank: dict[int, int] = {}
        self.pair, self.joined = [], []
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.pair.append(vocab[a] << 32 | vocab[b])
            self.joined.append(vocab[a + b])
            self.rank[self.pair[-1]] = rank
        self.split_special = regex.compile(
            "(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") \
            if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.cut = self._cut_table(raw.values())
        self.known: dict[bytes, bytes] = {}

    def _cut_table(self, tokens: Iterable[bytes]) -> np.ndarray:
        """Flat 256 x 256 table: is there a certain cut between two bytes?"""
        cut = np.ones((256, 256), bool)
        for t in [*tokens, *(c.encode() for c in CONTRACTIONS)]:
            for x, y in zip(t, t[1:]):
                cut[x, y] = False
        cut[:, 0x80:0xC0] = False
        cut[[*range(0x09, 0x0E), 0x20], :] = False
        plain = np.zeros(256, bool)
        plain[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
        cut[~plain, 0x27] = False
        return cut.ravel()

    def fragments(self, text: bytes) -> list[bytes]:
        """The pieces between certain cuts."""
        data = np.frombuffer(text, np.uint8)
        if len(data) < 2:
            return [text] if text else []
        at = self.cut[(data[:-1].astype(np.uint16) << 8) | data[1:]]
        if not text.isascii():
            for m in WIDE_WHITE.finditer(text):
                at[m.end() - 1:m.end()] = False
        ends = np.flatnonzero(at) + 1
        starts = [0, *ends.tolist()]
        return [text[s:e] for s, e in zip(starts, [*starts[1:], len(text)])]

    def _merge_word(self, word: bytes) -> list[int]:
        """Merges of one pre-token, lowest rank first, leftmost on ties."""
        rank, pair = self.rank, self.pair
        ids = [self.byte_id[b] for b in word]
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        # a heap entry is one integer: the rank, then the place
        heap = [r << 32 | i for i, (a, b) in enumerate(zip(ids, ids[1:]))
                if (r := rank.get(a << 32 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i, r = top & 0xFFFFFFFF, top >> 32
            j = right[i]
            if j < 0 or ids[i] << 32 | ids[j] != pair[r]:
                continue
            ids[i], after = self.joined[r], right[j]
            ids[j], right[j], right[i] = -1, -1, after
            if after >= 0:
                left[after] = i
                if (r := rank.get(ids[i] << 32 | ids[after])) is not None:
                    heapq.heappush(heap, r << 32 | i)
            before = left[i]
            if before >= 0 and (r := rank.get(ids[before] << 32 | ids[i])) is not None:
                heapq.heappush(heap, r << 32 | before)
        return [x for x in ids if x >= 0]

    def _fragment_ids(self, piece: bytes) -> bytes:
        ids: list[int] = []
        for word in self.pattern.findall(piece.decode("utf-8")):
            ids += self._merge_word(word.encode())
        out = np.array(ids, "<i4").tobytes()
        if len(piece) <= LONGEST:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = out
        return out

    def encode(self, text: bytes) -> bytes:
        """The ids of a UTF-8 text as little-endian 32-bit integers."""
        if self.split_special and any(s.encode() in text for s in self.special):
            out = []
            for k, part in enumerate(self.split_special.split(text.decode("utf-8"))):
                out.append(np.array([self.special[part]], "<i4").tobytes() if k % 2
                           else self._plain(part.encode()))
            return b"".join(out)
        return self._plain(text)

    def _plain(self, text: bytes) -> bytes:
        known = self.known
        return b"".join([known.get(p) or self._fragment_ids(p) for p in self.fragments(text)])

    def decode(self, ids: np.ndarray) -> str:
        """Bytes of the ids, read as UTF-8 (an invalid byte: U+FFFD)."""
        of = self.bytes_of
        return b"".join([of[i] for i in ids.tolist()]).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def load(path: str) -> BoundaryBPE:
    return BoundaryBPE(path)


#: Output bytes after which a task hands on a batch.
_BATCH_BYTES = 16 << 20


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text; ``vocabulary`` is a file
    that every executor can read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            raw, off = text_buffers(batch.column(1))
            data, first, size, parts = raw.tobytes(), 0, 0, []
            for i in range(batch.num_rows):
                parts.append(bpe.encode(data[off[i]:off[i + 1]]))
                size += len(parts[-1])
                if size >= _BATCH_BYTES or i + 1 == batch.num_rows:
                    ends = np.cumsum([0, *map(len, parts)]) // 4
                    values = pa.array(np.frombuffer(b"".join(parts), "<i4"))
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first, i + 1 - first), ids], ["id", "ids"])
                    first, size, parts = i + 1, 0, []

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col))


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id",
           ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded) of every list of ids (null: empty text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            lists = batch.column(1)
            values = np.asarray(lists.values, np.int32) if len(lists.values) else np.zeros(0, np.int32)
            off = lists.offsets.to_numpy()
            texts = pa.array([bpe.decode(values[off[i]:off[i + 1]]) for i in range(len(lists))],
                             pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, texts],
                                             ["id", "ids", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return (encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
            .mapInArrow(run, f"id {kind}, ids array<int>, decoded string")
            .withColumnsRenamed({"id": id_col, "ids": ids_col}))


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 from the two operators."""
    out = decode(encode(docs, vocabulary), vocabulary)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
