"""Exact repeated byte strings by a depth-limited radix sort of suffixes.

A suffix counts only through its first ``length`` bytes (its window).
Windows are dealt into ever finer groups by most-significant-digit passes;
a group that holds one window is finished, and the groups left at full depth
are exactly the repeated windows.  Digits are 64-bit fingerprints of parts of
the window, so that long common prefixes cost one pass and not many, and
neighbouring suffixes travel together while they share their digits:

1. The first digit is the window's anchor, its smallest ``GRAM``-byte gram by
   fingerprint (leftmost on ties).  Equal windows have equal anchors in the
   same place.  Consecutive windows with one anchor form a run, one row.
   Runs whose anchor stands nowhere else are finished.
2. The second digit is the whole content of the run.  Runs that occur twice
   are repeated in every window.  One row for each content goes on, and only
   where contents of one anchor differ.
3. Runs are cut into blocks of ``BLOCK`` windows, aligned to the anchor.  All
   windows of a block share its core; a core that occurs once ends the
   block, a block content that occurs twice makes all its windows repeated.
4. Only blocks in which a repeat begins or ends are sorted window by window.

Every digit pass is a partial aggregate by digit, so a digit held by a third
of all rows is combined inside each task.  Null and empty texts, and those
shorter than the window, hold no window.  Rows that repeat both id and text
are repeats of each other; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regioscope.llm.bytescan import SLICE, U, mix, prefix_hash, slices, span_hash, text_buffers
from regioscope.llm.scratch import discard, materialize

GRAM, BLOCK = 48, 16
_PLACE = (1 << 21) - 1


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def find_runs(data: np.ndarray, ends: np.ndarray, length: int):
    """Runs of windows in some texts that lie end to end; ``ends`` has each
    text's end.  Returns start, n, lead (bytes from the first window's start
    to the anchor), anchor and content fingerprints."""
    gram = min(GRAM, length)
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(U), none.astype(U)
    prefix = prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    grams = span_hash(prefix, at, at + gram)
    least = _sliding_min((grams & U(~_PLACE & (1 << 64) - 1)) | at.astype(U), length - gram + 1)
    anchor = (least & U(_PLACE)).astype(np.int64)
    valid = np.zeros(len(anchor) + 1, bool)
    begin = 0
    for end in ends.tolist():
        if end - begin >= length:
            valid[begin:end - length + 1] = True
        begin = end
    valid, last = valid[:-1], valid[1:]
    start = np.flatnonzero(valid & np.concatenate([[True], ~valid[:-1] | (anchor[1:] != anchor[:-1])]))
    final = np.flatnonzero(valid & (~last | np.concatenate([anchor[1:] != anchor[:-1], [True]])))
    place = anchor[start]
    return (start, final - start + 1, place - start, grams[place],
            span_hash(prefix, start, final + length))


def runs(docs: DataFrame, length: int) -> DataFrame:
    """(id, fp, start, n, lead, anchor, body) of every run of every text."""
    def rows(batch, keys, *columns):
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(keys), batch.column(1).take(keys),
             *(pa.array(c.view(np.int64)) for c in columns)],
            ["id", "fp", "start", "n", "lead", "anchor", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffers(batch.column(2))
            for i, j in slices(raw, off):
                lo, hi = int(off[i]), int(off[j])
                step = hi - lo if hi - lo <= 2 * SLICE else SLICE
                for at in range(lo, hi, max(step, 1)):
                    end = min(hi, at + step + length - 1)  # windows that start below at + step
                    ends = off[i + 1:j + 1] - lo if step == hi - lo else np.array([end - at])
                    start, *rest = find_runs(raw[at:end], ends, length)
                    row = i + np.searchsorted(off[i + 1:j + 1], start + at, "right")
                    yield rows(batch, pa.array(row), start + at - off[row], *rest)

    return docs.mapInArrow(run, "id long, fp long, start long, n long, lead long, "
                                "anchor long, body long")


def _small(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Parts of the batches, so that what a task makes of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"),
                       F.xxhash64(text).alias("fp"), text.alias("text"), F.col(id_col).alias("own_id"))


def _contents(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``wanted`` runs with their bytes (``piece``)."""
    lists = wanted.groupBy("id", "fp").agg(
        F.collect_list(F.struct("start", "n", "lead", "anchor", "body", "copies")).alias("of"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches, 500):
            raw, off = text_buffers(batch.column(2))
            lists = batch.column(3)
            items = lists.flatten()
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            start = np.asarray(items.field("start"))
            first = (off[row] + start).tolist()
            last = (off[row] + start + np.asarray(items.field("n")) - 1 + length).tolist()
            data = memoryview(raw)
            keys = pa.array(row)
            names = ["start", "n", "lead", "anchor", "body", "copies"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(keys), batch.column(1).take(keys),
                 *(items.field(c) for c in names),
                 pa.array([bytes(data[s:e]) for s, e in zip(first, last)], pa.binary())],
                ["id", "fp", *names, "piece"])

    return (docs.select("id", "fp", "text").dropDuplicates(["id", "fp"]).join(lists, ["id", "fp"])
            .mapInArrow(run, "id long, fp long, start long, n long, lead long, anchor long, "
                             "body long, copies long, piece binary"))


def _pieces(batch: pa.RecordBatch):
    """Prefix hashes of all pieces of a batch, piece offsets, run columns."""
    column = batch.column(batch.schema.get_field_index("piece"))
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]]
    num = {c: np.asarray(batch.column(c)) for c in ("start", "n", "lead", "anchor", "body", "copies")}
    return prefix_hash(raw), off[:-1] - off[0], num


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, running number within the row) for ``counts`` items a row."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _blocks(pieces: DataFrame, length: int) -> DataFrame:
    """(run columns, block, low, high, core, whole): blocks of window
    offsets before the anchor; ``whole`` is null where the run does not own
    the whole block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            prefix, base, c = _pieces(batch)
            least, most = c["lead"] - c["n"] + 1, c["lead"]
            row, i = _spread(most // BLOCK - least // BLOCK + 1)
            block = least[row] // BLOCK + i
            low, high = np.maximum(least[row], block * BLOCK), np.minimum(most[row], block * BLOCK + BLOCK - 1)
            near = base[row] + c["lead"][row] - block * BLOCK  # start of the block's last window
            salt = mix(c["anchor"][row].view(U) + block.astype(U))
            core = span_hash(prefix, near, near - (BLOCK - 1) + length) + salt
            owned = high - low == BLOCK - 1
            whole = span_hash(prefix, np.where(owned, near - (BLOCK - 1), 0),
                              np.where(owned, near + length, 0)) + salt
            keys = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x).take(keys) for x in ("id", "fp", "start", "lead", "anchor", "body", "copies")),
                 pa.array(block), pa.array(low), pa.array(high), pa.array(core.view(np.int64)),
                 pa.array(whole.view(np.int64), mask=~owned)],
                ["id", "fp", "start", "lead", "anchor", "body", "copies", "block", "low", "high", "core", "whole"])

    return pieces.mapInArrow(run, "id long, fp long, start long, lead long, anchor long, body long, "
                                  "copies long, block long, low long, high long, core long, whole long")


def _windows(parts: DataFrame, length: int) -> DataFrame:
    """(id, fp, at, copies, window) for the windows ``low`` to ``high``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            prefix, base, c = _pieces(batch)
            low, high = np.asarray(batch.column("low")), np.asarray(batch.column("high"))
            row, i = _spread(high - low + 1)
            before = c["lead"][row] - (low[row] + i)
            at = base[row] + before
            salt = mix(c["anchor"][row].view(U) + (low[row] + i).astype(U))
            keys = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(keys), batch.column("fp").take(keys),
                 pa.array(c["start"][row] + before), batch.column("copies").take(keys),
                 pa.array((span_hash(prefix, at, at + length) + salt).view(np.int64))],
                ["id", "fp", "at", "copies", "window"])

    return parts.mapInArrow(run, "id long, fp long, at long, copies long, window long")


def repeated_starts(keyed: DataFrame, length: int) -> DataFrame:
    """(id, fp, first, last): ranges of starts of repeated windows."""
    every = materialize(runs(keyed.select("id", "fp", "text"), length), "runs")
    again = every.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor")
    # written first: a join of two plain tables is one whose hot keys Spark splits
    again = materialize(again, "anchors")
    kept = materialize(every.join(again, "anchor"), "repeated-anchors")
    discard(every, again)
    contents = materialize(
        kept.groupBy("anchor", "body").agg(F.count("*").alias("copies"),
                                           F.min(F.struct("id", "fp", "start", "n", "lead")).alias("rep")),
        "contents")
    copied = contents.where("copies > 1").select("anchor", "body")
    whole = (kept.join(copied, ["anchor", "body"])
             .select("id", "fp", F.col("start").alias("first"),
                     (F.col("start") + F.col("n") - 1).alias("last")))
    open_ = (contents.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("copies").alias("least"))
             .where("kinds > 1 and least = 1").select("anchor"))
    wanted = contents.join(open_, "anchor").select("rep.*", "anchor", "body", "copies")
    pieces = materialize(_contents(keyed, wanted, length), "pieces")
    blocks = materialize(_blocks(pieces, length), "blocks")
    cores = blocks.groupBy("core").agg(F.sum("copies").alias("times"), F.min("copies").alias("least")) \
        .where("times > 1 and least = 1").select("core")
    live = materialize(blocks.join(cores, "core"), "live")
    discard(blocks)
    twice = live.where("whole is not null").groupBy("whole").agg(F.sum("copies").alias("times")) \
        .where("times > 1").select("whole", F.lit(True).alias("twice"))
    single = materialize(live.where("copies = 1").join(twice, "whole", "left"), "single")
    in_block = single.where("twice").select(
        "id", "fp", (F.col("start") + F.col("lead") - F.col("high")).alias("first"),
        (F.col("start") + F.col("lead") - F.col("low")).alias("last"))
    edges = single.where("twice is null").select("core").distinct()
    parts = live.join(edges, "core", "left_semi").select("anchor", "body", "low", "high") \
        .join(pieces, ["anchor", "body"])
    windows = materialize(_windows(parts, length), "windows")
    discard(live, pieces)
    equal = windows.groupBy("window").agg(F.sum("copies").alias("times")).where("times > 1").select("window")
    alone = windows.where("copies = 1").join(equal, "window").select(
        "id", "fp", F.col("at").alias("first"), F.col("at").alias("last"))
    return whole.union(in_block).union(alone)


def _cut(firsts: list[int], lasts: list[int], length: int) -> list[tuple[int, int]]:
    """Merged byte spans that the windows starting in these ranges cover."""
    spans: list[list[int]] = []
    for first, last in sorted(zip(firsts, lasts)):
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], last + length)
        else:
            spans.append([first, last + length])
    return [(s, e) for s, e in spans]


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(id, n_bytes, spans array<struct<start,end>>, kept binary): every byte
    covered by a string of ``length`` bytes that also starts elsewhere goes.
    Spans are maximal and count bytes of the UTF-8 text; what is left need
    not be valid UTF-8."""
    if length < 2 * BLOCK:
        raise ValueError(f"length must be at least {2 * BLOCK}")
    keyed = _keyed(docs, id_col, text_col)
    found = repeated_starts(keyed, length).groupBy("id", "fp").agg(
        F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches, 500):
            raw, off = text_buffers(batch.column(1))
            data, at = raw[off[0]:off[-1]].tobytes(), (off - off[0]).tolist()
            spans, kept = [], []
            for i, (firsts, lasts) in enumerate(zip(batch.column(2).to_pylist(),
                                                    batch.column(3).to_pylist())):
                text = data[at[i]:at[i + 1]]
                cut = _cut(firsts or [], lasts or [], length)
                edges = [0, *(x for s in cut for x in s), len(text)]
                spans.append([{"start": s, "end": e} for s, e in cut])
                kept.append(b"".join(text[s:e] for s, e in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(off)),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(kept, pa.binary())], ["own_id", "n_bytes", "spans", "kept"])

    return (keyed.join(found, ["id", "fp"], "left").select("own_id", "text", "firsts", "lasts")
            .mapInArrow(run, f"own_id {kind}, n_bytes long, "
                             "spans array<struct<start:long,end:long>>, kept binary")
            .withColumnRenamed("own_id", id_col))


def digests(docs: DataFrame, length: int = 200) -> DataFrame:
    out = remove_repeats(docs, length)
    return out.select("doc_id", "n_bytes",
                      (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))
