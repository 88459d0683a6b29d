"""Ranked lexical search with range-maximum tables.

Every item of a query set is ranked against all documents.  Two passes:

1. Tasks cut documents into terms and keep, block by block, the posting lists
   of the query terms (documents, occurrences).  Counts of documents, terms
   and documents per term are added up over all blocks.
2. A posting becomes an impact (what its term adds to a score).  Every posting
   list of a block gets a sparse table: entry (l, i) is the place of the
   largest impact of 2**l postings from i on, so two entries answer any range.
   The sum of the answers of an item's lists bounds every score in an interval
   of documents.  The search takes the intervals with the highest bounds,
   scores in each the document of its largest impact, splits the interval
   there, and ends when no bound left can reach the best ``k``.

The best ``k`` of each block are merged by rank.  Nothing is approximate: the
bound of an interval left out is below the k-th score, or equal to it with
larger ids only.

Blocks are bounded by postings, whatever a document's length; equal texts,
hot sources and frequent terms only make more blocks.  Items are taken in
blocks of ``ITEM_BYTES`` of terms, each with passes of its own, so what is
broadcast stays bounded however many items there are.

Null and empty texts have no terms: such items have no rows, such documents
count in no figure.  Rows that repeat an id are documents (or items) of their
own; equal scores go by id, rows without an id last.  Only ids and texts are
read, so other columns may bear any name.  Arithmetic is in 64-bit integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from regioscope.llm.scratch import materialize

#: Postings of a block: its tables take about 100 bytes a posting.
POSTINGS = 1_000_000
#: Bytes of item terms that are broadcast at once.
ITEM_BYTES = 8 << 20
#: A text is cut into terms in slices of about this many bytes.
SLICE = 4 << 20
#: Intervals split in one step of a search.
STEP = 64
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes to bytes: separators to spaces, A-Z to lower case.  Bytes of other
#: characters stay, as they are at least 0x80.
_PLAIN = bytes(ord(chr(b).lower()) if b < 0x80 and chr(b).isalnum() else b if b >= 0x80 else 0x20 for b in range(256))


def terms(text: Column) -> Column:
    """The distinct terms of a text, as a column."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.array_distinct(F.array_remove(F.split(low, SEPARATORS), ""))


def count_terms(text: bytes, vocabulary: dict[bytes, int]) -> tuple[int, Counter]:
    """How many terms a text has, and how often those of the vocabulary."""
    n, found, start = 0, Counter(), 0
    while start < len(text):
        end = start + SLICE
        part = text[start:end].translate(_PLAIN)
        if end < len(text):  # cut behind the last separator; a term may be longer than a slice
            cut = part.rfind(b" ") + 1
            while not cut:
                more = text[end:end + SLICE].translate(_PLAIN)
                part, end = part + more, end + SLICE
                cut = len(part) if end >= len(text) else part.rfind(b" ") + 1
            part = part[:cut]
        start += len(part)
        tokens = part.split()
        n += len(tokens)
        found.update(map(vocabulary.get, tokens))
    found.pop(None, None)
    return n, found


def _index_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("ids", T.ArrayType(id_type)), T.StructField("sizes", T.BinaryType()),
                         T.StructField("lists", T.BinaryType()), T.StructField("term", T.BinaryType()),
                         T.StructField("tf", T.BinaryType()), T.StructField("docs", T.LongType()),
                         T.StructField("terms", T.LongType()), T.StructField("df_term", T.ArrayType(T.IntegerType())),
                         T.StructField("df", T.ArrayType(T.LongType()))])


def _index(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int],
           schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Blocks of documents: (ids, sizes, postings a document, term, tf) of
    those with query terms, and the counts of all."""
    def block():
        term = np.fromiter(flat, np.int32, len(flat))
        seen, df = np.unique(term, return_counts=True)
        row = [ids, np.array(sizes, np.int64).tobytes(), np.array(lists, np.int32).tobytes(), term.tobytes(),
               np.fromiter(tfs, np.int64, len(tfs)).tobytes(), docs, total, seen.tolist(), df.tolist()]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    ids, sizes, lists, flat, tfs, docs, total = [], [], [], [], [], 0, 0
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        for i, text in enumerate(texts):
            n, found = count_terms(text.as_py() or b"", vocabulary)
            if not n:
                continue
            docs, total = docs + 1, total + n
            if found:
                ids.append(batch.column(0)[i].as_py())
                sizes.append(n)
                lists.append(len(found))
                flat.extend(found.keys())
                tfs.extend(found.values())
            if len(flat) >= POSTINGS:
                yield block()
                ids, sizes, lists, flat, tfs, docs, total = [], [], [], [], [], 0, 0
    if docs:
        yield block()


class Block:
    """Posting lists of some documents (in order of their ids) with impacts
    and range-maximum tables."""

    def __init__(self, lists: np.ndarray, term: np.ndarray, tf: np.ndarray, order: np.ndarray, m: np.ndarray,
                 weights: np.ndarray):
        self.size = len(order)
        place = np.empty(self.size, np.int64)
        place[order] = np.arange(self.size)
        owner = np.repeat(np.arange(self.size), lists)
        impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[owner]))
        key = term.astype(np.int64) * self.size + place[owner]
        some = np.flatnonzero(impact > 0)
        some = some[np.argsort(key[some])]
        self.key, self.impact = key[some], impact[some]
        ends = np.flatnonzero(np.diff(self.key // max(self.size, 1), append=-1))
        longest = int(np.diff(ends, prepend=-1).max(initial=1))
        tables = [np.arange(len(some), dtype=np.int32)]
        while 2 << (len(tables) - 1) <= longest:
            before, half = tables[-1], 1 << (len(tables) - 1)
            left, right = before[:-half], before[half:]
            best = before.copy()
            best[:-half] = np.where(self.impact[left] >= self.impact[right], left, right)
            tables.append(best)
        self.tables = np.stack(tables)

    def largest(self, first: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the lists that start at key ``first`` and intervals [a, b):
        the sum of the largest impacts, and the document of the largest of
        all."""
        low = np.searchsorted(self.key, first[:, None] + a)
        high = np.searchsorted(self.key, first[:, None] + b)
        some = high > low
        level = np.frexp(np.maximum(high - low, 1))[1] - 1
        low = np.where(some, low, 0)
        left = self.tables[level, low]
        right = self.tables[level, np.where(some, high - (1 << level), 0)]
        at = np.where(self.impact[left] >= self.impact[right], left, right)
        value = np.where(some, self.impact[at], 0)
        best = at[value.argmax(0), np.arange(len(a))]
        return value.sum(0), self.key[best] % self.size

    def scores(self, first: np.ndarray, docs: np.ndarray) -> np.ndarray:
        want = first[:, None] + docs
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.impact[at], 0).sum(0)

    def search(self, item: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the best ``k`` above 0, best first."""
        docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        if not len(self.key):
            return docs, scores
        first = item.astype(np.int64) * self.size
        a, b = np.zeros(1, np.int64), np.full(1, self.size, np.int64)
        bound, split = self.largest(first, a, b)
        while True:
            if len(docs) == k:  # equal scores go by id, that is, by place
                alive = (bound > scores[-1]) | ((bound == scores[-1]) & (a < docs[-1]))
            else:
                alive = bound > 0
            a, b, bound, split = a[alive], b[alive], bound[alive], split[alive]
            if not len(a):
                return docs, scores
            order = np.argsort(-bound, kind="stable")
            now, rest = order[:STEP], order[STEP:]
            docs = np.concatenate([docs, split[now]])
            scores = np.concatenate([scores, self.scores(first, split[now])])
            best = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[best], scores[best]
            left, right = np.concatenate([a[now], split[now] + 1]), np.concatenate([split[now], b[now]])
            more = left < right
            left, right = left[more], right[more]
            bounds, splits = self.largest(first, left, right)
            a, b = np.concatenate([a[rest], left]), np.concatenate([b[rest], right])
            bound, split = np.concatenate([bound[rest], bounds]), np.concatenate([split[rest], splits])


def _normal_lengths(sizes: np.ndarray, docs: int, total: int) -> np.ndarray:
    """10 + (90 * n * docs) div total; in Python's integers where 64 bits do
    not hold the product."""
    if 90 * int(sizes.max(initial=0)) * docs < 1 << 63:
        return 10 + (90 * sizes * docs) // total
    return np.array([10 + 90 * int(n) * docs // total for n in sizes], np.int64)


def _search(batches: Iterator[pa.RecordBatch], items: list[tuple[int, np.ndarray]], weights: np.ndarray,
            docs: int, total: int, k: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(item, id, score): the best ``k`` of blocks that are merged up to
    ``POSTINGS``."""
    def best(rows):
        ids = pa.concat_arrays([r[0] for r in rows])
        sizes, lists, term, tf = (np.concatenate([np.frombuffer(r[i], t) for r in rows])
                                  for i, t in ((1, np.int64), (2, np.int32), (3, np.int32), (4, np.int64)))
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
        block = Block(lists, term, tf, order, _normal_lengths(sizes, docs, total), weights)
        found = [(key, *block.search(item, k)) for key, item in items]
        at = np.concatenate([d for _, d, _ in found]) if found else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([key for key, _, _ in found], [len(d) for _, d, _ in found]), pa.int64()),
             ids.take(pa.array(order[at])), pa.array(np.concatenate([s for _, _, s in found]), pa.int64())],
            schema=schema)

    rows, held = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            rows.append([batch.column(0).slice(i, 1).flatten(),
                         *(batch.column(c)[i].as_py() for c in range(1, 5))])
            held += len(rows[-1][3]) // 4
            if held >= POSTINGS:
                yield best(rows)
                rows, held = [], 0
    if rows:
        yield best(rows)


def _best_of_blocks(docs: DataFrame, items: list[tuple[int, list[str]]], k: int) -> DataFrame:
    """(item, id, score): the best of every block of documents for these
    items."""
    spark = docs.sparkSession
    words = sorted({w for _, ts in items for w in ts})
    number = {w: i for i, w in enumerate(words)}
    vocabulary = spark.sparkContext.broadcast({w.encode(): i for w, i in number.items()})
    id_type = docs.schema["id"].dataType
    schema = _index_schema(id_type)
    written = to_arrow_schema(schema)
    index = materialize(docs.mapInArrow(
        lambda batches: _index(batches, vocabulary.value, written), schema), "postings")
    n, total = index.agg(F.sum("docs"), F.sum("terms")).first()
    n, total = n or 0, total or 0
    weights = np.zeros(len(words), np.int64)
    for r in (index.select(F.explode(F.arrays_zip("df_term", "df")).alias("p")).groupBy("p.df_term")
              .agg(F.sum("p.df").alias("df")).collect()):  # at most the terms of these items
        weights[r["df_term"]] = math.floor(1000 * math.log((2 * n + 2) / (2 * r["df"] + 1)))
    wanted = spark.sparkContext.broadcast(
        ([(key, np.array([number[t] for t in ts], np.int32)) for key, ts in items], weights))
    out = T.StructType([T.StructField("item", T.LongType()), T.StructField("id", id_type),
                        T.StructField("score", T.LongType())])
    found = to_arrow_schema(out)
    return index.select("ids", "sizes", "lists", "term", "tf").mapInArrow(
        lambda batches: _search(batches, *wanted.value, n, total, k, found), out)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): every item's ``k`` best documents with
    a score above 0; equal scores by id."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    asked = materialize(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"),
                                     terms(F.col(item_text)).alias("terms"))
                        .where(F.size("terms") > 0), "items")
    size = F.octet_length(F.array_join("terms", " "))
    parts = -(-(asked.agg(F.sum(size)).first()[0] or 0) // ITEM_BYTES)
    best = None
    for part in range(parts):
        own = asked.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).select("item", "terms").collect()
        if not own:
            continue
        found = _best_of_blocks(docs, [(r["item"], r["terms"]) for r in own], k)
        best = found if best is None else best.union(found)
    if best is None:
        best = docs.select(F.lit(0).cast("bigint").alias("item"), "id", F.lit(0).cast("bigint").alias("score")).where("false")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return (ranked.join(asked.select("item", "item_id"), "item")
            .select(F.col("item_id").alias(item_id), "rank", F.col("id").alias(id_col), "score"))
