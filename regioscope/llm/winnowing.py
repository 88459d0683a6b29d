"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are hashed, neighbouring hashes are folded into hashes of ``GRAM``-word
grams, and of each ``window - GRAM + 1`` neighbouring grams the smallest hash
is kept.  Any ``window`` equal words hold such a stretch whole, so every
shared span of at least ``window`` words shares a kept fingerprint.

Documents that share a fingerprint with some item are read again: each of
their windows is compared with the windows of the items, first by hash and
then word by word, and the hits are merged to covered words.  An item of
fewer words than the window is one window; those few lengths are looked for
directly, as winnowing guarantees nothing for them.

Null and empty texts have no words.  Documents may repeat or lack an id:
hits are attached by id and text.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regioscope.llm.scratch import materialize

GRAM = 8
#: Bytes of item fingerprints or windows (16 a row) up to which they are
#: broadcast; larger ones are joined by shuffle.
SMALL_ROWS = 500_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Lower-cased words: digits, letters and all that is not ASCII."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(low, SEPARATORS), "")


def _fold(left: Column, right: Column, skip: int, length: Column, f) -> Column:
    """f(left[i], right[i + skip]) for the first ``length`` places."""
    n = F.greatest(length, F.lit(0))
    return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(skip + 1), n), f)


def _join_hashes(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def _least(a: Column, b: Column) -> Column:
    return F.least(a, b)


def with_grams(df: DataFrame, k: int, out: str) -> DataFrame:
    """Add ``out``: hashes of the k-word grams of ``h`` (word hashes), by
    doubling the width; an array shorter than k words gives an empty one."""
    wide, powers = 1, {1: "h"}
    while wide * 2 <= k:
        name = f"_g{wide * 2}"
        before = F.col(powers[wide])
        df = df.withColumn(name, _fold(before, before, wide, F.size(before) - wide, _join_hashes))
        wide *= 2
        powers[wide] = name
    current, have = F.col(powers[wide]), wide
    df = df.withColumn(out, current)
    for p in sorted(powers, reverse=True)[1:]:
        if have + p <= k:
            df = df.withColumn(out, _fold(F.col(out), F.col(powers[p]), have,
                                          F.size("h") - (have + p - 1), _join_hashes))
            have += p
    return df.drop(*(n for n in powers.values() if n != "h"))


# Exploding goes by the outer functions: the inner ones make Spark infer a
# filter on the array, and push all of its nested definition below.
def with_fingerprints(df: DataFrame, gram: int, spans: int, out: str) -> DataFrame:
    """Add ``out``: the distinct smallest hashes of ``spans`` neighbouring
    grams."""
    df = with_grams(df, gram, "_m")
    done = 1
    while done < spans:
        step = min(done, spans - done)
        df = df.withColumn("_m", _fold(F.col("_m"), F.col("_m"), step, F.size("_m") - step, _least))
        done += step
    return df.withColumn(out, F.array_distinct("_m")).drop("_m")


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast what is counted to be small."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def item_windows(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, width, gram, window): every window of every item with its
    hash and its words; an item of fewer words is one window."""
    w = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col).cast("string")).alias("words"))
    w = _hashed(w.where(F.size("words") > 0))
    size, parts = F.least(F.size("words"), F.lit(window)), []
    for (width,) in w.select(size).distinct().collect() or [(window,)]:  # at most ``window`` lengths
        own = with_grams(w.where(size == width), width, "g")
        parts.append(own.select("item_id", F.lit(width).alias("width"), "words", F.posexplode_outer("g").alias("at", "gram"))
                     .where("gram is not null")
                     .select("item_id", "width", "gram",
                             F.slice("words", F.col("at") + 1, F.lit(width)).alias("window")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def _hits(docs: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """(id, fp, at, width, window) where a window of that width occurs."""
    wanted = _small(windows.where(F.col("width") == width).select("gram", "window").distinct())
    grams = with_grams(docs, width, "g").select(
        "id", "fp", "words", F.posexplode_outer("g").alias("at", "gram"))
    return (grams.join(wanted, "gram")
            .where(F.slice("words", F.col("at") + 1, F.lit(width)) == F.col("window"))
            .select("id", "fp", "at", F.lit(width).alias("width"), "window"))


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, id_col: str = "doc_id",
                  text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, fp, n_words, n_hit, items) of every document: words inside
    occurring windows, and the sorted ids (as strings) of their items.
    ``fp`` is the fingerprint of the text, xxhash64."""
    if window < GRAM:
        raise ValueError(f"window must be at least {GRAM}")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("fp"), text.alias("text"))
    read = base.select("id", "fp", words(F.col("text")).alias("words"))
    windows = materialize(item_windows(items, window, item_id, item_text), "item-windows")
    own = _hashed(items.select(words(F.col(item_text).cast("string")).alias("words"))
                  .where(F.size("words") >= window))
    spans = window - GRAM + 1
    prints = materialize(with_fingerprints(own, GRAM, spans, "f").select(F.explode_outer("f").alias("f")).distinct(),
                         "item-fingerprints")
    # documents with a common fingerprint, each once
    found = (with_fingerprints(_hashed(read), GRAM, spans, "f").select("id", "fp", F.explode_outer("f").alias("f"))
             .join(_small(prints), "f", "left_semi").select("id", "fp").distinct())
    found = materialize(found, "suspects")
    keys = found.select(F.col("id").alias("sid"), F.col("fp").alias("sfp"))
    suspects = _hashed(read.join(_small(keys), F.col("id").eqNullSafe(F.col("sid")) & (F.col("fp") == F.col("sfp")),
                                 "left_semi"))
    hits = _hits(suspects, windows, window)
    for (width,) in windows.where(F.col("width") < window).select("width").distinct().collect():
        hits = hits.union(_hits(_hashed(read), windows, width))
    hits = materialize(hits.distinct(), "hits")
    spans_of = hits.select("id", "fp", F.struct("at", (F.col("at") + F.col("width")).alias("end")).alias("s")) \
        .groupBy("id", "fp").agg(F.sort_array(F.collect_set("s")).alias("spans"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(s["end"] - F.greatest(s["at"], acc["end"]), F.lit(0))).alias("n"),
        F.greatest(s["end"], acc["end"]).alias("end"))
    covered = spans_of.select("id", "fp", F.aggregate("spans", zero, step)["n"].cast("long").alias("n_hit"))
    of = windows.select("window", F.col("item_id").cast("string").alias("item"))
    listed = (hits.select("id", "fp", "window").distinct().join(of, "window")
              .groupBy("id", "fp").agg(F.sort_array(F.collect_set("item")).alias("items")))
    facts = covered.join(listed, covered.id.eqNullSafe(listed.id) & (covered.fp == listed.fp), "left") \
        .select(covered.id.alias("hid"), covered.fp.alias("hfp"), "n_hit", "items")
    sizes = read.select("id", "fp", F.size("words").cast("long").alias("n_words"))
    return (sizes.join(facts, F.col("id").eqNullSafe(F.col("hid")) & (F.col("fp") == F.col("hfp")), "left")
            .select(F.col("id").alias(id_col), "fp", "n_words",
                    F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def is_contaminated() -> Column:
    """At least a twentieth of the words lies in hits."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def digests(docs: DataFrame, items: DataFrame) -> DataFrame:
    out = contamination(docs, items)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      is_contaminated().alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns kept."""
    bad = contamination(docs, items, id_col=id_col, text_col=text_col).where(is_contaminated()) \
        .select(F.col(id_col).alias("_bad_id"), F.col("fp").alias("_bad_fp")).distinct()
    fp = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    return docs.join(bad, docs[id_col].eqNullSafe(F.col("_bad_id")) & (fp == F.col("_bad_fp")), "left_anti")
