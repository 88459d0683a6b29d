"""Line-first quality rules, in DataFrame functions only.

Every line of a document is judged by itself:

* punctuation: it ends in a sentence mark (closing quotes and brackets may
  follow), and symbols are at most a tenth of its characters;
* navigation: it is no list of links, that is, it has fewer than two
  separators or fewer than one for five words;
* boilerplate: a short line holds none of the notices of ``NOTICES``.

Lines that fail are removed.  A document that loses more than ``most_lost``
percent of its word characters that way is rejected; so is one that fails the
base rules (too few words, or most words inside repeated runs of three).

All of it is one projection of the row: nothing is shuffled, so neither hot
sources nor copies matter.  Repeated three-word runs are found by sorting
hashes of the runs within the row and compared word by word after that, in
time n log n.

Null and empty texts have no words and fail.  Rows that repeat or lack an id
are judged one by one.  Only the id and the text are read, so other columns
may bear any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: A sentence mark, closing quotes or brackets, white space, the end.
SENTENCE_END = "[.!?:;…。！？][\"'“”’»)\\]]*[\\x20\\x09-\\x0D]*\\z"
SEPARATORS = "[|›»·•→>]"
NOTICES = (r"(?i)all rights reserved|copyright|©|privacy policy|terms of (use|service)|cookie|javascript"
           r"|lorem ipsum|sign (in|up)|log ?in|subscribe|newsletter|click here|skip to|read more")
#: A notice makes lines of up to this many words fail; longer ones are prose.
NOTICE_WORDS = 20
AT_MOST_NOTICE_WORDS = rf"\A(?:{SPACES})?+(?:{HAS_WORD}++(?:{SPACES}|\z)){{0,{NOTICE_WORDS}}}+\z"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often and
    however deep inside other functions ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def _word_chars(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, SPACES, ""))


def repeated_run_words(w: Column) -> Column:
    """How many of the words ``w`` lie in three-word runs that occur twice or
    more, first occurrences included."""
    prefix = F.lit(-1 << 32)

    def same_hash(a: Column, b: Column) -> Column:
        return F.coalesce(a.bitwiseAND(prefix) == b.bitwiseAND(prefix), F.lit(False))

    def same_run(a: Column, b: Column) -> Column:
        return F.coalesce((a["x"] == b["x"]) & (a["y"] == b["y"]) & (a["z"] == b["z"]), F.lit(False))

    def neighbour(rows: Column, same) -> Column:
        """Those of the sorted ``rows`` that equal the one before or after."""
        return F.filter(rows, lambda x, k: same(x, F.get(rows, k + 1)) | same(x, F.get(rows, k - 1)))

    # the upper half of a run's hash, the lower half is its place
    keys = F.sort_array(F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(prefix)
        .bitwiseOR(i.cast("long"))))
    maybe = _let(keys, lambda p: F.transform(neighbour(p, same_hash),
                                             lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")))
    runs = F.sort_array(F.transform(maybe, lambda i: F.struct(
        F.get(w, i).alias("x"), F.get(w, i + 1).alias("y"), F.get(w, i + 2).alias("z"), i.alias("at"))))
    places = F.sort_array(F.transform(_let(runs, lambda r: neighbour(r, same_run)), lambda r: r["at"]))
    covered = _let(places, lambda p: F.aggregate(
        F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.least(F.lit(3), b - a)),  # the last: 3
        F.lit(0), lambda n, x: n + x))
    return F.when(F.size(w) >= 3, covered).otherwise(0)


def line_fails(line: Column) -> Column:
    """Does a line with words break one of the rules?  Costly parts stand
    last: they are looked at only where the others leave it open."""
    symbols, seps = F.regexp_count(line, F.lit(SYMBOLS)), F.regexp_count(line, F.lit(SEPARATORS))
    ends = line.rlike(SENTENCE_END) & ((symbols == 0) | (10 * symbols <= _word_chars(line)))
    navigation = (seps >= 2) & (5 * seps >= F.size(words(line)))
    notice = line.rlike(AT_MOST_NOTICE_WORDS) & line.rlike(NOTICES)
    return ~ends | navigation | notice


def judge(docs: DataFrame, min_words: int = 50, most_repeated: int = 50, most_lost: int = 50,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, clean_text, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_lines, n_failed_lines, lost_chars, base_failed, kept) of
    every row; percentages are integers."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))

    def facts(line: Column) -> Column:
        filled = line.rlike(HAS_WORD)
        return F.struct(line.alias("line"), filled.alias("filled"), (filled & line_fails(line)).alias("fails"))

    def of_lines(lines: Column) -> Column:
        filled = F.transform(F.filter(lines, lambda x: x["filled"]), lambda x: x["line"])
        failed = F.transform(F.filter(lines, lambda x: x["fails"]), lambda x: x["line"])
        good = F.transform(F.filter(lines, lambda x: ~x["fails"]), lambda x: x["line"])
        return F.struct(
            F.size(filled).alias("n_lines"),
            _let(filled, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
            F.size(failed).alias("n_failed_lines"),
            F.aggregate(failed, F.lit(0), lambda n, x: n + _word_chars(x)).alias("lost_chars"),
            F.array_join(good, "\n").alias("clean_text"))

    of_words = _let(words(F.col("text")), lambda w: F.struct(
        F.size(w).alias("n_words"), repeated_run_words(w).alias("n_repeat_words")))
    rows = rows.select(
        "id", _word_chars(F.col("text")).alias("word_chars"), F.regexp_count("text", F.lit(SYMBOLS)).alias("n_symbols"),
        of_words.alias("w"), _let(F.transform(F.split("text", "\n"), facts), of_lines).alias("l"))
    long = {c: F.col(c).cast("long") for c in ("w.n_words", "word_chars", "n_symbols", "l.n_dup_lines",
                                               "w.n_repeat_words", "l.n_lines", "l.n_failed_lines", "l.lost_chars")}
    rows = rows.select("id", F.col("l.clean_text").alias("clean_text"),
                       *(v.alias(c.split(".")[-1]) for c, v in long.items()))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    lost = 100 * F.col("lost_chars") > most_lost * F.col("word_chars")
    return rows.select(F.col("id").alias(id_col), *rows.columns[1:], failed.alias("base_failed"),
                       (~failed & ~lost).alias("kept"))
