"""Line dedup over overlapping windows of three lines, or fewer that hold a long passage.

Lines are split at newlines; lines without a word are neither hashed nor removed. A window is three
consecutive lines with words, trimmed; a document with one or two such lines is one window. One or two
consecutive lines that hold over PASSAGE_WORDS words are a window too. Of the
windows with the same content the one with the smallest (doc_id, text hash, place) stays (null ids
first); the lines that any later one covers are removed. Rows that agree in id and text are one
document and get the same result. Null text stays null and has no windows; texts of any length are read
whole. Columns of the documents may have any names but those of the two numbers that are added.

Per key there is one counted row after map-side aggregation, so a passage shared by a third of all
documents is a join against a single row, which adaptive execution may split; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, exact, free_name, stored, words_of

WINDOW = 3
PASSAGE_WORDS = 50


def _bare(line: Column) -> Column:
    """A line without white space at its ends; only lines that have some go through the slow trim."""
    edge = F.lit(False)
    for c in SPACE_CHARS.replace("\n", ""):
        edge = edge | line.startswith(c) | line.endswith(c)
    return F.when(edge, F.btrim(line, F.lit(SPACE_CHARS))).otherwise(line)


def _with_lines(docs: DataFrame, text: Column, lines: str, bare: str, at: str) -> DataFrame:
    """Adds all lines, the same trimmed, and the places of those with words, under the names given."""
    docs = docs.withColumn(lines, F.split(F.coalesce(text, F.lit("")), "\n"))
    docs = docs.withColumn(bare, F.transform(lines, _bare))
    places = F.transform(F.col(bare), lambda x, i: F.when(x != "", i))
    return docs.withColumn(at, F.array_compact(places))


def _keys(lines: Column, n: int) -> Column:
    """struct(line, n, key) of the windows of n lines, null where one shorter than WINDOW is neither a passage nor its whole document."""

    def key(i: Column) -> Column:
        window = F.slice(lines, i + 1, n)
        found = F.struct(i.alias("line"), F.lit(n).alias("n"), F.md5(F.array_join(window, "\n")).alias("key"))
        if n == WINDOW:
            return found
        chars = F.aggregate(window, F.lit(0), lambda a, x: a + F.length(x))
        long = (chars >= 2 * PASSAGE_WORDS) & (F.size(words_of(F.array_join(window, "\n"))) > PASSAGE_WORDS)
        return F.when((F.size(lines) == n) | long, found)

    none = F.array().cast("array<struct<line:int,n:int,key:string>>")
    return F.when(F.size(lines) >= n, F.transform(F.sequence(F.lit(0), F.size(lines) - n), key)).otherwise(none)


def window_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, place, key): one row per window; place is its first line and how many, key the MD5 of the lines."""
    rows = docs.select(exact(id_col), exact(text_col)).toDF("id", "text")
    rows = _with_lines(rows, F.col("text"), "lines", "bare", "at")
    rows = rows.select("id", F.xxhash64("text").alias("th"), F.array_remove("bare", "").alias("lines"))
    keys = F.concat(*(_keys(F.col("lines"), n) for n in range(1, WINDOW + 1)))
    # the outer explode and the filter after it keep the optimizer from computing the keys once more to test for rows
    rows = rows.select("id", "th", F.explode_outer(keys).alias("w")).filter(F.col("w.key").isNotNull())
    return rows.select("id", "th", F.struct("w.line", "w.n").alias("place"), F.unhex("w.key").alias("key"))


def later_windows(windows: DataFrame) -> DataFrame:
    """(id, th, places): the windows of a document whose content stands earlier elsewhere."""
    at = F.struct("id", "th", "place")
    firsts = windows.groupBy("key").agg(F.min(at).alias("first"), F.max(at).alias("last")).filter("first < last")
    firsts = firsts.select("key", "first")
    later = windows.join(firsts, "key").filter(~at.eqNullSafe(F.col("first")))
    return later.groupBy("id", "th").agg(F.collect_set("place").alias("places"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_lines: str | None = None, n_removed: str | None = None) -> DataFrame:
    """The documents with their columns, the text without repeated lines, and the numbers of lines and of removed ones.

    Repeated lines include their newline; the lines that stay are joined by newlines as before. The numbers are the last two
    columns, by default __n_lines and __n_removed, or such with underscores behind where the documents have columns of these names.
    """
    n_lines, n_removed = n_lines or free_name(docs, "__n_lines"), n_removed or free_name(docs, "__n_removed")
    later = later_windows(stored(window_rows(docs, id_col, text_col)))
    own = ("h", "id", "th", "places", "lines", "bare", "at", "gone")
    h, id_, th, places, lines, bare, at, gone = (free_name(docs, f"__{x}") for x in own)
    later = later.select(F.col("id").alias(id_), F.col("th").alias(th), F.col("places").alias(places))
    rows = docs.withColumn(h, F.xxhash64(exact(text_col)))
    rows = rows.join(later, exact(id_col).eqNullSafe(F.col(id_)) & (F.col(h) == F.col(th)), "left")
    rows = _with_lines(rows, exact(text_col), lines, bare, at)
    lost = F.flatten(F.transform(F.col(places), lambda p: F.slice(F.col(at), p["line"] + 1, p["n"])))
    rows = rows.withColumn(gone, F.array_distinct(F.coalesce(lost, F.array().cast("array<int>"))))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    text = F.when(F.size(gone) == 0, exact(text_col)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col(lines), i)), "\n"))
    kept = [exact(c) if c != text_col else text.alias(c) for c in docs.columns]
    return rows.select(*kept, F.size(at).cast("long").alias(n_lines), F.size(gone).cast("long").alias(n_removed))
