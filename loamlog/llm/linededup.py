"""Line deduplication over overlapping windows of three lines.

Every three consecutive lines of a text are hashed to 128 bits. Of all places with the same
window, over all documents, the first one in the order (doc_id, place) stays; at every later
one the three lines are marked, and the union of the marked lines goes. Windows of blank
lines only (spaces, tabs, carriage returns) do not count, texts of one or two lines have no
window and stay as they are.

Null texts stay null. Null ids come last in the order, ties in id are ordered by the texts'
digests; rows equal in id and text count as one document and are treated alike. A text all of
whose lines go becomes empty; its row stays. A column named like an added one is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES = 3
#: A window that very many documents share is looked up in so many parts.
SALT = 16


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(doc_id: str, text: str) -> Column:
    """Stands for (id, text), also where either is null."""
    named = F.to_json(F.struct(F.col(doc_id).cast("string").alias("i")))
    return F.unhex(F.md5(F.concat(named, F.coalesce(F.col(text), F.lit(""))).cast("binary")))


def window_places(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``key, place, start, h1, h2``: one row per window; ``place`` is its rank in the order."""
    lines = documents.where(F.col(text).isNotNull()).select(
        F.col(doc_id).alias("id"), _key(doc_id, text).alias("key"), _lines(F.col(text)).alias("lines")
    )

    def window(s: Column) -> Column:
        own = F.slice("lines", s, LINES)
        full = F.exists(own, lambda line: line.rlike("[^ \t\r]"))
        return F.struct(
            s.alias("start"),
            F.when(full, F.xxhash64(own)).alias("h1"),
            F.xxhash64(F.lit(LINES), own).alias("h2"),
        )

    starts = F.sequence(F.lit(1), F.size("lines") - (LINES - 1))
    # The outer generator: the inner one would have its array computed twice, for a filter.
    windows = F.inline_outer(F.transform(F.when(F.size("lines") >= LINES, starts), window))
    found = lines.select("id", "key", windows).where(F.col("h1").isNotNull())
    place = F.struct(F.col("id").isNull().alias("last"), "id", "key", "start")
    return found.select("key", place.alias("place"), "start", "h1", "h2")


def repeated_starts(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``key, starts``: per text the windows that occur earlier somewhere."""
    places = window_places(documents, doc_id, text)
    first = places.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1").select("h1", "h2", "first")
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = places.withColumn("salt", F.pmod(F.xxhash64("key", "start"), F.lit(SALT)).cast("int"))
    # Spark takes the salted copies for as few as the windows, and would broadcast them.
    later = salted.join(first.hint("merge"), ["h1", "h2", "salt"]).where("place <> first")
    return later.groupBy("key").agg(F.collect_set("start").alias("starts"))


def dedup_lines(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the shorter text, ``n_lines`` before and ``n_removed``."""
    repeated = repeated_starts(documents, doc_id, text).toDF("__key", "__starts")
    lines = _lines(F.col(text))
    covered = F.flatten(F.transform("__starts", lambda s: F.sequence(s, s + (LINES - 1))))
    rows = documents.withColumn("__key", _key(doc_id, text)).join(repeated, "__key", "left")
    rows = rows.withColumn("__lines", lines).withColumn(
        "__kept", F.array_except(F.sequence(F.lit(1), F.size("__lines")), covered)
    )
    changed = F.col("__starts").isNotNull()
    left = F.array_join(F.transform("__kept", lambda p: F.element_at("__lines", p)), "\n")
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size("__lines")).cast("long")
    n_removed = F.when(changed, F.size("__lines") - F.size("__kept")).otherwise(0).cast("long")
    return rows.select(
        *[
            F.when(changed, left).otherwise(F.col(text)).alias(c) if c == text else F.col(f"`{c}`")
            for c in documents.columns
            if c.lower() not in ("n_lines", "n_removed")
        ],
        n_lines.alias("n_lines"),
        n_removed.alias("n_removed"),
    )
