"""Benchmark decontamination by winnowing, in DataFrame functions only.

From every ten consecutive words the smallest hash of its six five-word runs is kept (the
leftmost if several are equal). Two texts that share ten words in a row therefore keep the
same run at the same place of the shared span: no shared span is missed, at two kept hashes
for every seven words. Kept hashes of the documents are joined with those of the items; each
hit is extended to the windows of ten words that hold it, and these are compared as words.
Items of fewer than ten words are one window each and are looked up by their whole run.

Nulls, empty texts and texts without words have no windows and are never hit. Rows are
judged by their text alone, so repeated rows and null ids each keep their row and get the
result of their text. An empty benchmark hits nothing. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamlog.llm.common import ascii_lower, digest, other_columns, stored

WINDOW = 10
RUN = 5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Kept hashes of the items (8 bytes each) up to which they are sent to every executor;
#: above it the join shuffles both sides.
BROADCAST_HASHES = 1_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def _runs(words: Column, length: int, size: Column) -> Column:
    places = F.when(size >= length, F.sequence(F.lit(1), size - (length - 1)))
    return F.transform(places, lambda i: F.xxhash64(F.slice(words, i, length)))


def _every_run(length: int, size: Column) -> Column:
    """(place, length, hash) of all runs of a short item's length."""
    return F.transform(
        _runs(F.col("words"), length, size),
        lambda h, i: F.struct(
            (i + 1).alias("place"), F.lit(length).alias("length"), h.alias("hash")
        ),
    )


def _with_kept(frame: DataFrame, short_lengths: list[int]) -> DataFrame:
    """Adds ``kept``: array of (place, length of the window looked for, hash).

    The arrays are unnested with the outer generators only: for the inner ones the optimizer
    adds a filter on the array's size, copies the array's expression into it and so computes
    ``runs`` anew for each element.
    """
    size = F.size("words")
    frame = frame.withColumn("runs", _runs(F.col("words"), RUN, size))
    span = WINDOW - RUN + 1
    smallest = F.when(
        size >= WINDOW,
        F.transform(
            F.sequence(F.lit(1), size - (WINDOW - 1)),
            lambda i: i - 1
            + F.array_position(
                F.slice("runs", i, span), F.array_min(F.slice("runs", i, span))
            ).cast("int"),
        ),
    )
    kept = [
        F.transform(
            F.array_distinct(smallest),
            lambda p: F.struct(
                p.alias("place"), F.lit(WINDOW).alias("length"), F.element_at("runs", p).alias("hash")
            ),
        )
    ]
    for length in short_lengths:
        kept.append(_every_run(length, size))
    none = F.array().cast("array<struct<place:int,length:int,hash:bigint>>")
    return frame.withColumn("kept", F.concat(*[F.coalesce(k, none) for k in kept]))


def _windows(words: Column, first: Column, last: Column, length) -> Column:
    """(place, words) of the windows that start between two places."""
    return F.transform(
        F.sequence(first, last),
        lambda s: F.struct(s.alias("start"), F.array_join(F.slice(words, s, length), " ").alias("window")),
    )


def _item_windows(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("words"))
    size = F.size("words")
    return items.where(size > 0).withColumn("length", F.least(F.lit(WINDOW), size))


def contaminated_spans(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``key, start, length, item``: every window of an item in every distinct text.

    ``key`` is the digest of the text, ``start`` counts its words from 1.
    """
    items = _item_windows(benchmark, item_id, item_text)
    short = sorted(r[0] for r in items.where(F.col("length") < WINDOW).select("length").distinct().collect())
    item_hashes = (
        _with_kept(items, short)
        .select("item", F.size("words").alias("size"), F.inline_outer("kept"))
        .where((F.col("length") == WINDOW) | (F.col("length") == F.col("size")))
        .select("length", "hash")
        .distinct()
    )
    texts = documents.select(digest(F.col(text)).alias("key"), words_of(F.col(text)).alias("words"))
    kept = _with_kept(texts, short).select("key", "words", F.inline_outer("kept"))
    few = item_hashes.count() <= BROADCAST_HASHES
    if few:
        found = kept.join(F.broadcast(item_hashes), ["length", "hash"], "left_semi")
    else:
        # The words stay behind: they would go through the shuffle once per kept hash.
        # Spark takes the hashes for as few as the items, and would broadcast them; the windows, too.
        hits = kept.drop("words").join(item_hashes.hint("merge"), ["length", "hash"], "left_semi")
        hits = hits.groupBy("key").agg(F.collect_set(F.struct("place", "length")).alias("hits"))
        found = texts.join(hits, "key").select("key", "words", F.inline_outer("hits"))
    first = F.when(F.col("length") == WINDOW, F.greatest(F.lit(1), F.col("place") - (WINDOW - RUN)))
    first = F.coalesce(first, F.col("place"))
    last = F.least(F.col("place"), F.size("words") - F.col("length") + 1)
    candidates = (
        found.select("key", "length", F.inline_outer(_windows(F.col("words"), first, last, F.col("length"))))
        .distinct()
    )
    places = F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)
    item_windows = items.select(
        "item",
        "length",
        F.explode_outer(
            F.transform(places, lambda s: F.array_join(F.slice("words", s, F.col("length")), " "))
        ).alias("window"),
    ).distinct()
    if not few:
        item_windows = item_windows.hint("merge")
    return candidates.join(item_windows, ["length", "window"]).select("key", "start", "length", "item")


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The documents with ``n_words, n_hit, items`` added.

    ``items`` is the sorted array of the ids (as text) that occur, ``n_hit`` the number of
    words inside any of their windows.
    """
    spans = contaminated_spans(documents, benchmark, text, item_id, item_text)
    places = spans.groupBy("key", "start").agg(F.max("length").alias("length"))
    covered = F.aggregate(
        F.array_sort(F.collect_list(F.struct("start", "length"))),
        F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("end")),
        lambda acc, x: F.struct(
            (
                acc["hit"]
                + F.greatest(
                    F.lit(0), x["start"] + x["length"] - 1 - F.greatest(acc["end"], x["start"] - 1)
                )
            ).alias("hit"),
            F.greatest(acc["end"], x["start"] + x["length"] - 1).alias("end"),
        ),
        lambda acc: acc["hit"],
    )
    hits = places.groupBy("key").agg(covered.alias("__n_hit"))
    items = spans.select("key", "item").distinct().groupBy("key")
    items = items.agg(F.array_sort(F.collect_list("item")).alias("__items"))
    # A table, so that the join below has plain sides and can split a text with many copies.
    hits = stored(hits.join(items, "key").withColumnRenamed("key", "__key"), "hits")
    rows = documents.select(
        "*",
        digest(F.col(text)).alias("__key"),
        F.size(words_of(F.col(text))).cast("long").alias("__n_words"),
    )
    return rows.join(hits, "__key", "left").select(
        *other_columns(documents, "n_words", "n_hit", "items"),
        F.col("__n_words").alias("n_words"),
        F.coalesce("__n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("__items", F.array().cast("array<string>")).alias("items"),
    )
