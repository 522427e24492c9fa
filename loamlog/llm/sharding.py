"""Sharding by balanced label propagation, in DataFrame functions only.

Documents with equal texts are linked. They start dealt out evenly and move, round by round,
towards the shard that holds most of their neighbours. Copies of one text are interchangeable,
so the label state is one row per text: how many of its copies each shard holds. Each round
joins that state with the moves the capacities allow: shard t may take from shard s what s
takes from t, plus a share of the room that documents without links leave in t. Those fill
every shard up in the end, so the law ``rows`` holds exactly: counts are at most one apart.
A text with more copies than a shard holds is cut only where a shard is full.

Null texts count as empty; they have size 1 and one group with the empty texts. Every row is
placed, repeated rows and null ids too, each with a slot of its own. Only the named columns are
read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamlog.llm.common import digest, forget, offsets_before, stored

LAW = "rows"
ROUNDS = 16
#: Rows of the state share a bucket when room is given out; it bounds a window, not a result.
_BUCKETS = 1 << 12


def _task(row: Column) -> Column:
    """The writing task in a number made by monotonically_increasing_id."""
    return F.shiftright(row, 33)


def _numbered(rows: DataFrame, name: str, group: str | None = None) -> DataFrame:
    """Adds a gapless number from 0, per group: rank within a task plus the tasks before."""
    keys = [*([group] if group else []), "__task"]
    rows = rows.withColumn("__task", _task(F.col("__row")))
    sums = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = offsets_before(sums, "__task", "__n", "__before", group).drop("__n")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("__row"))
    return (
        rows.withColumn(name, rank.cast("long") - 1)
        .join(before, keys)
        .withColumn(name, F.col(name) + F.col("__before"))
        .drop("__task", "__before")
    )


def _vector(values: list[int]) -> Column:
    return F.array(*[F.lit(int(v)) for v in values]).cast("array<bigint>")


def _wishes(state: DataFrame, room: list[int], roomy: bool, number: int) -> DataFrame:
    """``g, s, t, n``: copies in s that have more neighbours in t.

    In a ``roomy`` round only shards with room for all of them count.
    """
    shards = len(room)
    # Equal counts are ordered by a number drawn from text and round: no shard is favoured, and
    # copies that found nobody to swap with ask for the other direction in a later round.
    turn = F.pmod(F.xxhash64("g", F.lit(number)), F.lit(shards))
    score = lambda c, t: c * shards + F.pmod(turn + t, F.lit(shards))
    scored = state.withColumn("score", F.transform("held", score))
    scored = scored.select("g", "held", "score", F.posexplode_outer("held").alias("s", "n")).where("n > 0")
    own = F.element_at("score", F.col("s") + 1)
    place = F.transform(
        "score",
        lambda c, t: F.when(
            (c > own) & (F.element_at("held", t + 1) > 0)
            & (F.lit(not roomy) | (F.element_at(_vector(room), t + 1) >= F.col("n"))),
            c,
        ),
    )
    scored = scored.withColumn("place", place).withColumn("best", F.array_max("place"))
    scored = scored.where(F.col("best").isNotNull())
    return scored.select("g", "s", (F.array_position("place", F.col("best")) - 1).cast("int").alias("t"), "n")


def _quotas(wanted: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many copies may go from s to t: what comes back, and a share of the room in t."""
    swap = {(s, t): min(n, wanted.get((t, s), 0)) for (s, t), n in wanted.items()}
    rest = {k: n - swap[k] for k, n in wanted.items()}
    asked = [sum(n for (_, t), n in rest.items() if t == shard) for shard in range(len(room))]
    return {
        (s, t): swap[s, t] + (n if asked[t] <= room[t] else n * room[t] // asked[t])
        for (s, t), n in rest.items()
    }


def _granted(wishes: DataFrame, quotas: dict[tuple[int, int], int], shards: int) -> DataFrame:
    """``g, change``: per text the copies each shard gains or loses, within the quotas."""
    wishes = wishes.withColumn("lane", F.col("s") * shards + F.col("t"))
    wishes = wishes.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(_BUCKETS)))
    sums = wishes.groupBy("lane", "bucket").agg(F.sum("n").alias("sum"))
    before = offsets_before(sums, "bucket", "sum", "before", "lane").drop("sum")
    within = Window.partitionBy("lane", "bucket").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    quota = _vector([quotas.get((s, t), 0) for s in range(shards) for t in range(shards)])
    left = F.element_at(quota, F.col("lane") + 1) - F.col("before") - F.col("earlier")
    moved = (
        wishes.withColumn("earlier", F.coalesce(F.sum("n").over(within), F.lit(0)))
        .join(before, ["lane", "bucket"])
        .withColumn("moved", F.least(F.col("n"), F.greatest(F.lit(0), left)))
        .where("moved > 0")
    )
    ends = F.array(
        F.struct(F.col("s").alias("shard"), (-F.col("moved")).alias("by")),
        F.struct(F.col("t").alias("shard"), F.col("moved").alias("by")),
    )
    per_shard = [
        F.coalesce(F.sum(F.when(F.col("shard") == s, F.col("by"))), F.lit(0)) for s in range(shards)
    ]
    return moved.select("g", F.inline(ends)).groupBy("g").agg(F.array(*per_shard).alias("change"))


def _propagate(state: DataFrame, quota: list[int], rounds: int) -> tuple[DataFrame, list[int]]:
    """The final state and the documents without links that each shard takes."""
    shards = len(quota)

    def room_of(now: DataFrame) -> list[int]:
        sums = now.agg(*[F.coalesce(F.sum(F.col("held")[s]), F.lit(0)) for s in range(shards)]).first()
        return [q - n for q, n in zip(quota, sums)]

    room, roomy = room_of(state), False
    for number in range(rounds):
        wishes = _wishes(state, room, roomy, number)
        lanes = wishes.groupBy("s", "t").agg(F.sum("n").alias("n")).collect()  # at most shards squared
        quotas = _quotas({(r["s"], r["t"]): r["n"] for r in lanes}, room)
        if not any(quotas.values()):
            if roomy:
                break
            roomy = True  # the shards they wish for are full: look for the best one that is not
            continue
        roomy = False
        change = _granted(wishes, quotas, shards)
        after = state.join(change, "g", "left").select(
            "g",
            F.when(F.col("change").isNull(), F.col("held"))
            .otherwise(F.zip_with("held", "change", lambda a, b: a + b))
            .alias("held"),
        )
        after = stored(after, "labels")
        forget(state)
        state, room = after, room_of(after)
    return state, room


def _shard_at(held: Column, rank: Column) -> Column:
    """The shard whose part of the counts holds a rank."""
    found = F.aggregate(
        held,
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("shard")),
        lambda acc, n: F.struct(
            (acc["sum"] + n).alias("sum"),
            (acc["shard"] + (acc["sum"] + n <= rank).cast("int")).alias("shard"),
        ),
    )
    return found["shard"]


def shard_documents(
    documents: DataFrame,
    shards: int = 16,
    doc_id: str = "doc_id",
    text: str = "text",
    rounds: int = ROUNDS,
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, group``: one row per document row."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = documents.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        digest(F.col(text)).alias("g"),
        F.monotonically_increasing_id().alias("__row"),
    )
    rows = stored(rows, "sharding")  # the row numbers must not change between reads
    sizes = rows.groupBy("g").agg(F.count("*").alias("copies"))
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]

    dealt = rows.groupBy(_task(F.col("__row")).alias("__task")).agg(F.count("*").alias("n"))
    dealt = offsets_before(dealt, "__task", "n", "before").drop("n")
    first = F.pmod(F.col("before") + F.col("__row").bitwiseAND((1 << 33) - 1), F.lit(shards))
    linked = rows.join(sizes.where("copies > 1"), "g", "left")
    linked = stored(linked, "linked")
    started = (
        linked.where("copies is not null")
        .withColumn("__task", _task(F.col("__row")))
        .join(dealt, "__task")
        .withColumn("shard", first)
    )
    counts = [F.count(F.when(F.col("shard") == s, 1)) for s in range(shards)]
    state = stored(started.groupBy("g").agg(F.array(*counts).alias("held")), "labels")
    state, room = _propagate(state, quota, rounds)

    together = _numbered(linked.where("copies is not null"), "rank", "g").join(state, "g")
    together = together.withColumn("shard", _shard_at(F.col("held"), F.col("rank")))
    alone = _numbered(linked.where("copies is null"), "rank")
    alone = alone.withColumn("shard", _shard_at(_vector(room), F.col("rank")))
    columns = ["doc_id", "size", "text_crc32", "g", "__row", "shard"]
    placed = stored(together.select(columns).unionByName(alone.select(columns)), "placed")
    return _numbered(placed, "slot", "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lower(F.hex("g")).alias("group"),
    )
