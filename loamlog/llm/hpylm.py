"""LM scoring with a hierarchical Pitman-Yor bigram model.

Every context (the word before, or the text's begin) has a Chinese restaurant whose customers
are the words that followed it. A table serves one word; opening a table sends a customer to
the parent restaurant that all contexts share, whose own tables draw evenly from the vocabulary
and one unknown word. Seating is sampled by Gibbs: all customers of a word in a restaurant are
seated anew at once, their number of tables t drawn with weight S(c, t) (d x p)^t, where S sums
the seatings of c customers at t tables (exact to 1 024 customers, a corrected saddle point
above), p is the parent's probability and x ~ Gamma(theta / d + T) stands for the restaurant's
tables T, so that its words are drawn side by side. The probabilities

    P(w | u) = (c_uw - d t_uw + (theta + d T_u) P(w)) / (theta + c_u)

are averaged over the samples after burn-in, which starts at the fixed point of the means.

Distribution. Texts are cut into blocks, whose entries are dealt by context into buckets of
about ``bucket_tokens`` tokens. A context with an eighth of a bucket or more is dealt by
context and word: its mean tables are found between the visits, by rounds in which the buckets
send their sums of means and the driver answers with the context's x. The buckets are visited twice: the
first visit gets the counts of (context, word) pairs, seats the context restaurants with a local
guess of the parent and sends each word's tables to the shared parent, which is seated by word
and answered to the buckets that have the word; the second visit gets the pairs of each
document, seats the other contexts again under that parent and scores. Texts are read for each visit, which costs
less disk than keeping what the second one needs. Words are 64-bit hashes. Nothing
the size of the vocabulary is held in one place.

Null texts count as empty, and an empty text has the end token alone. A null id is learned
from. Every row is scored, repeated rows too, and each counts in training. Without training
texts every token has the base's probability. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamlog.llm.common import forget, give_back, stored

BEGIN, END = np.uint64(0), np.uint64(1)  # hashes that stand for the text's begin and end
BUCKET_TOKENS = 3_000_000
BURN_IN, SAMPLES, STEPS, HOT_ROUNDS = 3, 4, 6, 8
THETA = 1.0
_SLAB = 6_000_000  # characters of a block; about 40 times as many bytes are in use meanwhile


# ---- seating ---------------------------------------------------------------------------

_EXACT, _POINTS = 1024, 64


def _log_factorial(t: np.ndarray) -> np.ndarray:
    x = np.asarray(t, float) + 1
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def _tilt(ratio: np.ndarray, discount: float, power: float) -> np.ndarray:
    """log e where (1 - e) e^(d-1) / (1 - e^d)^power is the ratio; the left side falls with e."""

    def left(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Its log and the slope of that; without a power the second factor is left out."""
        z = -np.expm1(y)
        log, slope = np.log(z) + (discount - 1) * y, -np.exp(y) / z + (discount - 1)
        if power:
            full = -np.expm1(discount * y)
            log -= power * np.log(full)
            slope += power * discount * np.exp(discount * y) / full
        return log, slope

    grid = -np.geomspace(1e-9, 40 / (1 - discount), 8192)
    asked = np.log(ratio)
    y = np.interp(asked, left(grid)[0], grid)
    for _ in range(2):
        log, slope = left(y)
        step = (log - asked) / np.where(slope < -1e-12, slope, -np.inf)
        y = np.clip(y - step, 2 * y, y / 2)
    return y


def _saddle(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """log S(c, t) but for a term of c alone: the chance that t table sizes sum to c."""
    t = np.minimum(t, c - 1.0)
    y = _tilt(c / t / discount, discount, 1.0)
    e, full = np.exp(y), -np.expm1(discount * y)
    spread = c * (1 - c / t) + c * -np.expm1(y) * (1 - discount) / e
    chance = t * np.log(full) - c * np.log(-np.expm1(y)) - 0.5 * np.log(np.maximum(spread, 0.1))
    return chance - _log_factorial(t) - t * np.log(discount)


def _ways(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """log S(c, t) but for a term of c alone, S being the weight of all ways to t tables.

    S(c + 1, t) = S(c, t - 1) + (c - d t) S(c, t) up to ``_EXACT`` customers. Above, a saddle
    point, with the error it has at ``_EXACT`` customers and the same t / c^d.
    """
    most = int(min(c.max(initial=1), _EXACT))
    rows = np.full((most + 1, most + 1), -np.inf)
    rows[1, 1] = 0.0
    for n in range(1, most):
        own = rows[n, 1 : n + 1] + np.log(n - discount * np.arange(1, n + 1))
        rows[n + 1, 1 : n + 1] = np.logaddexp(own, rows[n, :n])
        rows[n + 1, n + 1] = 0.0
    out = rows[np.minimum(c, most), np.minimum(t, most)]
    above = np.flatnonzero(c > most)
    if len(above):
        known = np.arange(1, most // 2)
        error = rows[most, known] - _saddle(np.full(len(known), float(most)), known, discount)
        error -= error[-1]
        at = np.log(t[above]) + discount * np.log(most / c[above])
        # Few tables among very many customers: S falls like t S(c, 1), known exactly.
        slope = 1 - 0.5 / (1 - discount)
        out[above] = _saddle(c[above].astype(float), t[above], discount)
        out[above] += np.interp(at, np.log(known), error) + slope * np.minimum(at, 0)
    return out


class _Pairs:
    """Tables of (restaurant, word) pairs, given x, which makes the pairs independent.

    The rising product (theta + d T)... of a restaurant is a mean of x^T over x ~ Gamma(theta /
    d + T). Given x, a pair has t tables with weight S(c, t) (d x p)^t: all customers are seated
    anew at once. Up to ``_POINTS`` numbers of tables are weighed per pair, each standing for a
    section of numbers where there are more (a quarter of a standard deviation wide).
    """

    def __init__(self, c: np.ndarray, p: np.ndarray, x: np.ndarray, discount: float):
        self.p = p
        near, spread = self.guess(c, x * p, discount)
        reach = 8 * np.sqrt(1 + spread + spread**2 / x) + 8
        low = np.where(c <= _POINTS, 1, np.maximum(1, np.floor(near - reach))).astype(np.int64)
        high = np.where(c <= _POINTS, c, np.minimum(c, np.ceil(near + reach))).astype(np.int64)
        low = np.minimum(low, high)
        self.step = -(-(high - low + 1) // _POINTS)
        n = -(-(high - low + 1) // self.step)
        self.ends = np.cumsum(n)
        self.at = self.ends - n
        self.pair = np.repeat(np.arange(len(c)), n)
        self.low = low[self.pair] + (np.arange(len(self.pair)) - self.at[self.pair]) * self.step[self.pair]
        self.high = np.minimum(self.low + self.step[self.pair] - 1, high[self.pair])
        self.t = (self.low + self.high) // 2
        self.ways = _ways(c[self.pair], self.t, discount) + self.t * np.log(discount)
        self.ways += np.log(self.high - self.low + 1)

    @staticmethod
    def guess(c: np.ndarray, a: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
        """About the mean and the variance of the tables of c customers, with a = x p."""
        y = _tilt(np.maximum(c / (a * discount), 1e-9), discount, 0.0)
        e, z, full = np.exp(y), -np.expm1(y), -np.expm1(discount * y)
        mean = a * full
        spread = mean * np.clip(1 - discount * e ** (discount - 1) / full / (1 / z + (1 - discount) / e), 0, 1)
        return np.clip(mean + 1, 1, c), spread

    def _weights(self, x: np.ndarray) -> np.ndarray:
        found = self.ways + self.t * np.log(x * self.p)[self.pair]
        found -= np.maximum.reduceat(found, self.at)[self.pair]
        return np.exp(found, out=found)

    def moments(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and variance of each pair's tables."""
        weights = self._weights(x)
        total = np.add.reduceat(weights, self.at)
        mean = np.add.reduceat(weights * self.t, self.at) / total
        weights *= (self.t - mean[self.pair]) ** 2
        return mean, np.add.reduceat(weights, self.at) / total

    def draw(self, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        upto = np.cumsum(self._weights(x))
        before = np.where(self.at > 0, upto[self.at - 1], 0.0)
        drawn = before + rng.random(len(self.at)) * (upto[self.ends - 1] - before)
        point = np.clip(np.searchsorted(upto, drawn, "right"), self.at, self.ends - 1)
        return rng.integers(self.low[point], self.high[point] + 1)


def seat(
    customers: np.ndarray,
    place: np.ndarray,
    parent: np.ndarray,
    discount: float,
    theta: float,
    rng: np.random.Generator,
    scale: np.ndarray | float = 1.0,
    burn_in: int = BURN_IN,
    samples: int = SAMPLES,
) -> tuple[np.ndarray, np.ndarray]:
    """Mean tables of each (restaurant, word), and the last sample.

    ``place`` is the restaurant's number and ``parent`` the word's probability there. A
    restaurant spread over buckets has ``scale`` times the tables seen here.
    """
    tables, last = np.ones(len(customers)), np.ones(len(customers), np.int64)
    often = np.flatnonzero(customers > 1)  # a single customer has a table to itself
    if not len(often):
        return tables, last
    houses = int(place.max()) + 1
    alone = np.bincount(place[customers == 1], minlength=houses)
    c, house, p = customers[often], place[often], parent[often]
    shape = theta / discount

    def totals(t: np.ndarray) -> np.ndarray:
        return (alone + np.bincount(house, t, houses)) * scale

    def nearer(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
        """Newton's step to the x that its own mean tables give."""
        slope = np.minimum(np.bincount(house, spread, houses) * scale / x, 0.95)
        return np.maximum(x + (shape + totals(mean) - x) / (1 - slope), shape)

    # Begin at the fixed point of the mean tables.
    x = shape + totals(c)
    for _ in range(STEPS):
        x = nearer(x, *_Pairs.guess(c, x[house] * p, discount))
    pairs = _Pairs(c, p, x[house], discount)
    for _ in range(STEPS):
        x = nearer(x, *pairs.moments(x[house]))
    t = pairs.moments(x[house])[0]
    mean = np.zeros(len(c))
    for sweep in range(burn_in + samples):
        x = rng.gamma(shape + totals(t))
        t = pairs.draw(x[house], rng)
        if sweep >= burn_in:
            mean += t / samples
    tables[often], last[often] = mean, t
    return tables, last


def discount_of(ones: float, twos: float) -> float:
    """The usual estimate from how many counts are one and two."""
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones + twos else 0.5


# ---- blocks ----------------------------------------------------------------------------


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, first bytes of all numbers first."""
    parts = [np.array([len(a) for a in arrays], "<u8").tobytes()]
    parts += [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"" for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _expand(body: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    head = 8 * len(kinds)
    found, at = [], head
    for n, kind in zip(raw[:head].view("<u8"), kinds):
        n, width = int(n), np.dtype(kind).itemsize
        planes = raw[at : at + n * width].reshape(width, n)
        found.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * width
    return found


def _words(texts: list[str | None] | pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words with A-Z in lower case, and the texts' words as places there with their
    number in each text. One more of the distinct words, the empty one, may have no place."""
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    found = split.flatten().dictionary_encode()
    places, ends = found.indices.to_numpy(), split.offsets.to_numpy()
    some = np.ones(len(places), bool)
    blank = found.dictionary.index("").as_py()
    if blank >= 0:  # white space around a text sets off empty words
        some = places != blank
    upto = np.append(0, np.cumsum(some))[ends - ends[0]]
    return found.dictionary, places[some], np.diff(upto)


def _hash(word: bytes) -> int:
    return max(2, xxhash.xxh64_intdigest(word))


def _hashes(words: pa.Array) -> np.ndarray:
    """``_hash`` of each word, straight from the array's bytes."""
    _, ends, body = words.buffers()
    ends = np.frombuffer(ends, "<i4")[words.offset : words.offset + len(words) + 1].tolist()
    body = body.to_pybytes() if body else b""
    found = map(xxhash.xxh64_intdigest, map(body.__getitem__, map(slice, ends, ends[1:])))
    return np.maximum(np.fromiter(found, np.uint64, len(words)), np.uint64(2))


def _mixed(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = (u ^ (w * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


def _slabs(texts: pa.Array) -> Iterator[slice]:
    low, size = 0, 0
    for i, long in enumerate(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
        if size and size + long > _SLAB:
            yield slice(low, i)
            low, size = i, 0
        size += long + 1
    if low < len(texts):
        yield slice(low, len(texts))


def _sorted(columns: list[np.ndarray], most: list[int]) -> list[np.ndarray]:
    """The columns sorted by the first, the second and so on; ``most`` are bounds of their numbers.

    They are sorted as one number where their bits fit, which costs a third of an order.
    """
    width = [max(1, int(m) - 1).bit_length() for m in most]
    if sum(width) > 62:
        order = np.lexsort(columns[::-1])
        return [c[order] for c in columns]
    key = columns[0].astype(np.int64)
    for column, bits in zip(columns[1:], width[1:]):
        key <<= bits
        key |= column
    key.sort()
    found = []
    for bits in width[:0:-1]:
        found.append(key & ((1 << bits) - 1))
        key >>= bits
    return [key, *found[::-1]]


def _distinct(arrays: list[np.ndarray]) -> np.ndarray:
    found = np.sort(np.concatenate(arrays))
    return found[np.append(True, found[1:] != found[:-1])[: len(found)]]


def _entries(texts: list[str | None] | pa.Array, hot: np.ndarray, buckets: int, held: np.ndarray | None):
    """Per bucket: contexts, their entries, words (hashes), words' numbers, and a last column.

    An entry is a token with its document's number; or, if ``held`` flags are given, a distinct
    pair with its count in the documents they leave. Words are numbered by hash, entries sorted
    by context and word, and within a context only the steps of the numbers are kept.
    """
    known, places, sizes = _words(texts)
    hashes = _hashes(known)
    order = np.argsort(hashes)
    rank = np.empty(len(known), np.int64)
    rank[order] = np.arange(2, len(known) + 2)
    hashes = np.concatenate([[BEGIN, END], hashes[order]])
    sizes = sizes + 1
    ends = np.cumsum(sizes)
    total = int(ends[-1])
    inner = np.ones(total, bool)
    inner[ends - 1] = False
    word = np.ones(total, np.int64)
    word[inner] = rank[places]
    context = np.empty(total, np.int64)
    context[1:] = word[:-1]
    context[ends - sizes] = 0
    last = np.repeat(np.arange(len(texts)), sizes)
    if held is not None:
        last = held[last].astype(np.int64)
    del known, places, inner
    bucket = ((hashes >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)[context]
    many = np.flatnonzero(np.isin(hashes, hot)[context])
    mixed = _mixed(hashes[context[many]], hashes[word[many]])
    bucket[many] = (mixed % np.uint64(buckets)).astype(np.int64)
    most = [buckets, len(hashes), len(hashes), len(texts) if held is None else 2]
    bucket, context, word, last = _sorted([bucket, context, word, last], most)
    if held is not None:
        new = (np.diff(context, prepend=-1) != 0) | (np.diff(word, prepend=-1) != 0)
        pairs = np.flatnonzero(new | (np.diff(bucket, prepend=-1) != 0))
        last = np.add.reduceat(1 - last, pairs)
        context, word, bucket = context[pairs], word[pairs], bucket[pairs]
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    number_of, here = np.empty(len(hashes), np.int64), np.zeros(len(hashes), bool)
    for b in range(buckets):
        part = slice(cuts[b], cuts[b + 1])
        starts = np.flatnonzero(np.diff(context[part], prepend=-1))
        counts = np.diff(np.append(starts, cuts[b + 1] - cuts[b])).astype("<u4")
        here[word[part]] = True
        used = np.flatnonzero(here)
        here[used] = False
        number_of[used] = np.arange(len(used))
        number = number_of[word[part]]
        steps = np.diff(number, prepend=0)
        steps[starts] = number[starts]
        own = hashes[context[part][starts]]
        yield b, own, counts, hashes[used], steps.astype("<u4"), last[part].astype("<u4")


def _numbers_of(steps: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The words' numbers from their steps within each context."""
    upto = np.cumsum(steps.astype(np.int64))
    starts = np.cumsum(counts.astype(np.int64)) - counts
    return upto - np.repeat(upto[starts] - steps[starts], counts)


_BLOCK_KINDS = ("<u8", "<u4", "<u8", "<u4", "<u4")


def _blocks(rows: DataFrame, hot: np.ndarray, buckets: int, pairs: bool) -> DataFrame:
    """``bucket, block, doc_ids, docs, held, body``; one bucket per block carries the ids."""
    shared = rows.sparkSession.sparkContext.broadcast(hot)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for batch in found:
            kind = batch.schema.field("id").type
            texts = batch.column("text")
            for slab in _slabs(texts):
                n = slab.stop - slab.start
                flags = batch.column("held").slice(slab.start, n).to_numpy(zero_copy_only=False)
                counted = flags.astype(bool) if pairs else None
                flags = np.packbits(flags.astype(np.uint8)).tobytes()
                ids = batch.column("id").slice(slab.start, n).to_pylist()
                home = block % buckets
                out = [
                    (b, block, ids if b == home else None, n, flags, _squeeze(*arrays))
                    for b, *arrays in _entries(texts.slice(slab.start, n), shared.value, buckets, counted)
                    if b == home or len(arrays[-1])
                ]
                kinds = [pa.int32(), pa.int64(), pa.list_(kind), pa.int32(), pa.binary(), pa.binary()]
                for row in out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v], k) for v, k in zip(row, kinds)],
                        ["bucket", "block", "doc_ids", "docs", "held", "body"],
                    )
                block += 1
        give_back()

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        batches, f"bucket int, block long, doc_ids array<{kind}>, docs int, held binary, body binary"
    )


@dataclass
class _Bucket:
    """A bucket's entries: distinct contexts and words (hashes), pairs and training counts."""

    contexts: np.ndarray
    words: np.ndarray
    blocks: list[dict]
    keys: np.ndarray  # distinct training pairs, context's number << 32 | word's number
    counts: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, pairs: bool) -> _Bucket:
        blocks = []
        for row in table.select(["block", "docs", "held", "body"]).to_pylist():
            u, n, d, steps, last = _expand(row["body"], *_BLOCK_KINDS)
            held = np.unpackbits(np.frombuffer(row["held"], np.uint8), count=row["docs"]).astype(bool)
            w = _numbers_of(steps, n) if len(steps) else steps.astype(np.int64)
            blocks.append({"block": row["block"], "u": u, "n": n, "d": d, "w": w, "last": last, "held": held})
        contexts = _distinct([b["u"] for b in blocks])
        words = _distinct([b["d"] for b in blocks])
        seen, times = [], []
        for b in blocks:
            u = np.repeat(np.searchsorted(contexts, b.pop("u")), b.pop("n"))
            b["key"] = u << 32 | np.searchsorted(words, b.pop("d"))[b.pop("w")]
            trained = b["last"] > 0 if pairs else ~b["held"][b["last"]]
            seen.append((b.pop("key") if pairs else b["key"])[trained])
            if pairs:
                times.append(b.pop("last")[trained])
        if not pairs:  # each entry counts once
            return cls(contexts, words, blocks, *np.unique(np.concatenate(seen), return_counts=True))
        seen, times = np.concatenate(seen), np.concatenate(times).astype(np.int64)
        most = [len(contexts), len(words), int(times.max(initial=0)) + 1]
        keys, w, times = _sorted([seen >> 32, seen & 0xFFFFFFFF, times], most)
        keys <<= 32
        keys |= w
        del seen, w
        firsts = np.flatnonzero(np.diff(keys, prepend=-1))
        counts = np.add.reduceat(times, firsts) if len(firsts) else times
        return cls(contexts, words, blocks, keys[firsts], counts)

    @property
    def place(self) -> np.ndarray:
        return self.keys >> 32

    @property
    def word(self) -> np.ndarray:
        return self.keys & 0xFFFFFFFF


# ---- jobs ------------------------------------------------------------------------------


#: Distinct contexts that a task counts before it sends the counts it has.
_COUNTED = 1 << 19


def _hot_contexts(rows: DataFrame, bucket_tokens: int) -> tuple[np.ndarray, int]:
    """Contexts that fill an eighth of a bucket or more, and the number of buckets.

    Every context of every text is counted: tasks send all their counts, in portions of bounded
    size, and the sums by context are exact. By their share there are at most eight per bucket.
    """

    def sent(words: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(counts)], ["u", "n"])

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, docs = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for batch in found:
            texts = batch.column("text")
            seen, times = [words], [counts]
            for slab in _slabs(texts):
                known, places, _ = _words(texts.slice(slab.start, slab.stop - slab.start))
                seen.append(_hashes(known))
                times.append(np.bincount(places, minlength=len(known)))
            docs += len(texts)
            words, place = np.unique(np.concatenate(seen), return_inverse=True)
            counts = np.bincount(place, np.concatenate(times), len(words)).astype(np.int64)
            if len(words) > _COUNTED:
                yield sent(words, counts)
                words, counts = words[:0], counts[:0]
        yield sent(words, counts)
        yield sent(np.array([BEGIN]), np.array([docs]))
        give_back()

    # The number of buckets follows from the bytes; a word and its separator take six or so.
    size = rows.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 6)).first()[0] or 0
    buckets = max(1, -(-int(size) // (6 * bucket_tokens)))
    if buckets == 1:  # no context is spread
        return np.zeros(0, np.uint64), 1
    counted = rows.select("text").mapInArrow(batches, "u long, n long").groupBy("u").agg(F.sum("n").alias("n"))
    counted = stored(counted, "contexts")
    tokens = counted.agg(F.sum("n")).first()[0]  # each has the word or the begin before it
    hot = counted.where(F.col("n") * (8 * buckets) >= tokens).select("u").collect()
    forget(counted)
    return np.array([r["u"] for r in hot], np.int64).astype(np.uint64), buckets


_HOT_PART = -1  # stands in for a part where hot pairs' tables are sent
_VISIT = "kind int, bucket int, part int, words binary, tables binary, u long, c long, t long, stats array<long>"


def _first_visit(entries: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """Kind 0: tables by word for the parent; 1: hot contexts' totals; 2: counts; 3: hot pairs."""
    shared = entries.sparkSession.sparkContext.broadcast(hot)

    def visit(table: pa.Table) -> pa.Table:
        number = table.column("bucket")[0].as_py()
        own = _Bucket.of(table, pairs=True)
        hot_here = np.isin(own.contexts, shared.value)
        ones, twos = int((own.counts == 1).sum()), int((own.counts == 2).sum())
        followers = np.bincount(own.word, minlength=len(own.words)) + 0.5
        guess = (followers / followers.sum())[own.word]
        scale = np.where(hot_here, buckets, 1)[: int(own.place.max(initial=-1)) + 1]
        rng = np.random.default_rng([number, 1])
        _, tables = seat(own.counts, own.place, guess, discount_of(ones, twos), THETA, rng, scale, samples=1)
        sent = np.bincount(own.word, tables, len(own.words)).astype("<u4")
        part = (own.words >> np.uint64(8)) % np.uint64(buckets)
        rows, rank = [], np.zeros(len(own.words), np.int64)
        for p in np.unique(part):
            mine = part == p
            rank[mine] = np.arange(int(mine.sum()))
            rows.append((0, number, int(p), _squeeze(own.words[mine]), _squeeze(sent[mine]), None, None, None, None))
        trained = np.bincount(own.place, own.counts, len(own.contexts)).astype(int)
        opened = np.bincount(own.place, tables, len(own.contexts)).astype(int)
        for u in np.flatnonzero(hot_here):
            key = int(own.contexts[u].astype(np.int64))
            rows.append((1, number, None, None, None, key, int(trained[u]), int(opened[u]), None))
        often = np.flatnonzero(hot_here[own.place])
        if len(often):
            found, sizes = np.unique(own.place[often], return_counts=True)
            at = own.word[often]
            body = _squeeze(own.contexts[found], sizes.astype("<u4"), part[at].astype("<u4"), rank[at].astype("<u4"), own.counts[often])
            rows.append((3, number, None, body, None, None, None, None, None))
        kinds = int(((trained > 0) & ~hot_here & (own.contexts != BEGIN)).sum())
        end = np.searchsorted(own.words, END)
        ends = int(own.counts[own.word == end].sum()) if end < len(own.words) and own.words[end] == END else 0
        rows.append((2, number, None, None, None, None, None, None, [int(own.counts.sum()), kinds, ends, ones, twos]))
        types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        names = ["kind", "bucket", "part", "words", "tables", "u", "c", "t", "stats"]
        return pa.table([pa.array(list(c), k) for c, k in zip(zip(*rows), types)], names)

    return entries.groupBy("bucket").applyInArrow(lambda table: give_back(visit(table)), _VISIT)


def _parent(visits: DataFrame, buckets: int, vocabulary: int) -> DataFrame:
    """``bucket, part, mass, customers, tables``: the shared restaurant, answered per bucket.

    ``mass`` is c - d t of each word in the order asked, ``d`` travels in ``discount``.
    """

    def visit(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        asked = [_expand(r["words"], "<u8")[0] for r in rows]
        words, place = np.unique(np.concatenate(asked), return_inverse=True)
        sent = np.concatenate([_expand(r["tables"], "<u4")[0] for r in rows])
        customers = np.bincount(place, sent, len(words)).astype(np.int64)
        known = np.flatnonzero(customers)
        c = customers[known]
        discount = discount_of((c == 1).sum(), (c == 2).sum())
        even = np.full(len(c), 1 / (vocabulary + 1))
        rng = np.random.default_rng([rows[0]["part"], 2])
        mean, _ = seat(c, np.zeros(len(c), np.int64), even, discount, THETA, rng, float(buckets))
        mass = np.zeros(len(words))
        mass[known] = c - discount * mean
        cuts = np.cumsum([len(a) for a in asked])[:-1]
        first = np.arange(len(rows)) == 0
        return pa.table(
            {
                "bucket": pa.array([r["bucket"] for r in rows], pa.int32()),
                "part": pa.array([r["part"] for r in rows], pa.int32()),
                "mass": pa.array([_squeeze(m.astype("<f4")) for m in np.split(mass[place], cuts)], pa.binary()),
                "customers": pa.array(np.where(first, float(c.sum()), 0.0)),
                "kept": pa.array(np.where(first, float(mass.sum()), 0.0)),
            }
        )

    asked = visits.where("kind = 0").select("bucket", "part", "words", "tables")
    return asked.groupBy("part").applyInArrow(
        visit, "bucket int, part int, mass binary, customers double, kept double"
    )


@dataclass(frozen=True)
class _Totals:
    tokens: int
    vocabulary: int
    ends: int
    discount: float
    customers: float
    kept: float
    hot: dict[int, tuple[int, float]]

    def base(self, counts) -> np.ndarray:
        return np.log10((np.asarray(counts, float) + 0.1) / (self.tokens + 0.1 * (self.vocabulary + 1)))

    def parent(self, mass: np.ndarray) -> np.ndarray:
        """P(w): what the tables keep, the rest spread over the vocabulary and the unknown."""
        spread = (THETA + self.customers - self.kept) / (self.vocabulary + 1)
        return (mass + spread) / (THETA + self.customers)


def _hot_pairs(visits: DataFrame, answers: DataFrame, totals: _Totals) -> DataFrame:
    """``bucket, body``: hot contexts, pairs of each, and the pairs' customers and parent's p."""
    shared = visits.sparkSession.sparkContext.broadcast(totals)

    def visit(table: pa.Table, answer: pa.Table) -> pa.Table:
        bodies = []
        for body in table.column("words").to_pylist():
            contexts, sizes, part, rank, counts = _expand(body, "<u8", "<u4", "<u4", "<u4", "<i8")
            mass = np.zeros(len(part))
            for row in answer.select(["part", "mass"]).to_pylist():
                mine = part == row["part"]
                mass[mine] = _expand(row["mass"], "<f4")[0][rank[mine]]
            bodies.append(_squeeze(contexts, sizes, counts, shared.value.parent(mass)))
        return pa.table(
            {"bucket": pa.array(table.column("bucket").to_pylist(), pa.int32()), "body": pa.array(bodies, pa.binary())}
        )

    asked = visits.where("kind = 3").select("bucket", "words")
    return asked.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(visit, "bucket int, body binary")


def _hot_tables(pairs: DataFrame, discount: float, x: dict[int, float]) -> DataFrame:
    """``bucket, tables, u, t, spread``: per bucket the pairs' mean tables given x, in the order
    of the contexts and words (where u is null), and per context their sums and variances."""
    shared = pairs.sparkSession.sparkContext.broadcast(x)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for row in batch.to_pylist():
                contexts, sizes, c, p = _expand(row["body"], "<u8", "<u4", "<i8", "<f8")
                keys = contexts.astype(np.int64).tolist()
                place = np.repeat(np.arange(len(keys)), sizes)
                tables, spread = np.ones(len(c)), np.zeros(len(c))
                often = np.flatnonzero(c > 1)
                if len(often):
                    own = np.array([shared.value[k] for k in keys])[place[often]]
                    tables[often], spread[often] = _Pairs(c[often], p[often], own, discount).moments(own)
                tables = tables.astype("<f4")
                n = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["bucket"]] * (n + 1), pa.int32()),
                        pa.array([_squeeze(tables)] + [None] * n, pa.binary()),
                        pa.array([None, *keys], pa.int64()),
                        pa.array([None, *np.bincount(place, tables, n).tolist()], pa.float64()),
                        pa.array([None, *np.bincount(place, spread, n).tolist()], pa.float64()),
                    ],
                    ["bucket", "tables", "u", "t", "spread"],
                )

    return pairs.mapInArrow(batches, "bucket int, tables binary, u long, t double, spread double")


def _seat_hot(pairs: DataFrame, totals: _Totals) -> tuple[DataFrame, dict[int, tuple[int, float]]]:
    """The tables of ``_hot_tables`` at the fixed point, and the contexts' totals of just these."""
    shape = THETA / totals.discount
    x = {u: shape + t for u, (_, t) in totals.hot.items()}
    for number in range(HOT_ROUNDS):
        found = stored(_hot_tables(pairs, totals.discount, x), "hot")
        sums = found.where("u is not null").groupBy("u").agg(F.sum("t").alias("t"), F.sum("spread").alias("spread"))
        sums = {r["u"]: (r["t"], r["spread"]) for r in sums.collect()}  # at most eight per bucket
        off = max((abs(shape + t - x[u]) / x[u] for u, (t, _) in sums.items()), default=0.0)
        if off < 1e-4 or number == HOT_ROUNDS - 1:
            break
        forget(found)
        for u, (t, spread) in sums.items():  # Newton's step, as in ``seat``
            x[u] = max(shape, x[u] + (shape + t - x[u]) / (1 - min(spread / x[u], 0.95)))
    return found, {u: (c, sums[u][0] if u in sums else 0.0) for u, (c, _) in totals.hot.items()}


def _second_visit(entries: DataFrame, answers: DataFrame, totals: _Totals, buckets: int) -> DataFrame:
    """Per block and bucket: sums of documents over the entries of the bucket."""
    shared = entries.sparkSession.sparkContext.broadcast(totals)

    def visit(table: pa.Table, answer: pa.Table) -> pa.Table:
        known = shared.value
        number = table.column("bucket")[0].as_py()
        own = _Bucket.of(table, pairs=False)
        mass, of_hot = np.zeros(len(own.words)), np.zeros(0)
        part = (own.words >> np.uint64(8)) % np.uint64(buckets)
        for row in answer.select(["part", "mass"]).to_pylist():
            if row["part"] == _HOT_PART:
                of_hot = _expand(row["mass"], "<f4")[0]
            else:
                mass[part == row["part"]] = _expand(row["mass"], "<f4")[0]
        parent = known.parent(mass)
        trained = np.bincount(own.place, own.counts, len(own.contexts))
        fixed = np.full(len(own.contexts), np.nan)
        for u, key in enumerate(own.contexts.astype(np.int64).tolist()):
            if key in known.hot:
                trained[u], fixed[u] = known.hot[key]
        rng = np.random.default_rng([number, 3])
        d = known.discount
        spread = ~np.isnan(fixed)[own.place]
        mean = np.zeros(len(own.keys))
        mean[spread] = of_hot  # of the same pairs: contexts and words are sorted by hash
        mean[~spread], _ = seat(own.counts[~spread], own.place[~spread], parent[own.word[~spread]], d, THETA, rng)
        tables = np.bincount(own.place, mean, len(own.contexts))
        tables = np.where(np.isnan(fixed), tables, fixed)
        rest = (THETA + d * tables) / (THETA + trained)
        rest[trained == 0] = 1.0
        base, is_known = known.base(trained), trained > 0
        begin = own.contexts == BEGIN
        base[begin], is_known[begin] = 0.0, False
        kept = own.counts - d * mean
        rows = []
        ids = dict(zip(table.column("block").to_pylist(), table.column("doc_ids").to_pylist()))
        for b in own.blocks:
            key, doc = b["key"], b["last"]
            u, w = key >> 32, key & 0xFFFFFFFF
            p = rest[u] * parent[w]
            if len(own.keys):
                at = np.minimum(np.searchsorted(own.keys, key), len(own.keys) - 1)
                p += np.where(own.keys[at] == key, kept[at], 0.0) / (THETA + trained[u])
            times = np.bincount(doc)
            here = np.flatnonzero(times)
            body = _squeeze(
                here.astype("<u4"),
                times[here].astype("<u4"),
                np.bincount(doc, is_known[u])[here].astype("<u4"),
                np.bincount(doc, base[u])[here].astype("<f8"),
                np.bincount(doc, np.log10(p))[here].astype("<f8"),
            )
            rows.append((b["block"], ids[b["block"]], np.packbits(b["held"]).tobytes(), body))
        kinds = [pa.int64(), table.schema.field("doc_ids").type, pa.binary(), pa.binary()]
        names = ["block", "doc_ids", "held", "body"]
        return pa.table([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

    kind = entries.schema["doc_ids"].dataType.simpleString()
    return (
        entries.groupBy("bucket")
        .cogroup(answers.groupBy("bucket"))
        .applyInArrow(
            lambda table, answer: give_back(visit(table, answer)),
            f"block long, doc_ids {kind}, held binary, body binary",
        )
    )


def _summed(parts: DataFrame, totals: _Totals) -> DataFrame:
    """Documents' rows from the parts of their block."""
    shared = parts.sparkSession.sparkContext.broadcast(totals)

    def visit(table: pa.Table) -> pa.Table:
        known = shared.value
        rows = table.to_pylist()
        home = next(r for r in rows if r["doc_ids"] is not None)
        n = len(home["doc_ids"])
        sums = np.zeros((4, n))
        for row in rows:
            here, *parts = _expand(row["body"], "<u4", "<u4", "<u4", "<f8", "<f8")
            for total, part in zip(sums, parts):
                total[here] += part
        held = np.unpackbits(np.frombuffer(home["held"], np.uint8), count=n).astype(bool)
        return pa.table(
            {
                "doc_id": pa.array(home["doc_ids"], table.schema.field("doc_ids").type.value_type),
                "held_out": pa.array(held),
                "n_tokens": pa.array(sums[0].astype(np.int64)),
                "n_known": pa.array(sums[1].astype(np.int64) + (known.ends > 0)),
                "train_tokens": pa.array(np.full(n, known.tokens, np.int64)),
                "base_score": pa.array(sums[2] + known.base(known.ends)),
                "score": pa.array(sums[3]),
            }
        )

    kind = parts.schema["doc_ids"].dataType.elementType.simpleString()
    return parts.groupBy("block").applyInArrow(
        visit,
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double",
    )


def score_documents(
    documents: DataFrame,
    held_out: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    bucket_tokens: int = BUCKET_TOKENS,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Scores are log10 probabilities of the whole text with its end; the model learns from the
    rows that ``held_out`` does not mark.
    """
    rows = documents.select(
        F.col(doc_id).alias("id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        F.coalesce(held_out, F.lit(False)).alias("held"),
    )
    hot, buckets = _hot_contexts(rows, bucket_tokens)
    pairs = _blocks(rows, hot, buckets, pairs=True).repartition(buckets, "bucket")
    visits = stored(_first_visit(pairs, hot, buckets), "visits")
    stats = visits.where("kind = 2").agg(
        *[F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)).alias(str(i)) for i in range(5)]
    ).first()
    sums = visits.where("kind = 1").groupBy("u").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    often = {r["u"]: (r["c"], r["t"]) for r in sums.collect()}  # at most eight per bucket
    tokens, kinds, ends, ones, twos = stats
    begin = int(BEGIN)
    vocabulary = kinds + sum(c > 0 and u != begin for u, (c, _) in often.items()) + (ends > 0)
    answers = stored(_parent(visits, buckets, vocabulary), "parent")
    seats = answers.agg(F.coalesce(F.sum("customers"), F.lit(0.0)), F.coalesce(F.sum("kept"), F.lit(0.0))).first()
    totals = _Totals(tokens, vocabulary, ends, discount_of(ones, twos), *seats, often)
    if often:
        found, often = _seat_hot(stored(_hot_pairs(visits, answers, totals), "hot pairs"), totals)
        totals = replace(totals, hot=often)
        found = found.where("u is null").select("bucket", F.lit(_HOT_PART).alias("part"), F.col("tables").alias("mass"))
        answers = answers.select("bucket", "part", "mass").unionByName(found)
    entries = _blocks(rows, hot, buckets, pairs=False).repartition(buckets, "bucket")
    parts = _second_visit(entries, answers.repartition(buckets, "bucket"), totals, buckets)
    return _summed(parts, totals)
