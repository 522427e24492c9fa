"""Periodic runs of words, found by block convolution.

A run is a stretch of consecutive words with smallest period q, at least ``max(12, 2 * q)`` words
long, that no neighbouring word extends. Periods are searched by dyadic scale: blocks of b words
serve the periods from 2b up to 4b (blocks of two words those from 1 to 7). A run of such a period
holds a whole aligned block and the block's copy one period later. For each block the sums of
squared differences between it and every place of the window that follows come from an exact
number theoretic transform modulo a prime; a sum of zero is an occurrence. Its distance is a seed,
compared word by word and extended both ways. Sums are exact modulo the prime, so no occurrence
is lost; a sum that is a multiple of the prime by accident fails the comparison.

Blocks with a pair of words that does not come again within the reach of the window have no
occurrence there and are not transformed. Seeds inside a run whose period divides their distance
belong to that run. All texts of an Arrow batch are treated as one row of numbers, with a number
of its own between any two texts, which no run can cross.

Null and empty texts have no words and no runs. Texts of any length are read whole; memory is in
proportion to the texts of one batch. Rows are treated one by one: null ids and repeated rows keep
their rows, an empty table gives an empty one, columns named like added ones are replaced. Of
equally long runs the smallest start, then the smallest period is reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamlog.llm.common import other_columns

ADDED = ("n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed")
LEAST = 12
#: A prime 15 * 2**27 + 1 and a primitive root of it (fixed values); products fit 64 bits.
PRIME, ROOT = 2013265921, 31
_P = np.uint64(PRIME)
#: Numbers transformed at once.
_CHUNK = 1 << 19
#: Words treated together, at least one text.
_BATCH = 1 << 18


@cache
def _powers(size: int, inverse: bool) -> np.ndarray:
    """The first half of the powers of a root of unity of this order."""
    step = pow(ROOT, (PRIME - 1) // size, PRIME)
    if inverse:
        step = pow(step, PRIME - 2, PRIME)
    found = np.ones(1, np.uint64)
    while len(found) < size // 2:
        found = np.concatenate([found, found * np.uint64(pow(step, len(found), PRIME)) % _P])
    return found


def transform(rows: np.ndarray) -> np.ndarray:
    """Number theoretic transform of each row, its results in bit-reversed order."""
    m, size = rows.shape
    half = size // 2
    while half:
        x = rows.reshape(m, -1, 2, half)
        u, v = x[:, :, 0], x[:, :, 1]
        rows = np.stack([(u + v) % _P, (u + _P - v) * _powers(2 * half, False) % _P], axis=2)
        half //= 2
    return rows.reshape(m, size)


def invert(rows: np.ndarray) -> np.ndarray:
    """The rows whose transforms these are."""
    m, size = rows.shape
    half = 1
    while half < size:
        x = rows.reshape(m, -1, 2, half)
        u, v = x[:, :, 0], x[:, :, 1] * _powers(2 * half, True) % _P
        rows = np.stack([(u + v) % _P, (u + _P - v) % _P], axis=2)
        half *= 2
    return rows.reshape(m, size) * np.uint64(pow(size, PRIME - 2, PRIME)) % _P


def _reach(block: int) -> tuple[int, int]:
    """Smallest and largest distance that blocks of this length look at."""
    return (1 if block == 2 else 2 * block), 4 * block - 1


def occurrences(words: np.ndarray, starts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of blocks, and distances at which the squared differences sum to zero modulo the prime."""
    size = 4 * block
    low, high = _reach(block)
    padded = np.concatenate([words, np.zeros(low + size, np.uint64)])
    squares = np.concatenate([np.zeros(1, np.uint64), np.cumsum(padded * padded % _P, dtype=np.uint64)])
    places, lags = np.arange(size), np.arange(high - low + 1)
    found_t, found_d = [], []
    step = max(1, _CHUNK // size)
    for at in range(0, len(starts), step):
        t = starts[at : at + step]
        ahead = padded[(t + low)[:, None] + places]
        turned = np.zeros_like(ahead)  # the block at places 0, -1, -2, ... of a circle
        turned[:, -places[:block]] = padded[t[:, None] + places[:block]]
        cross = invert(transform(turned) * transform(ahead) % _P)[:, lags]
        own = (squares[t + block] - squares[t])[:, None]
        from_ = (t + low)[:, None] + lags
        theirs = squares[from_ + block] - squares[from_]
        i, lag = np.nonzero((own + theirs + np.uint64(2) * (_P - cross)) % _P == 0)
        found_t.append(t[i])
        found_d.append(lag + low)
    if not found_t:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_t), np.concatenate(found_d)


def _equal_ahead(words: np.ndarray, at: int, other: int) -> int:
    """How many words from ``at`` on equal those from ``other`` on; at < other."""
    total, step = 0, 16
    while other + total < len(words):
        a, b = words[at + total : at + total + step], words[other + total : other + total + step]
        differ = np.flatnonzero(a[: len(b)] != b)
        if len(differ):
            return total + int(differ[0])
        total += len(b)
        step *= 2
    return total


def _equal_behind(words: np.ndarray, at: int, other: int) -> int:
    """How many words before ``at`` equal those before ``other``; at < other."""
    total, step = 0, 16
    while at - total > 0:
        n = min(step, at - total)
        a, b = words[at - total - n : at - total], words[other - total - n : other - total]
        differ = np.flatnonzero(a != b)
        if len(differ):
            return total + n - 1 - int(differ[-1])
        total += n
        step *= 2
    return total


def _again(words: np.ndarray) -> np.ndarray:
    """Distance from each pair of neighbouring words to its next occurrence."""
    pairs = words[:-1].astype(np.int64) * (int(words.max()) + 1) + words[1:].astype(np.int64)
    order = np.argsort(pairs, kind="stable")
    same = pairs[order[1:]] == pairs[order[:-1]]
    far = np.full(len(pairs), np.iinfo(np.int64).max)
    far[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return far


def find_runs(words: np.ndarray, ends: np.ndarray | None = None, least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs as (start, end, period), by start and period.

    ``words`` are numbers below the prime; ``ends`` gives for each place the end of its text, where
    a number that stands nowhere else follows. ``least`` is 12 or more.
    """
    n = len(words)
    if n < least:
        return []
    if ends is None:
        ends = np.full(n, n)
    longest = int((ends - np.arange(n)).max())
    far = _again(words)
    found: list[tuple[int, int, int]] = []
    known: set[tuple[int, int]] = set()
    block = 2
    while 4 * block <= longest or block == 2:
        low, high = _reach(block)
        starts = np.arange(0, n - block + 1, block)
        # far[t : t + block - 1] are the pairs inside of the block that starts at t.
        most = np.lib.stride_tricks.sliding_window_view(far, block - 1)[starts].max(axis=1)
        starts = starts[(most <= high) & (starts + block + low <= ends[starts])]
        t, d = occurrences(words, starts, block)
        sound = t + d + block <= ends[t] if len(t) else np.zeros(0, bool)
        t, d = t[sound], d[sound]
        order = np.lexsort((t, d))
        by_start = np.argsort(t[order], kind="stable")
        t, d = t[order], d[order]
        open_ = np.ones(len(t), bool)
        sorted_t = t[by_start]

        def close(s: int, e: int, q: int) -> None:
            """Seeds inside a run of period q at multiples of q find that run only."""
            at = by_start[np.searchsorted(sorted_t, s) : np.searchsorted(sorted_t, e)]
            open_[at[(d[at] % q == 0) & (t[at] + d[at] + block <= e)]] = False

        if len(t):
            for run in found:
                close(*run)
        i = 0
        while i < len(t):
            i += int(np.argmax(open_[i:]))
            if not open_[i]:
                break
            at, q = int(t[i]), int(d[i])
            ahead = _equal_ahead(words, at, at + q)
            if ahead >= block:
                s = at - _equal_behind(words, at, at + q)
                e = at + ahead + q
                if e - s >= max(least, 2 * q) and (s, e) not in known:
                    known.add((s, e))
                    found.append((s, e, q))
                    close(s, e, q)
                # Later seeds of this distance in the same stretch find it again.
                over = np.searchsorted(t[i : np.searchsorted(d, q, "right")], e - q)
                open_[i : i + max(1, int(over))] = False
            open_[i] = False
        block *= 2
    found.sort(key=lambda run: (run[0], run[2]))
    return found


def _numbered(texts: list[str | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, all of them as numbers, where each text begins and ends."""
    number: dict[bytes, int] = {}
    words = [(text or "").encode("utf-8", "surrogatepass").split() for text in texts]
    ids: list[int] = []
    begins = np.zeros(len(texts), np.int64)
    gaps = []
    for k, found in enumerate(words):
        begins[k] = len(ids)
        ids.extend([number.setdefault(w, len(number) + 1) for w in found])
        gaps.append(len(ids))
        ids.append(0)
    out = np.array(ids, np.uint64)
    out[gaps] = np.arange(len(gaps), dtype=np.uint64) + np.uint64(len(number) + 1)
    return words, out, begins, np.array(gaps, np.int64)


def _of_texts(texts: list[str | None]) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """Runs of each text as (start, length, period), and the text without what they repeat."""
    words, ids, begins, ends = _numbered(texts)
    runs = find_runs(ids, np.repeat(ends, ends - begins + 1)) if len(ids) else []
    owner = np.searchsorted(begins, [s for s, _, _ in runs], "right") - 1
    mine: dict[int, list[tuple[int, int, int]]] = {}
    for k, (s, e, q) in zip(owner.tolist(), runs):
        mine.setdefault(k, []).append((s - int(begins[k]), e - s, q))
    for k, found in enumerate(words):
        kept = found
        if k in mine:
            keep = np.ones(len(found), bool)
            for s, length, q in mine[k]:
                keep[s + q : s + length] = False
            kept = [found[i] for i in np.flatnonzero(keep)]
        yield mine.get(k, []), b" ".join(kept)


def collapse_runs(documents: DataFrame, text: str = "text") -> DataFrame:
    """The documents without ``text``, with their longest run, ``runs`` (every run's
    ``start,length,period`` and a line feed) and ``collapsed``, the text with one period of each run."""
    kept = other_columns(documents, text, *ADDED)
    rows = documents.select(*kept, F.col(f"`{text}`").cast("string").alias(text))
    schema = rows.drop(text).schema
    for name in ADDED[:5]:
        schema = schema.add(name, "long")
    schema = schema.add("runs", "string").add("collapsed", "string")

    def out(batch: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in ADDED]
        for runs, collapsed in _of_texts(texts):
            best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
            s, length, q = best or (None, None, None)
            milli = None if best is None else 1000 * length // q
            lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
            for column, value in zip(columns, (len(runs), s, length, q, milli, lines, collapsed.decode("utf-8", "replace"))):
                column.append(value)
        types = [pa.int64()] * 5 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], *map(pa.array, columns, types)], [*batch.schema.names[:-1], *ADDED]
        )

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            texts = batch.column(batch.num_columns - 1)
            low = size = 0
            for i in range(batch.num_rows):
                size += len(texts[i].as_py() or "") // 4
                if size >= _BATCH or i == batch.num_rows - 1:
                    part = batch.slice(low, i + 1 - low)
                    yield out(part, part.column(part.num_columns - 1).to_pylist())
                    low, size = i + 1, 0

    return rows.mapInArrow(batches, schema)
