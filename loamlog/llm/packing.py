"""Sum-of-squares packing of tokenized documents into sequences.

A document's ids are cut into full sequences and a rest. The rests are placed online: of the
windows that still have room, and a new one, the rest goes to the fill level for which the sum
of the squared numbers of windows per level is smallest afterwards. The numbers stand in an
array by level. Every task packs what it reads, no data moves. A window that stays open to the
task's end, or when too many are open, is filled by cutting rests, so a task pads at most one
sequence by more than a sixteenth.

A null text counts as empty; it and an empty text have the end id alone. Every row is packed,
repeated rows and null ids too. Only the named columns are read. ``sequence_id`` is unique, not
gapless: the task's number and a running number in it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamlog.llm.common import in_slices
from loamlog.llm.tokens import encoded

LENGTH = 1024
#: Windows a task holds open.
OPEN = 2048

#: A piece: document row, its ids before the piece, its ids.
Piece = tuple[int, int, np.ndarray]
SCHEMA = "doc_id {id}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Places pieces; closed sequences (lists of pieces) are collected in ``done``."""

    def __init__(self, length: int = LENGTH, most_open: int = OPEN):
        self.length, self.most_open = length, most_open
        self.levels = np.zeros(length + 1, np.int64)  # open windows by fill level
        self.windows: dict[int, list[list[Piece]]] = defaultdict(list)
        self.done: list[list[Piece]] = []

    def add(self, row: int, ids: np.ndarray) -> None:
        full = len(ids) - len(ids) % self.length
        for start in range(0, full, self.length):
            self.done.append([(row, start, ids[start : start + self.length])])
        if full < len(ids):
            self._place((row, full, ids[full:]))

    def _place(self, piece: Piece) -> None:
        size = len(piece[2])
        room = self.length - size
        # Change of the sum when a window goes from level h to h + size; level 0 is a new one.
        change = 2 * (self.levels[size:] + 1 - self.levels[: room + 1]).astype(float)
        change[0] = 2 * self.levels[size] + 1
        change[room] -= 2 * self.levels[self.length] + 1  # a full window is no longer counted
        taken = self.levels[: room + 1] > 0
        taken[0] = True
        change[~taken] = np.inf
        level = room - int(np.argmin(change[::-1]))  # of equal ones the fullest
        window = self.windows[level].pop() if level else []
        window.append(piece)
        if level:
            self.levels[level] -= 1
        if level == room:
            self.done.append(window)
            return
        self.levels[level + size] += 1
        self.windows[level + size].append(window)
        if self.levels.sum() > self.most_open:
            self._fill(sum(self.windows.values(), []))

    def _fill(self, windows: list[list[Piece]]) -> None:
        """Close windows; those with more than a sixteenth of padding are cut into each other."""
        self.levels[:] = 0
        self.windows.clear()
        now: list[Piece] = []
        used = 0
        for window in windows:
            if sum(len(p[2]) for p in window) * 16 >= self.length * 15:
                self.done.append(window)
                continue
            for row, start, ids in window:
                while len(ids):
                    part = ids[: self.length - used]
                    now.append((row, start, part))
                    used, start, ids = used + len(part), start + len(part), ids[len(part) :]
                    if used == self.length:
                        self.done.append(now)
                        now, used = [], 0
        if now:
            self.done.append(now)

    def close(self) -> None:
        self._fill(sum(self.windows.values(), []))


def pack_documents(
    documents: DataFrame,
    tokenizer: str,
    end: int = 0,
    length: int = LENGTH,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are little-endian unsigned 32-bit numbers; ``start`` counts the document's ids
    before the piece and ``offset`` the sequence's. A sequence holds at most ``length`` ids.
    """

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number = Packer(length), TaskContext.get().partitionId() << 33
        names: dict[int, tuple[object, int]] = {}  # rows with pieces that have not left yet
        seen = 0
        id_type = None

        def leave() -> pa.RecordBatch:
            nonlocal number
            rows = []
            for window in packer.done:
                at = 0
                for row, start, ids in window:
                    name, total = names[row]
                    rows.append((name, start, len(ids), ids.astype("<u4").tobytes(), total, number, at))
                    at += len(ids)
                number += 1
            packer.done.clear()
            waiting = {p[0] for level in packer.windows.values() for window in level for p in window}
            for row in [r for r in names if r not in waiting]:
                del names[row]
            kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            fields = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            columns = zip(*rows) if rows else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], fields)

        for batch in found:
            id_type = batch.schema.field("id").type
            ids_of = zip(batch.column("id").to_pylist(), encoded(batch.column("text"), tokenizer, end))
            size = 0
            for name, ids in ids_of:
                names[seen] = (name, len(ids))
                packer.add(seen, ids)
                seen, size = seen + 1, size + len(ids)
                if size > 1 << 21:
                    yield leave()
                    size = 0
            yield leave()
        if id_type is not None:
            packer.close()
            yield leave()

    rows = documents.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(in_slices(batches), SCHEMA.format(id=rows.schema["id"].dataType.simpleString()))
