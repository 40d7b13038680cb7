"""Bounded-space online packing of token sequences into fixed windows.

A task reads its documents in order, tokenizes them, cuts full windows off long
ones, and places the rest best-fit: of ``OPEN`` open windows, the one with the
least room that still suffices. When none fits and the number is reached, the
fullest is emitted and a new one opened. Windows still open at the end of a
partition hold what is left over. Their pieces are tied into units of ``UNIT``
tokens or more (the last of a window may be shorter), landed with the others,
and the units of ``MERGE`` partitions are packed again in one task, largest
first: at most ``MERGE * OPEN * (WINDOW / UNIT + 1)`` rows, however many pieces
they hold. State is bounded by the number of open windows; token ids stay in the
task that made them.

Defined cases: a null or empty text is the end mark alone; ids of null or
repeated documents are carried as they are, each row packed for itself; a text
of any length is cut into as many windows as it needs; an empty table gives no
pieces; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import land

WINDOW = 4096
END = 2
OPEN = 64
MERGE = 64
UNIT = 256
#: Numbers of one task's windows; merged windows are numbered from MERGED on.
PER_TASK = 1 << 31
MERGED = 1 << 62

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "part long, unit long")
NAMES = [c.split()[0] for c in PIECES.split(", ")]


class Windows:
    """Open windows ordered by room; at most ``most`` of them (None: any number)."""

    def __init__(self, window: int, most: int | None):
        self.window, self.most = window, most
        self.rooms: list[tuple[int, int]] = []
        self.held: dict[int, list[tuple]] = {}
        self.next = 0

    def place(self, length: int, piece: tuple) -> list[tuple[int, list[tuple]]]:
        """Put a piece of ``length`` into a window; returns windows that close."""
        closed = []
        at = bisect.bisect_left(self.rooms, (length, -1))
        if at == len(self.rooms):
            if self.most is not None and len(self.rooms) >= self.most:
                _, number = self.rooms.pop(0)
                closed.append((number, self.held.pop(number)))
            room, number = self.window, self.next
            self.next += 1
            self.held[number] = []
        else:
            room, number = self.rooms.pop(at)
        self.held[number].append((self.window - room, piece))
        if room == length:
            closed.append((number, self.held.pop(number)))
        else:
            bisect.insort(self.rooms, (room - length, number))
        return closed

    def rest(self) -> list[tuple[int, list[tuple]]]:
        return sorted(self.held.items())


def closed_rows(closed, base: int, part: int) -> list[tuple]:
    return [(*piece, base + number, offset, part, None) for number, pieces in closed for offset, piece in pieces]


def open_rows(rest, part: int) -> list[tuple]:
    """Pieces left over, with their unit and their offset in it. No unit reaches
    beyond its window, so each fits into one."""
    rows, unit = [], 0
    for _, pieces in rest:
        filled = 0
        for _, piece in pieces:
            rows.append((*piece, None, filled, part, unit))
            filled += piece[2]
            if filled >= UNIT:
                unit, filled = unit + 1, 0
        unit += filled > 0
    return rows


def cut(doc_id, ids: np.ndarray, window: int) -> list[tuple]:
    """Full windows and a rest: ``doc_id, start, length, crc, doc_tokens``. The
    end mark closes the last piece."""
    total, raw = len(ids) + 1, memoryview(ids).cast("B") if len(ids) else memoryview(b"")
    out = []
    for start in range(0, total, window):
        stop = min(start + window, total)
        crc = zlib.crc32(raw[4 * start:4 * min(stop, total - 1)])
        if stop == total:
            crc = zlib.crc32(END.to_bytes(4, "little"), crc)
        out.append((doc_id, start, stop - start, crc, total))
    return out


def to_arrow(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], NAMES)


def pack(docs: DataFrame, window: int = WINDOW, open_windows: int = OPEN, tokenizer_folder: str | None = None) -> DataFrame:
    """One row for each piece of ``docs(doc_id, text)``: ``doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset``."""
    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, model, windows = TaskContext.get().partitionId(), tokens.load("word_bpe_49k", tokenizer_folder), Windows(window, open_windows)
        base = part * PER_TASK
        for batch in batches:
            at = 0
            for texts in tokens.slices(batch.column("text")):
                ids, bounds = model.encode(texts)
                done: list[tuple] = []
                for doc_id, start, stop in zip(batch.column("doc_id").slice(at, len(texts)).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    for piece in cut(doc_id, ids[start:stop], window):
                        done += windows.place(piece[2], piece)
                at += len(texts)
                yield to_arrow(closed_rows(done, base, part))
        yield to_arrow(open_rows(windows.rest(), part))

    def merge(key: tuple, units: pd.DataFrame) -> pd.DataFrame:
        """Where each unit goes: ``part, unit, sequence_id, at``."""
        units = units.sort_values(["length", "part", "unit"], ascending=[False, True, True])
        windows, base, done = Windows(window, None), MERGED + int(key[0]) * PER_TASK, []
        for part, unit, length in units[["part", "unit", "length"]].itertuples(index=False, name=None):
            done += windows.place(int(length), (part, unit))
        placed = [(*unit, base + number, at) for number, held in done + windows.rest() for at, unit in held]
        return pd.DataFrame(placed, columns=["part", "unit", "sequence_id", "at"]).astype("int64")

    pieces = land(docs.select("doc_id", "text").mapInArrow(online, PIECES), "pieces")
    left = pieces.where("unit IS NOT NULL").drop("sequence_id")
    units = left.groupBy("part", "unit").agg(F.sum("length").alias("length")).withColumn("_group", F.floor(F.col("part") / MERGE))
    placed = units.groupBy("_group").applyInPandas(merge, "part long, unit long, sequence_id long, at long")
    merged = left.join(placed, ["part", "unit"]).withColumn("offset", F.col("at") + F.col("offset"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pieces.where("unit IS NULL").select(*names).unionByName(merged.select(*names))
