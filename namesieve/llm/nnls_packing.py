"""Packing documents into sequences by non-negative least squares over a histogram of lengths.

Each task packs its own documents, window by window (so many documents or ids, whichever comes first); nothing is
shuffled and a lost task is run again. A document longer than a sequence first fills whole sequences by itself. What
is left of each is rounded to a multiple of 1/64 of a sequence. Combinations of few different lengths that fill a
sequence (one or two lengths, each any number of times, or three lengths once) are the columns of a matrix; repeat
counts that meet the window's histogram are its non-negative least-squares solution, rounded down. Rounded lengths
are a little off: a sequence that overflows is cut at its end, and what is cut off fills one with room to spare.
Documents for which no combination was planned are packed greedily, longest first, with cuts at the sequence ends.
The ids that remain in the end, less than a sequence, are laid out in sequences whose lengths are powers of two,
which need no padding.

Defined results: a null or empty text is the end id alone; repeated rows and null ids are packed like any other row;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesieve.llm.tokens import encoder

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
LENGTH = 4096
#: Rounded lengths are multiples of 1/STEPS of a sequence.
STEPS = 64
WINDOW_DOCS = 32_768
WINDOW_IDS = 1 << 24

Piece = tuple[int, int, int]  # document of the window, first id, number of ids


@cache
def combinations(steps: int = STEPS) -> np.ndarray:
    """Columns: how often each rounded length (row i: i + 1 steps) occurs in a combination that fills a sequence."""
    found = set()
    for i in range(1, steps + 1):
        if steps % i == 0:
            found.add(((i, steps // i),))
        for j in range(i + 1, steps):
            for a in range(1, (steps - j) // i + 1):
                if (steps - a * i) % j == 0:
                    found.add(((i, a), (j, (steps - a * i) // j)))
            if steps - i - j > j:
                found.add(((i, 1), (j, 1), (steps - i - j, 1)))
    matrix = np.zeros((steps, len(found)))
    for column, parts in enumerate(sorted(found)):
        for length, times in parts:
            matrix[length - 1, column] = times
    return matrix


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-8) -> np.ndarray:
    """The x >= 0 that minimises |a x - b|, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x = np.zeros(n)
    active = np.zeros(n, bool)
    gradient = a.T @ b
    bound = tolerance * max(1.0, np.abs(gradient).max(initial=0.0))
    for _ in range(3 * a.shape[0]):
        free = np.where(active, -np.inf, gradient)
        j = int(free.argmax())
        if free[j] <= bound:
            break
        active[j] = True
        while True:
            at = np.flatnonzero(active)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if z.min() > 0:
                x[:] = 0
                x[at] = z
                break
            low = z <= 0
            ratio = x[at][low] / np.maximum(x[at][low] - z[low], 1e-300)
            x[at] += ratio.min() * (z - x[at])
            x[x < 1e-12] = 0
            active &= x > 0
            if not active.any():
                break
        gradient = a.T @ (b - a @ x)
    return x


def plan(lengths: np.ndarray, length: int = LENGTH, steps: int = STEPS) -> list[list[Piece]]:
    """Sequences for the documents of a window: each a list of pieces, all ids in exactly one.

    Every sequence holds ``length`` ids, less a little where no cut-off end was left to fill it, or a power of two.
    """
    done: list[list[Piece]] = []
    rest = lengths % length
    for doc in np.flatnonzero(lengths >= length):
        done += [[(int(doc), s, length)] for s in range(0, int(lengths[doc]) - length + 1, length)]
    left = np.flatnonzero(rest)
    rounded = np.clip((rest[left] * steps + length // 2) // length, 1, steps)
    waiting: dict[int, list[int]] = defaultdict(list)
    for doc, r in zip(left.tolist(), rounded.tolist()):
        waiting[r].append(doc)
    histogram = np.bincount(rounded, minlength=steps + 1)[1:].astype(float)
    matrix = combinations(steps)
    # Long lengths are hard to place later: their rows weigh more.
    weight = np.sqrt(np.arange(1, steps + 1))
    repeats = nnls(matrix * weight[:, None], histogram * weight) if len(left) else np.zeros(matrix.shape[1])
    start = {int(d): int(lengths[d] - rest[d]) for d in left}
    open_: list[tuple[list[Piece], int]] = []
    ends: list[Piece] = []
    for column in np.argsort(-repeats, kind="stable"):
        times = int(repeats[column] + 1e-9)
        if times == 0:
            break
        parts = [(int(i) + 1, int(matrix[i, column])) for i in np.flatnonzero(matrix[:, column])]
        times = min([times, *(len(waiting[p]) // k for p, k in parts)])
        for _ in range(times):
            docs = [waiting[p].pop() for p, k in parts for _ in range(k)]
            sequence, room = [], length
            for d in docs:
                size = int(rest[d])
                fits = min(size, room)
                if fits:
                    sequence.append((d, start[d], fits))
                if fits < size:
                    ends.append((d, start[d] + fits, size - fits))
                room -= fits
            done.append(sequence)
            if room:
                open_.append((sequence, room))
    for sequence, room in open_:
        while room and ends:
            d, s, n = ends.pop()
            sequence.append((d, s, min(n, room)))
            if n > room:
                ends.append((d, s + room, n - room))
            room -= min(n, room)
    residual = [(d, start[d], int(rest[d])) for p in sorted(waiting, reverse=True) for d in waiting[p]] + ends
    sequence, room = [], length
    for d, s, n in residual:
        while n:
            fits = min(n, room)
            sequence.append((d, s, fits))
            s, n, room = s + fits, n - fits, room - fits
            if not room:
                done.append(sequence)
                sequence, room = [], length
    return done + _powers(sequence, length - room)


def _powers(pieces: list[Piece], total: int) -> list[list[Piece]]:
    """``pieces`` laid out in sequences whose lengths are the powers of two that add up to ``total``."""
    out = []
    pieces = pieces[::-1]
    for power in (1 << k for k in reversed(range(total.bit_length()))):
        if not total & power:
            continue
        sequence, room = [], power
        while room:
            d, s, n = pieces.pop()
            sequence.append((d, s, min(n, room)))
            if n > room:
                pieces.append((d, s + room, n - room))
            room -= min(n, room)
        out.append(sequence)
    return out


def _packed(
    tokenizer: str, end_id: int, length: int, with_ids: bool
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
        encode = encoder(tokenizer)
        end = np.array([end_id], encode.dtype)
        docs, ids, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs.append(doc)
                ids.append(np.concatenate([encode.ids(text.as_py()), end]))
                size += len(ids[-1])
                if len(docs) >= WINDOW_DOCS or size >= WINDOW_IDS:
                    yield docs, ids
                    docs, ids, size = [], [], 0
        if docs:
            yield docs, ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for docs, ids in windows(batches):
            lengths = np.array([len(x) for x in ids], np.int64)
            sequences = plan(lengths, length)
            for first in range(0, len(sequences), 2048):
                rows: list[tuple] = []
                for sequence in sequences[first : first + 2048]:
                    offset = 0
                    for d, s, n in sequence:
                        data = ids[d][s : s + n].astype("<u4").tobytes()
                        row = (docs[d], s, n, zlib.crc32(data), int(lengths[d]), number, offset)
                        rows.append((*row, data) if with_ids else row)
                        offset += n
                    number += 1
                names = [x.split()[0] for x in (PIECES + IDS * with_ids).split(", ")]
                types = [pa.int64()] * 7 + [pa.binary()] * with_ids
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
IDS = ", ids binary"


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = TOKENIZER,
    end_id: int = END_ID,
    length: int = LENGTH,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: where it is in its document and in its sequence, and, if asked, its ids (little-endian)."""
    if length % STEPS:
        raise ValueError(f"the length of a sequence must be a multiple of {STEPS}")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_packed(tokenizer, end_id, length, with_ids), PIECES + IDS * with_ids)
