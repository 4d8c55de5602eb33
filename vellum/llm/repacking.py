"""Packing of tokenised documents into as few sequences as possible, certified by lower bounds.

Each task packs the pieces of its own documents by best-fit decreasing, unit by unit of bounded size, and compares the
number of its sequences with lower bounds from dual-feasible functions: f with sum(f(x)) <= 1 for all lengths that fit
into one sequence, so that no packing has fewer than sum(f(lengths)) sequences. A unit that meets its bound is certified.

Where all sequences together are more than the bound of all lengths, units with a gap give up the sequences that aren't
full, and certified ones the emptiest of theirs. These pieces are dealt anew, and packed and bounded again, until the
bound of all lengths is met or a round gains nothing. Texts are read and tokenised once; only the short rows of pieces
travel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import pieces, staged
from vellum.llm.packing import tokenizer_at

PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, moves boolean, certified boolean"
NAMES = [x.split()[0] for x in PLACED.split(", ")]
#: Sequence ids: the round, the task, and a count within it.
ROUND, TASK = 58, 36


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each length and its place there, by best-fit decreasing: each goes to the fullest bin with room for it,
    longer ones first, equal ones in the order given."""
    bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    # bit r: a bin has room for just r more
    rooms, made = 0, 0
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            same = with_room[room]
            bin_ = same.pop()
            if not same:
                rooms ^= 1 << room
        else:
            bin_, room = made, capacity
            made += 1
        bins[i], places[i] = bin_, capacity - room
        left = room - n
        if left:
            with_room[left].append(bin_)
            rooms |= 1 << left
    return bins, places


def least_bins(counts: np.ndarray, capacity: int, most_k: int = 64) -> int:
    """The largest of the lower bounds of three families of dual-feasible functions, in whole numbers. counts: how many
    pieces there are of each length from 0 to capacity.

    1. x, with lengths of over capacity - e as a whole bin and those under e as nothing, for each e up to half.
    2. floor((k + 1) x) / k, or x where (k + 1) x is whole, for k up to most_k.
    3. 1 / q for lengths from e to half, q = floor(capacity / e), and 1 - floor((capacity - x) / e) / q for longer ones,
       for e = floor(capacity / j), j up to most_k.
    """
    counts = counts.astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    up = lambda total, unit: int(-(-int(total) // unit))
    weight, many = np.cumsum(counts * x), np.cumsum(counts)
    e = np.arange(1, capacity // 2 + 1)
    whole = (many[-1] - many[capacity - e]) * capacity + weight[capacity - e] - weight[e - 1]
    best = max(up(weight[-1], capacity), up(whole.max(initial=0), capacity))
    for k in range(1, most_k + 1):
        value = np.where((k + 1) * x % capacity == 0, k * x, (k + 1) * x // capacity * capacity)
        best = max(best, up((counts * value).sum(), k * capacity))
    for j in range(2, min(most_k, capacity) + 1):
        e = capacity // j
        q = capacity // e
        value = np.where(2 * x > capacity, q - (capacity - x) // e, np.where(x >= e, 1, 0))
        best = max(best, up((counts * value).sum(), q))
    return best


def packed(rows: list[np.ndarray], capacity: int, first_id: int) -> tuple[pa.RecordBatch, int]:
    """PLACED rows of pieces (their doc_id, whether it is null, piece, start, length, crc) packed as a unit, and the
    number of sequences. moves: where the unit has a gap, all pieces of sequences that aren't full; else those of the
    emptiest, if it isn't full."""
    doc_id, null, piece, start, length, crc = rows
    bins, places = best_fit(length, capacity)
    n = int(bins.max()) + 1
    certified = n == least_bins(np.bincount(length, minlength=capacity + 1), capacity)
    room = capacity - np.bincount(bins, length, n).astype(np.int64)
    moving = room > 0
    if certified:
        moving &= np.arange(n) == room.argmax()
    columns = [pa.array(doc_id, pa.int64(), mask=null), pa.array(piece, pa.int32()), *(pa.array(c) for c in (start, length, crc, first_id + bins, places, moving[bins], np.full(len(bins), certified)))]
    return pa.RecordBatch.from_arrays(columns, NAMES), n


def in_pieces(some: pa.RecordBatch, coder, capacity: int, end_id: int) -> list[np.ndarray]:
    """doc_id, whether it is null, piece, start, length and crc of the pieces of a batch of (doc_id, text)."""
    ids, first = coder.encode(some.column(1))
    raw = memoryview(np.insert(ids, first[1:], end_id).astype("<u4").tobytes())
    begin = first + np.arange(len(first))
    n = np.diff(begin)
    many = -(-n // capacity)
    doc = np.repeat(np.arange(len(n)), many)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    start = piece * capacity
    length = np.minimum(n[doc] - start, capacity)
    at = (begin[doc] + start) * 4
    crc = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist(), strict=True)), np.int64, len(doc))
    ids_ = some.column(0)
    return [ids_.fill_null(0).to_numpy()[doc], ids_.is_null().to_numpy(zero_copy_only=False)[doc], piece, start, length, crc]


def repack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, unit: int = 100_000, rounds: int = 8) -> DataFrame:
    """One row per piece of a document: which sequence it lies in and where, and whether its sequence is of a certified unit.

    docs: doc_id and text; other columns are ignored. A document's ids are those of its text and end_id; those longer
    than the capacity are cut at its multiples. A null or empty text has end_id alone. Rows that share a doc_id, or have
    none, are documents of their own. Equal lengths are packed in the order of the rows. An empty table gives no rows.
    unit: pieces that one packing has at most, which bounds a task's memory. rounds: of exchange, at most.
    """

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task = tokenizer_at(tokenizer_path), TaskContext.get().partitionId()
        held: list[list[np.ndarray]] = []
        size = made = 0

        def done() -> pa.RecordBatch:
            nonlocal size, made
            out, n = packed([np.concatenate(c) for c in zip(*held, strict=True)], capacity, (task << TASK) + made)
            held.clear()
            size, made = 0, made + n
            return out

        for some in pieces(batches, 1):
            new = in_pieces(some, coder, capacity, end_id)
            for i in range(0, len(new[0]), unit):
                part = [c[i : i + unit] for c in new]
                if size and size + len(part[0]) > unit:
                    yield done()
                held.append(part)
                size += len(part[0])
        if held:
            yield done()

    def again(round_: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(list(batches) or [pa.RecordBatch.from_pylist([], PIECES)])
            # a task that runs again may get its rows in another order
            rows = rows.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).combine_chunks()
            base = (round_ << ROUND) + (TaskContext.get().partitionId() << TASK)
            made = 0
            for i in range(0, rows.num_rows, unit):
                some = rows.slice(i, unit)
                null = some.column("doc_id").is_null().to_numpy()
                numbers = [some.column(c).to_numpy() for c in NAMES[1:5]]
                out, n = packed([some.column("doc_id").fill_null(0).to_numpy(), null, *numbers], capacity, base + made)
                made += n
                yield out

        return run

    now = staged(docs.select("doc_id", "text").mapInArrow(first_pass, PLACED), "packed")
    lengths = np.zeros(capacity + 1, np.int64)
    for n, many in now.groupBy("length").count().collect():
        lengths[n] = many
    bound = least_bins(lengths, capacity)
    sequences = lambda df: df.where("offset = 0").count()
    total = sequences(now)
    settled = []
    for round_ in range(1, rounds + 1):
        if total <= bound:
            break
        moving = now.where("moves")
        many, before = moving.agg(F.count("*"), F.count(F.when(F.col("offset") == 0, 1))).first()
        if before < 2:
            break
        key = F.xxhash64("sequence_id", "offset", F.lit(round_))
        dealt = moving.select(NAMES[:7]).repartition(-(-many // unit), key)
        new = staged(dealt.mapInArrow(again(round_), PLACED), "packed")
        after = sequences(new)
        if after >= before:
            break
        settled.append(now.where("NOT moves"))
        now, total = new, total - before + after
    for part in settled:
        now = now.unionByName(part)
    return now.drop("moves")


PIECES = pa.schema([(n, pa.int32() if n == "piece" else pa.int64()) for n in NAMES[:7]])
