"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

Lengths fall into reciprocal classes: class k holds lengths in (C/(k+1), C/k], and a bin of class k
takes exactly k of them. Each worker packs the documents of its own partition and asks nobody else,
so there is no shuffle and a lost task is run again with the same outcome.

A length that would leave more than ``slack`` of a bin of its class unused is cut at the upper bound of the
next class, C // (k+1), of which k+1 fill a bin; the rest is classed anew. Bins that are not full when the
worker's documents end are laid end to end and cut at the capacity; what then remains is cut into powers of
two, which need no padding. Padding is thus at most ``slack`` of the harmonic bins.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from vellum.llm.common import pieces, plain_texts

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PIECES_IDS = f"{PIECES}, ids array<int>"
#: Room for the pieces of one task: sequence ids are the task's number times this, plus a count.
PER_TASK = 1 << 36


class PairTable:
    """Ranks and results of the merges of a byte-pair vocabulary, looked up for whole arrays of symbol pairs."""

    BITS = 20
    NONE = np.int32(2**31 - 1)

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray):
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.ranks = np.full(1 << self.BITS, self.NONE, np.int32)
        self.made = np.zeros(1 << self.BITS, np.int32)
        keys, todo, self.probes = left.astype(np.int64) << 20 | right, np.arange(len(left)), 0
        while len(todo):
            slot = self.slot(keys[todo], self.probes)
            free = self.keys[slot] == -1
            _, first = np.unique(np.where(free, slot, -1), return_index=True)
            first = first[free[first]]
            at, who = slot[first], todo[first]
            self.keys[at], self.ranks[at], self.made[at] = keys[who], who, made[who]
            todo = np.delete(todo, first)
            self.probes += 1

    def slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)
        return (mixed.astype(np.int64) + probe) & ((1 << self.BITS) - 1)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = (left.astype(np.int64) << 20 | right).ravel()
        slot = self.slot(keys, 0)
        for probe in range(1, self.probes):
            wrong = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != -1))
            if not len(wrong):
                break
            slot[wrong] = self.slot(keys[wrong], probe)
        same = self.keys[slot] == keys
        return np.where(same, self.ranks[slot], self.NONE).reshape(left.shape), self.made[slot].reshape(left.shape)


class WordTokenizer:
    """Ids of whole texts, made from the ids of their distinct words.

    The vocabulary drops white space, so the ids of a text are those of its white-space-separated words, one
    after the other. Each distinct word is encoded once and kept; the store is emptied when it holds ``keep``
    words. Short words of Latin letters are merged here, all of a batch at once, by the vocabulary's own ranks;
    all others go to the tokenizer, and so do, whole, texts with ``<|``, which may begin a special token.
    """

    SEPARATOR = "<|endoftext|>"
    LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]{1,30}")
    LONGEST = 32

    def __init__(self, path: str, keep: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.separator = self.tokenizer.token_to_id(self.SEPARATOR)
        self.keep = keep
        self.known: dict[str, bytes] = {"": b""}
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab = model["vocab"]
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        as_ids = lambda xs: np.array([vocab[x] for x in xs], np.int32)
        self.pairs = PairTable(as_ids(a for a, _ in pairs), as_ids(b for _, b in pairs), as_ids(a + b for a, b in pairs))
        # a byte stands as itself where it prints, else as the next code point from 256 on
        prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*prints}))}
        self.inner, self.last = as_ids(shown[b] for b in range(256)), as_ids(shown[b] + "</w>" for b in range(256))

    def merged(self, new: list[str]) -> None:
        raw = [w.encode() for w in new]
        n = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        width = int(n.max())
        symbols = np.zeros((len(raw), width), np.int32)
        inside = np.arange(width) < n[:, None]
        symbols[inside] = self.inner[flat]
        symbols[np.arange(len(raw)), n - 1] = self.last[flat[np.cumsum(n) - 1]]
        ranks, made = np.full((len(raw), width), PairTable.NONE), np.zeros((len(raw), width), np.int32)
        if width > 1:
            ranks[:, :-1], made[:, :-1] = self.pairs.find(symbols[:, :-1], symbols[:, 1:])
        ranks[np.arange(width) >= n[:, None] - 1] = PairTable.NONE
        rows, steps = np.arange(len(raw)), np.arange(width)
        while len(rows):
            at = ranks[rows].argmin(1)
            go = ranks[rows, at] != PairTable.NONE
            rows, at = rows[go], at[go]
            if not len(rows):
                break
            symbols[rows, at] = made[rows, at]
            after = np.minimum(steps + (steps > at[:, None]), width - 1)
            symbols[rows] = np.take_along_axis(symbols[rows], after, 1)
            after = np.minimum(steps + (steps >= at[:, None]), width - 1)
            ranks[rows] = np.take_along_axis(ranks[rows], after, 1)
            made[rows] = np.take_along_axis(made[rows], after, 1)
            n[rows] -= 1
            for first in (at - 1, at):
                ok = (first >= 0) & (first < n[rows] - 1)
                r, c = rows[ok], first[ok]
                ranks[r, c], made[r, c] = self.pairs.find(symbols[r, c], symbols[r, c + 1])
            end = at >= n[rows] - 1
            ranks[rows[end], at[end]] = PairTable.NONE
            ranks[rows, n[rows] - 1] = PairTable.NONE
        parts = symbols[np.arange(width) < n[:, None]].tobytes()
        ends = (np.cumsum(n) * 4).tolist()
        begin = 0
        for word, end in zip(new, ends, strict=True):
            self.known[word] = parts[begin:end]
            begin = end

    def coded(self, new: list[str], block: int = 256) -> None:
        blocks = [new[i : i + block] for i in range(0, len(new), block)]
        texts = [self.SEPARATOR.join(x) for x in blocks]
        for some, coded in zip(blocks, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(coded.ids, np.int32)
            parts = np.split(ids, np.flatnonzero(ids == self.separator))
            for word, part in zip(some, parts, strict=True):
                self.known[word] = (part[1:] if len(part) and part[0] == self.separator else part).tobytes()

    def learn(self, new: list[str]) -> None:
        if len(self.known) + len(new) > self.keep:
            self.known = {"": b""}
        letters, others = [], []
        for w in new:
            (letters if self.LETTERS.fullmatch(w) else others).append(w)
        letters.sort(key=len)
        for i in range(0, len(letters), 20_000):
            self.merged(letters[i : i + 20_000])
        self.coded(others)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's ids begin (one more than there are texts)."""
        texts = plain_texts(texts)
        odd = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        plain = pc.ascii_lower(pc.if_else(pa.array(odd), "", texts))
        # a single stop or comma that ends a word is a token of its own anyway
        plain = pc.replace_substring_regex(plain, r"([a-z])([.,])([\x20\x09-\x0D])", r"\1 \2\3")
        split = pc.ascii_split_whitespace(plain)
        coded, bounds = split.flatten().dictionary_encode(), split.offsets.to_numpy()
        names, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if new := [w for w in names if w not in self.known]:
            if len(self.known) + len(new) > self.keep:
                self.known, new = {"": b""}, [w for w in names if w]
            self.learn(new)
        parts = [self.known[w] for w in names]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        begin = np.cumsum(sizes) - sizes
        pool = np.frombuffer(b"".join(parts), np.int32)
        n = sizes[at]
        ends = np.cumsum(n)
        ids = pool[np.repeat(begin[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        first = np.concatenate([[0], ends])[bounds - bounds[0]]
        if odd.any():
            pieces = np.split(ids, first[1:-1])
            for i in np.flatnonzero(odd):
                pieces[i] = np.array(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.int32)
            ids = np.concatenate(pieces)
            first = np.concatenate([[0], np.cumsum([len(x) for x in pieces])])
        return ids, first


@functools.lru_cache(maxsize=1)
def tokenizer_at(path: str) -> WordTokenizer:
    """One tokenizer a worker, with the words that its earlier tasks met."""
    return WordTokenizer(path)


def cuts(length: int, capacity: int, slack: float) -> list[tuple[int, int]]:
    """(class, length) of the pieces that a document of so many tokens is cut into, in order."""
    out = [(1, capacity)] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if k * rest >= (1 - slack) * capacity:
            out.append((k, rest))
            break
        out.append((k + 1, capacity // (k + 1)))
        rest -= capacity // (k + 1)
    return out


class HarmonicPacker:
    """Bins of one worker; add() gives the finished sequences, close() those that were still open."""

    def __init__(self, capacity: int, slack: float):
        self.capacity, self.slack = capacity, slack
        self.open: dict[int, list[tuple]] = {}
        self.known: dict[int, list[tuple[int, int]]] = {}

    def add(self, key: int, length: int) -> Iterator[list[tuple[int, int, int]]]:
        """Pieces are (document's key, start, length)."""
        pieces = self.known.get(length)
        if pieces is None:
            pieces = cuts(length, self.capacity, self.slack)
            if len(self.known) < 100_000:
                self.known[length] = pieces
        start = 0
        for k, n in pieces:
            bin_ = self.open.setdefault(k, [])
            bin_.append((key, start, n))
            start += n
            if len(bin_) == k:
                yield self.open.pop(k)

    def close(self) -> Iterator[list[tuple[int, int, int]]]:
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        total = sum(n for _, _, n in left)
        sizes = [self.capacity] * (total // self.capacity)
        sizes += [1 << b for b in range(self.capacity.bit_length(), -1, -1) if (total % self.capacity) >> b & 1]
        pieces, at = iter(left), None
        for size in sizes:
            out = []
            while size:
                key, start, n = at or next(pieces)
                take = min(n, size)
                out.append((key, start, take))
                size -= take
                at = (key, start + take, n - take) if n > take else None
            yield out


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 4096,
    end_id: int = 2,
    slack: float = 0.01,
    with_ids: bool = False,
    hold: int = 4_000_000,
) -> DataFrame:
    """One row per piece of a document: which sequence it lies in and where.

    docs: doc_id and text; other columns are ignored. A null text is empty, and its only id is end_id. Every row
    is packed by itself: rows with equal or null doc_id remain different documents. An empty table gives no rows.
    with_ids: pieces also carry their ids. hold: ids that a worker keeps before it lays the open bins end to end
    and begins anew, which bounds its memory.
    """
    place = tokenizer_path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer_at(place)
        task = TaskContext.get().partitionId()
        sequence = task * PER_TASK
        packer, kept, held, serial = HarmonicPacker(capacity, slack), {}, 0, 0
        rows: list[tuple] = []

        def put(bin_: list[tuple[int, int, int]]) -> None:
            nonlocal sequence, held
            offset = 0
            for key, start, n in bin_:
                doc_id, ids, *left = kept[key]
                part = ids[start : start + n]
                row = (doc_id, start, n, zlib.crc32(part.astype("<u4").tobytes()), len(ids), sequence, offset)
                rows.append((*row, part) if with_ids else row)
                offset += n
                kept[key] = (doc_id, ids, left[0] - n)
                if left[0] == n:
                    held -= len(ids)
                    del kept[key]
            sequence += 1

        def flush() -> pa.RecordBatch:
            names = [x.split()[0] for x in PIECES.split(", ")]
            cols = list(zip(*rows, strict=True)) or [()] * (len(names) + with_ids)
            arrays = [pa.array(c, pa.int64()) for c in cols[: len(names)]]
            if with_ids:
                arrays.append(pa.array([p.tolist() for p in cols[-1]], pa.list_(pa.int32())))
                names.append("ids")
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for some in pieces(batches, 1):
            doc_ids = some.column(0).to_pylist()
            ids, first = coder.encode(some.column(1))
            for j, doc_id in enumerate(doc_ids):
                own = np.append(ids[first[j] : first[j + 1]], np.int32(end_id))
                kept[serial] = (doc_id, own, len(own))
                held += len(own)
                for bin_ in packer.add(serial, len(own)):
                    put(bin_)
                serial += 1
                if held > hold:
                    for bin_ in packer.close():
                        put(bin_)
            if rows:
                yield flush()
        for bin_ in packer.close():
            put(bin_)
        if rows:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES_IDS if with_ids else PIECES)
