"""Removal of repeated byte strings, found in suffix arrays.

A byte goes if a string of ``least`` bytes that covers it also starts earlier: in a document with a smaller doc_id, or
in the same document before. All strings are judged on the input.

1. Each string of ``least`` bytes has an anchor: its 32-byte piece with the least hash, the leftmost of equal ones.
   Strings that follow each other mostly share theirs, so a document falls into runs of strings by anchor, about one
   for 35 bytes. Equal strings have equal anchors, so only runs whose anchors have equal content can repeat each
   other. Runs travel as 33 bytes each, packed by the hash of the anchor's content.
2. Where runs of one content are equal as a whole, all but the earliest are repeated, wherever they stand. Of the
   others only the earliest of each kind is looked at further.
3. The bytes of these are fetched from their documents and sharded by content. Each shard's suffix array is made by
   induced sorting; neighbours in it whose permuted common prefix reaches ``least`` hold the same string, and all
   but the earliest of these are repeated.
4. An anchor that many runs share (a line or passage of many documents, with other text around it in each) would make
   one shard that grows with the corpus. Where the differing runs of an anchor, counted over all chunks, have more bytes
   than a shard, step 3 deals them by the content of each string instead; the earliest of equal strings in a piece stands
   for all of them. Where a chunk alone has many, their short rows too are dealt in step 2, by their whole content.
5. Repeated strings go back to their documents as spans.

Contents of anchors and runs are compared by 64-bit hashes in steps 1, 2 and 4, bytes by themselves in step 3.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import pieces, plain_texts, staged, text_key
from vellum.llm.suffixes import permuted_prefixes, suffix_array

PIECE = 32
RUN = np.dtype([("key", "<u4"), ("whole", "<u8"), ("doc", "<i8"), ("text", "<i8"), ("first", "<u4"), ("n", "u1")])
GONE = np.dtype([("doc", "<i8"), ("text", "<i8"), ("first", "<u4"), ("after", "<u4")])
#: Bytes of texts that are cut into runs at once, and of a shard's suffix array.
CHUNK, SHARD = 1_000_000, 500_000
#: Differing runs of one anchor in a chunk from which on their rows are dealt, and the mark of a dealt run in n.
HOT, DEALT = 32, 128
NO_ID = np.iinfo(np.int64).min
SPANS = "kind long, key long, doc long, text long, first long, after long"
STEP, BACK = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def piece_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the PIECE bytes from each place on; data has at least so many."""
    n = len(data) - 7
    eight = np.empty(n, np.uint64)
    raw = data.tobytes()
    for k in range(8):
        part = np.frombuffer(raw, "<u8", (len(raw) - k) // 8, k)
        eight[k::8] = part[: len(eight[k::8])]
    last = len(data) - PIECE + 1
    total = np.zeros(last, np.uint64)
    for i, k in enumerate(range(0, PIECE, 8)):
        total = (total + eight[k : k + last]) * np.uint64(0xC2B2AE3D27D4EB4F + 2 * i)
        total ^= total >> np.uint64(29)
    return mixed(total)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hashes:
    """Hashes of the PIECE bytes from each place of data on, and of any stretch of these."""

    def __init__(self, data: np.ndarray):
        self.pieces = piece_hashes(data)
        up = powers(STEP, len(self.pieces) + 1)
        self.down = powers(BACK, len(self.pieces) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.pieces * up[:-1], dtype=np.uint64)])

    def strings(self, first: np.ndarray, n: np.ndarray, least: int) -> np.ndarray:
        """Of the n strings of ``least`` bytes that begin at first and after it."""
        end = first + n + least - PIECE
        return mixed((self.sums[end] - self.sums[first]) * self.down[first] + n.astype(np.uint64))


def runs_of(data: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """RUN rows of documents joined in data, without doc and text; the anchors' hashes, and which document has the run."""
    size = np.diff(bounds)
    if len(data) < least or not (size >= least).any():
        return np.empty(0, RUN), np.empty(0, np.uint64), np.empty(0, np.int64)
    hashes = Hashes(data)
    short = (hashes.pieces >> np.uint64(32)).astype(np.uint32)
    width = least - PIECE + 1
    best, reach = np.arange(len(short)), 1
    while reach < width:
        move = min(reach, width - reach)
        a, b = best[:-move], best[move:]
        best = np.where(short[a] <= short[b], a, b)
        reach += move
    start = np.arange(len(best))
    doc = np.searchsorted(bounds, start, "right") - 1
    inside = start + least <= bounds[doc + 1]
    start, doc, anchor = start[inside], doc[inside], best[inside]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(start)))
    first, doc, anchor = start[at], doc[at], anchor[at]
    out = np.zeros(len(at), RUN)
    out["whole"] = hashes.strings(first, n, least)
    out["first"], out["n"] = first - bounds[doc], n
    return out, hashes.pieces[anchor], doc


def joined_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Rows of batches whose second column is a text, with their bytes joined and where each begins, CHUNK bytes at once."""
    for some in pieces(batches, 1, size=CHUNK):
        own = plain_texts(some.column(1)).cast(pa.large_binary())
        size = pc.binary_length(own).to_numpy().astype(np.int64)
        yield np.frombuffer(b"".join(own.to_pylist()), np.uint8), np.concatenate([[0], np.cumsum(size)]), some


def changes(rows: np.ndarray, *names: str) -> np.ndarray:
    """Where any of these fields differs from that of the row before; the first row counts as such."""
    out = np.ones(len(rows), bool)
    out[1:] = np.logical_or.reduce([rows[k][1:] != rows[k][:-1] for k in names])
    return out


def packed_runs(docs: DataFrame, least: int, parts: int) -> DataFrame:
    """Runs by part, and with them spans that are repeated within a chunk already. A hot anchor sends its runs to the
    parts of their wholes, and one run of no strings to its own part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, bounds, some in joined_texts(batches):
            rows, anchors, own = runs_of(data, bounds, least)
            if not len(rows):
                continue
            rows["doc"], rows["text"] = (some.column(k).to_numpy()[own] for k in (0, 2))
            part = ((anchors >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
            rows["key"] = (anchors ^ anchors >> np.uint64(41)).astype(np.uint32)
            by = np.lexsort((rows["first"], rows["text"], rows["doc"], rows["whole"], rows["key"], part))
            rows, part = rows[by], part[by]
            key = changes(rows, "key")
            key[1:] |= part[1:] != part[:-1]
            kind = key | changes(rows, "whole")
            gone = merged(spans(rows[~kind & changes(rows, "doc", "text", "first")], least))
            group = np.cumsum(key) - 1
            hot = np.bincount(group[kind]) >= HOT
            marks = rows[key][hot]
            marks["n"], marks["whole"] = 0, 0
            rows["n"][hot[group]] |= DEALT
            there = np.where(hot[group], (rows["whole"] >> np.uint64(20)) % np.uint64(parts), part).astype(np.int64)
            rows, part = np.concatenate([rows[kind], marks]), np.concatenate([there[kind], part[key][hot]])
            by = np.argsort(part, kind="stable")
            rows, part = rows[by], part[by]
            there, first = np.unique(part, return_index=True)
            ends = [*first[1:].tolist(), len(part)]
            packed = [rows[a:b].tobytes() for a, b in zip(first.tolist(), ends, strict=True)]
            with_gone = [b""] * len(there)
            with_gone[int(rows["whole"][0] % np.uint64(len(there)))] = gone.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(packed, pa.binary()), pa.array(with_gone, pa.binary())], ["part", "runs", "gone"])

    return docs.mapInArrow(run, "part long, runs binary, gone binary")


def spans(rows: np.ndarray, least: int) -> np.ndarray:
    out = np.empty(len(rows), GONE)
    for k in ("doc", "text", "first"):
        out[k] = rows[k]
    out["after"] = rows["first"] + (rows["n"] & (DEALT - 1)).astype(np.uint32) - 1 + np.uint32(least)
    return out


def merged(rows: np.ndarray) -> np.ndarray:
    """GONE rows with those of one document that touch or overlap as one."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows["first"], rows["text"], rows["doc"]))]
    base = (np.cumsum(changes(rows, "doc", "text")) << 33).astype(np.int64)
    reach = np.maximum.accumulate(base + rows["after"])
    new = np.ones(len(rows), bool)
    new[1:] = base[1:] + rows["first"][1:] > reach[:-1]
    at = np.flatnonzero(new)
    out = rows[at]
    last = np.append(at[1:], len(rows)) - 1
    out["after"] = (reach - base)[last]
    return out


def span_batch(rows: np.ndarray, kind: int = 0, key: np.ndarray | None = None) -> pa.RecordBatch:
    """kind 0: spans that are repeated; 1: to be compared by key; 2: to be compared string by string."""
    zero = np.zeros(len(rows), np.int64)
    columns = [zero + kind, zero if key is None else key, *(rows[k].astype(np.int64) for k in ("doc", "text", "first", "after"))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "key", "doc", "text", "first", "after"])


def settled(packed: DataFrame, least: int, shard: int = SHARD) -> DataFrame:
    """SPANS of a part's runs: repeated ones, and the earliest of each kind that must be compared further: by anchor, or
    string by string where those of an anchor have more than ``shard`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now = None

        def done() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held)
            rows = rows[np.lexsort((rows["first"], rows["text"], rows["doc"], rows["whole"], rows["n"] >= DEALT, rows["key"]))]
            key = changes(rows, "key")
            kind = key | changes(rows, "whole")
            kind[1:] |= (rows["n"][1:] >= DEALT) != (rows["n"][:-1] >= DEALT)
            for some in np.array_split(merged(spans(rows[~kind & (rows["n"] > 0) & changes(rows, "doc", "text", "first")], least)), 1 + len(rows) // 100_000):
                if len(some):
                    yield span_batch(some)
            group = np.cumsum(key) - 1
            mark, dealt = rows["n"] == 0, rows["n"] >= DEALT
            hot = np.bincount(group, mark) > 0
            kinds = np.bincount(group[kind & ~mark & ~dealt], minlength=group[-1] + 1)
            # an anchor's runs are all here, unless it is hot
            hot |= np.bincount(group, (kind & ~mark & ~dealt) * (rows["n"].astype(np.int64) + least - 1)) > shard
            one_by_one = kind & ~mark & (dealt | hot[group])
            open_ = kind & ~mark & ~dealt & ~hot[group] & (kinds[group] > 1)
            for code, which in ((1, open_), (2, one_by_one)):
                for some in np.array_split(rows[which], 1 + len(rows) // 100_000):
                    if len(some):
                        yield span_batch(spans(some, least), code, some["key"].astype(np.int64) | now << 32)

        for batch in batches:
            for part, runs, gone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now and held:
                    yield from done()
                    held = []
                now = part
                held.append(np.frombuffer(runs, RUN))
                if gone:
                    yield span_batch(np.frombuffer(gone, GONE))
        if held:
            yield from done()

    return packed.mapInArrow(run, SPANS)


def repeated_in_shard(rows: list[tuple[int, int, int, bytes]], least: int) -> np.ndarray:
    """GONE rows of strings of (doc, text, first, bytes) that stand in an earlier one, or earlier in the same."""
    data = np.frombuffer(b"".join(x for *_, x in rows), np.uint8)
    size = np.array([len(x) for *_, x in rows], np.int64)
    ends = np.cumsum(size)
    array = suffix_array(data)
    prefix = permuted_prefixes(data, array, least)
    group = np.cumsum(prefix[array] < least)
    owner = np.repeat(np.arange(len(rows)), size)[array]
    ok = array + least <= ends[owner]
    array, group, owner = array[ok], group[ok], owner[ok]
    found = np.empty(len(owner), GONE)
    for k, name in enumerate(("doc", "text", "first")):
        found[name] = np.array([x[k] for x in rows], np.int64)[owner]
    found["first"] += (array - (ends - size)[owner]).astype(np.uint32)
    by = np.lexsort((found["first"], found["text"], found["doc"], group))
    found, group = found[by], group[by]
    again = np.zeros(len(group), bool)
    again[1:] = group[1:] == group[:-1]
    return joined_strings(found[again & changes(found, "doc", "text", "first")], least)


def joined_strings(found: np.ndarray, least: int) -> np.ndarray:
    """GONE rows of strings of ``least`` bytes, those that follow each other as one; found: rows without after, each place once or more."""
    found = found[np.lexsort((found["first"], found["text"], found["doc"]))]
    new = changes(found, "doc", "text")
    new[1:] |= found["first"][1:] > found["first"][:-1] + np.uint32(1)
    at = np.flatnonzero(new)
    out = found[at]
    if len(at):
        out["after"] = found["first"][np.append(at[1:], len(found)) - 1] + np.uint32(least)
    return out


def earliest(found: np.ndarray, string: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equal strings the earliest, with its hash, and the places of the others."""
    by = np.lexsort((found["first"], found["text"], found["doc"], string))
    found, string = found[by], string[by]
    new = np.ones(len(found), bool)
    new[1:] = string[1:] != string[:-1]
    return found[new], string[new], found[~new & changes(found, "doc", "text", "first")]


def compared(docs: DataFrame, open_: DataFrame, least: int, shard: int = SHARD) -> DataFrame:
    """SPANS that are repeated among open_ (kinds 1 and 2). docs: doc_id, doc, text_ and text (its key)."""
    wanted = open_.groupBy("doc", "text").agg(F.collect_list(F.struct("kind", "key", "first", "after")).alias("wanted"))
    # with the same columns as in removed(), so that documents are shuffled once for both joins
    both = docs.join(wanted, ["doc", "text"]).select("doc", "text_", "text", "wanted", "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kind 0: repeated spans; 1: a run's bytes; 2: a string, as key."""
        for data, bounds, some in joined_texts(batches):
            raw = data.tobytes()
            rows, alone, strings = [], [], []
            for doc, begin, text, own in zip(some.column(0).to_pylist(), bounds[:-1].tolist(), some.column(2).to_pylist(), some.column(3).to_pylist(), strict=True):
                for x in own:
                    part = raw[begin + x["first"] : begin + x["after"]]
                    if x["kind"] == 1:
                        rows.append((1, x["key"], doc, text, x["first"], part))
                    else:
                        alone.append((doc, text, x["first"], 0))
                        strings.append(part)
            if rows:
                yield bytes_batch(*zip(*rows, strict=True))
            if alone:
                size = np.array([len(x) for x in strings], np.int64)
                n, ends = size - least + 1, np.cumsum(size)
                inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                found = np.repeat(np.array(alone, GONE), n)
                found["first"] += inside.astype(np.uint32)
                place = np.repeat(ends - size, n) + inside
                string = Hashes(np.frombuffer(b"".join(strings), np.uint8)).strings(place, np.ones(len(place), np.int64), least)
                kept, string, again = earliest(found, string)
                yield bytes_batch(np.full(len(kept), 2), string.view(np.int64), kept["doc"], kept["text"], kept["first"].astype(np.int64), [None] * len(kept))
                again = joined_strings(again, least)
                if len(again):
                    after = [int(x).to_bytes(4, "little") for x in again["after"]]
                    yield bytes_batch(np.zeros(len(again), np.int64), np.arange(len(again)), again["doc"], again["text"], again["first"].astype(np.int64), after)

    def bytes_batch(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.binary())], ["kind", "key", "doc", "text", "first", "bytes"])

    rows = both.mapInArrow(cut, "kind long, key long, doc long, text long, first long, bytes binary")
    rows = rows.repartition("kind", "key").sortWithinPartitions("kind", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size, last = 0, None
        carried = np.empty(0, GONE), np.empty(0, np.int64)
        for batch in batches:
            kinds, keys = (batch.column(k).to_numpy() for k in (0, 1))
            found = np.zeros(len(kinds), GONE)
            for k, name in enumerate(("doc", "text", "first")):
                found[name] = batch.column(2 + k).to_numpy()
            done = found[kinds == 0]
            done["after"] = [int.from_bytes(x, "little") for x in batch.column(5).filter(pa.array(kinds == 0)).to_pylist()]
            if len(done):
                yield span_batch(done)
            for _, key, doc, text, first, own in zip(*(c.to_pylist() for c in batch.filter(pa.array(kinds == 1)).columns), strict=True):
                if size >= shard and key != last:
                    yield span_batch(repeated_in_shard(held, least))
                    held, size = [], 0
                held.append((doc, text, first, own))
                size += len(own)
                last = key
            if (kinds == 2).any():
                # rows come in the order of strings, which may go on in the next batch: the earliest of the last is carried on
                kept, string, again = earliest(np.concatenate([carried[0], found[kinds == 2]]), np.concatenate([carried[1], keys[kinds == 2]]))
                at = string == keys[kinds == 2][-1]
                carried = kept[at], string[at]
                yield span_batch(joined_strings(again, least))
        if held:
            yield span_batch(repeated_in_shard(held, least))

    return rows.mapInArrow(run, SPANS).select("doc", "text", "first", "after")


def removed(docs: DataFrame, least: int = 100, shard: int = SHARD) -> DataFrame:
    """doc_id, spans (sorted maximal removed runs of bytes, as first and after), and text and kept as binary.

    docs: doc_id and text; other columns are ignored. A null text is empty. Rows that share a doc_id are documents of
    their own, told apart by their texts and in the order of the texts' hashes; rows that repeat both doc_id and text
    are one document and each lose the same bytes. Null ids come before all others. Texts of fewer bytes than
    ``least`` keep all; empty tables give no rows. shard: bytes that a suffix array is made of, at most twice as many.
    """
    named = docs.select("doc_id", F.coalesce("doc_id", F.lit(int(NO_ID))).alias("doc"), F.col("text").alias("text_"), text_key(F.col("text")).alias("text"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the same number of parts for each task, which their hashes wouldn't give
    packed = packed_runs(named.select("doc", "text_", "text"), least, 8 * tasks).repartitionById(tasks, (F.col("part") % tasks).cast("int")).sortWithinPartitions("part")
    found = staged(settled(packed, least, shard), "runs")
    more = compared(named, found.where("kind > 0"), least, shard)
    gone = found.where("kind = 0").select("doc", "text", "first", "after").unionByName(more)
    gone = gone.groupBy("doc", "text").agg(F.collect_list(F.struct("first", "after")).alias("gone"))
    both = named.join(gone, ["doc", "text"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in pieces(batches, 1):
            merged, texts, kept = [], [], []
            for text, own in zip(some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True):
                raw = (text or "").encode()
                out: list[dict[str, int]] = []
                for first, after in sorted((x["first"], x["after"]) for x in own or ()):
                    if out and first <= out[-1]["after"]:
                        out[-1]["after"] = max(after, out[-1]["after"])
                    else:
                        out.append({"first": first, "after": after})
                ends = [0, *[x["after"] for x in out]]
                starts = [*[x["first"] for x in out], len(raw)]
                merged.append(out)
                texts.append(raw)
                kept.append(b"".join(raw[a:b] for a, b in zip(ends, starts, strict=True)))
            kind = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [some.column(0), pa.array(merged, kind), pa.array(texts, pa.binary()), pa.array(kept, pa.binary())], ["doc_id", "spans", "bytes", "kept"]
            )

    return both.select("doc_id", "text_", "gone", "doc", "text").mapInArrow(cut, "doc_id long, spans array<struct<first:long,after:long>>, bytes binary, kept binary")


def report(docs: DataFrame) -> DataFrame:
    n = F.octet_length("bytes").cast("long")
    return removed(docs).select(
        "doc_id", n.alias("n_bytes"), (n - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


ORACLE_SQL = """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), w AS (
  SELECT doc_id, i, md5(array_slice(b, i, i + 99)) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 98)) AS i FROM b WHERE octet_length(b) >= 100)
), again AS (
  SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1
), marked AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM again
), spans AS (
  SELECT doc_id, min(i) AS first, max(i) + 100 AS after FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked) GROUP BY doc_id, k
), cuts AS (
  SELECT doc_id, coalesce(lag(after) OVER (PARTITION BY doc_id ORDER BY first), 1) AS a, first AS z FROM spans
  UNION ALL SELECT b.doc_id, coalesce(max(after), 1), any_value(octet_length(b)) + 1 FROM b LEFT JOIN spans USING (doc_id) GROUP BY b.doc_id
), kept AS (
  SELECT doc_id, sha256(unhex(string_agg(CASE WHEN z > a THEN hex(array_slice(b, a, z - 1)) ELSE '' END, '' ORDER BY a))) AS kept_sha256 FROM cuts JOIN b USING (doc_id) GROUP BY doc_id
), sums AS (SELECT doc_id, sum(after - first) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT b.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256
FROM b JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""
