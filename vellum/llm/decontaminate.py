"""Benchmark decontamination: a prefix-filtered containment join of item windows against documents.

An item's windows are its runs of ``window`` consecutive words (one shorter window for a shorter item). A document
contains a window only if it has all of the window's words in place, so a prefix of one word is necessary and
enough; the words are ordered by rarity, counted over all documents, and each window is looked up by its rarest.
An occurrence of that word at a place of a document proposes the window at that place less the word's offset; the
window must lie inside the document (length and positional bound), and is then compared word by word.

The items are taken in blocks of bounded size, each small enough to be sent to all tasks; documents are scanned
once a block and never shuffled while one block holds all items. What several blocks find in a document is merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import NOT_WORD, pieces, plain_texts, staged, text_key

FOUND = "doc_id long, n_words long, spans array<struct<first:long,after:long>>, items array<string>"
#: Code points of items in a block: the bound of what is broadcast.
BLOCK_CHARS = 16_000_000


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and where each text's words begin (one more than there are texts)."""
    texts = pc.ascii_lower(plain_texts(texts))
    split = pc.split_pattern_regex(texts, NOT_WORD)
    flat, bounds = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
    full = pc.not_equal(flat, "")
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full), before[bounds]


class Windows:
    """The windows of a block of items as rows of word numbers, and an index of them by their rarest word."""

    def __init__(self, item_ids: list[str | None], texts: list[str | None], window: int):
        flat, bounds = split_words(pa.array(texts, pa.large_string()))
        coded = flat.dictionary_encode()
        self.vocab, ids = coded.dictionary, coded.indices.to_numpy()
        rows, lengths, owners = {}, [], []
        for item, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            for start in range(a, max(b - window, a) + 1) if b > a else ():
                key = ids[start : min(start + window, b)].tobytes()
                if key not in rows:
                    rows[key] = len(rows)
                    lengths.append(len(key) // ids.itemsize)
                    owners.append(set())
                owners[rows[key]].add(item)
        self.words = np.full((len(rows), window), -1, np.int32)
        for i, key in enumerate(rows):
            self.words[i, : lengths[i]] = np.frombuffer(key, ids.dtype)
        self.length = np.array(lengths, np.int64)
        self.owner_first = np.concatenate([[0], np.cumsum([len(x) for x in owners])]).astype(np.int64)
        self.owners = np.array([x for own in owners for x in sorted(own)], np.int64)
        self.item_ids = item_ids

    def order(self, counts: np.ndarray) -> None:
        """Index each window by its rarest word: the first of those with the least count."""
        if not len(self.words):
            return
        cost = np.where(self.words >= 0, counts[self.words], np.iinfo(np.int64).max)
        self.at = cost.argmin(1)
        prefix = self.words[np.arange(len(self.words)), self.at]
        self.by = np.argsort(prefix, kind="stable")
        n = np.bincount(prefix, minlength=len(self.vocab))
        self.first = np.concatenate([[0], np.cumsum(n)])

    def search(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences in documents whose word numbers (-1: in no item) are joined in ids: document, start, window."""
        none = np.empty(0, np.int64)
        if not len(self.words) or not len(ids):
            return none, none, none
        known = np.flatnonzero(ids >= 0)
        n = (self.first[1:] - self.first[:-1])[ids[known]]
        known, n = known[n > 0], n[n > 0]
        ends = np.cumsum(n)
        inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
        window = self.by[np.repeat(self.first[ids[known]], n) + inside]
        start = np.repeat(known, n) - self.at[window]
        doc = np.searchsorted(bounds, np.repeat(known, n), "right") - 1
        fits = (start >= bounds[doc]) & (start + self.length[window] <= bounds[doc + 1])
        doc, start, window = doc[fits], start[fits], window[fits]
        for k in range(self.words.shape[1]):
            want = self.words[window, k]
            same = (want < 0) | (ids[np.minimum(start + k, len(ids) - 1)] == want)
            doc, start, window = doc[same], start[same], window[same]
        return doc, start, window


def counted(docs: DataFrame, block: Windows) -> np.ndarray:
    """How often each word of the block stands in the documents: per batch in the tasks, then summed."""
    vocab = docs.sparkSession.sparkContext.broadcast(block.vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocab.value), np.int64)
        for some in pieces(batches, 0):
            flat, _ = split_words(some.column(0))
            at = pc.index_in(flat, vocab.value).drop_null().to_numpy()
            total += np.bincount(at, minlength=len(total))
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], ["word", "n"])

    counts = np.zeros(len(block.vocab), np.int64)
    if len(counts):
        found = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
        counts[found["word"].to_numpy()] = found["n"].to_numpy()
    return counts


def searched(docs: DataFrame, block: Windows) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = sent.value
        for some in pieces(batches, 1):
            flat, bounds = split_words(some.column(1))
            ids = pc.fill_null(pc.index_in(flat, windows.vocab), -1).to_numpy()
            doc, start, window = windows.search(ids, bounds)
            spans: list[list] = [[] for _ in range(some.num_rows)]
            items: list[set] = [set() for _ in range(some.num_rows)]
            order = np.lexsort((start, doc))
            after = start + windows.length[window] if len(window) else start
            for i in order:
                d, a, b = int(doc[i]), int(start[i] - bounds[doc[i]]), int(after[i] - bounds[doc[i]])
                if spans[d] and a <= spans[d][-1]["after"]:
                    spans[d][-1]["after"] = max(b, spans[d][-1]["after"])
                else:
                    spans[d].append({"first": a, "after": b})
                w = window[i]
                items[d].update(windows.owners[windows.owner_first[w] : windows.owner_first[w + 1]].tolist())
            named = [sorted({x for k in own if (x := windows.item_ids[k]) is not None}) for own in items]
            kind = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [some.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(spans, kind), pa.array(named, pa.list_(pa.string())), *some.columns[2:]],
                ["doc_id", "n_words", "spans", "items", *some.schema.names[2:]],
            )

    more = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    schema = FOUND + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in more)
    return docs.select("doc_id", "text", *[f"`{f.name}`" for f in more]).mapInArrow(run, schema)


def merged_spans(spans: Column) -> Column:
    """Spans sorted and joined where they meet or overlap."""

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        wider = F.struct(last["first"].alias("first"), F.greatest(last["after"], x["after"]).alias("after"))
        return F.when(
            (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["after"] >= x["first"]),
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(wider)),
        ).otherwise(F.concat(done, F.array(x)))

    empty = F.array().cast("array<struct<first:bigint,after:bigint>>")
    return F.aggregate(F.array_sort(spans), empty, step)


def item_blocks(benchmark: DataFrame, limit: int) -> Iterator[tuple[list, list]]:
    """The items, in blocks of at most so many code points (an item of more is a block of its own); one block at least."""
    ids, texts, size = [], [], 0
    for item_id, text in benchmark.select(F.col("item_id").cast("string"), "text").where("text is not null").toLocalIterator():
        if size and size + len(text) > limit:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(item_id)
        texts.append(text)
        size += len(text)
    yield ids, texts


def ordered(docs: DataFrame, ids: list, texts: list, window: int) -> Windows:
    block = Windows(ids, texts, window)
    block.order(counted(docs, block))
    return block


def find(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per document: n_words, spans of words that lie in occurrences of windows, the sorted ids of their items, and
    text_key, a hash of the text that tells rows which share a doc_id apart.

    docs: doc_id and text. benchmark: item_id and text. Other columns of either are ignored. A null text has no
    words, an item without words no window. Items with a null id hit words but aren't listed; items that repeat an
    id count once. Repeated rows of docs remain separate rows. Empty tables give no rows, or rows without hits.
    """
    blocks = item_blocks(benchmark, block_chars)
    rows = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    one, more = next(blocks), next(blocks, None)
    if more is None:
        return searched(rows, ordered(docs, *one, window))
    # rows of one id and text find the same, so they are one row, with their number, until all blocks are searched: a key
    # of their own for each row, evaluated block by block, needn't be the same in each
    def of_block(block: tuple[list, list], at: int) -> DataFrame:
        found = searched(rows, ordered(docs, *block, window)).groupBy("doc_id", "text_key").agg(
            F.first("n_words").alias("n_words"), F.first("spans").alias("spans"), F.first("items").alias("items"), F.count("*").alias("times")
        )
        return staged(found, f"found{at}")

    out, at = of_block(one, 0), 0
    while more is not None:
        at += 1
        out = out.unionByName(of_block(more, at))
        more = next(blocks, None)
    out = out.groupBy("doc_id", "text_key").agg(
        F.first("n_words").alias("n_words"), merged_spans(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.first("times").alias("times"),
    )
    return out.select("doc_id", "text_key", "n_words", "spans", "items", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy")).drop("copy")


def n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["after"] - x["first"])


def contaminated(per_mille: int = 50) -> Column:
    """At least one word hit, and at least so many thousandths of the words."""
    return (n_hit() > 0) & (1000 * n_hit() >= per_mille * F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find(docs, benchmark)
    return found.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
), bw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (
    SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM bw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win), occ AS (
  SELECT doc_id, i, sizes.n, array_to_string(w[i:i + sizes.n - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM dw) p, sizes WHERE i + sizes.n - 1 <= len(w)
), hit AS (
  SELECT doc_id, i, n, item_id FROM occ JOIN win USING (n, s)
), pos AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)
"""
