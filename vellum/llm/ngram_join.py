"""N-gram Jaccard join: documents link when their sets of word shingles reach a Jaccard similarity.

1. Documents with the same set are one node, so exact copies are one from here on.
2. Shingles are ordered by hash. Two linked nodes share at least k of their first n - ceil(0.75 n) + k shingles, so
   these prefixes are cut into postings, packed by ranges of the hash, and nodes go on only if enough of their prefix
   stands in other nodes too. A chunk of documents sends each shingle once, however many of its documents have it, so
   a shingle that a third of all documents share is one posting a chunk.
3. The sets of nodes that go on are written once. Among them shingles are counted exactly; a node needs 75 % of its
   shingles in other nodes, and those of the rarest-first prefix make the inverted lists. Lists that share nodes make
   groups, which hold all links.
4. Each group is searched by T-occurrence. A query's shingles select inverted lists over the group; DivideSkip sets
   the L longest lists aside, merges the short ones with a heap, keeps nodes that reach T - L there, and probes the
   long lists for these alone by binary search. A node links if it reaches its own T, the least overlap that the two
   set sizes allow. Linked nodes leave the index at once, and only links that join two components leave the task.
5. Groups of more nodes than a cell holds are dealt at random to cells, twice, which joins nearly all of a large group
   of near copies. Lists that still hold several components are searched cell by cell: their largest component is
   sent once, and only the rest meets every cell.

Shingles are known by 64-bit hashes, and nodes by 64-bit hashes of their sets. Between the chunks of step 2 shingles
meet by fewer bits, which can only send a node too many to step 3.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import forget, pieces, plain_texts, staged, text_key
from vellum.llm.components import components

#: Shared shingles asked for in a prefix, in percent of the set.
ASKED = 20
#: Nodes, and shingles in all, that a cell holds; a single larger set has a cell with its partners.
CELL, CELL_SHINGLES = 256, 500_000
#: Keys of documents that may be broadcast: 16 bytes each.
SENT = 1_000_000
#: Cost of a probe against that of a merge step, in DivideSkip's choice of L.
MU = 0.001
#: Documents of a chunk at most.
ROWS = 2000
#: Marks a posting of several nodes of a chunk.
SEVERAL = 0xFFFF
MULTIPLY = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Per text the sorted hashes of its distinct shingles: of all words if they are fewer than size, else of each size words."""
    texts = pc.ascii_lower(plain_texts(texts))
    split = pc.ascii_split_whitespace(texts)
    flat, bounds = split.flatten(), split.offsets.to_numpy()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(full)])[bounds - bounds[0]]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    names = [xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()]
    words = np.array(names, np.uint64)[coded.indices.to_numpy()]
    multiply = np.resize(MULTIPLY, size) * np.arange(1, 2 * size, 2, dtype=np.uint64)
    if len(words) >= size:
        last = len(words) - size + 1
        rolled = mixed(sum(words[k : k + last] * multiply[k] for k in range(size)))
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            salt = np.array([b - a], np.uint64) * np.uint64(0xE7037ED1A0B428DB)
            out.append(mixed(salt + (words[a:b] * multiply[: b - a]).sum(dtype=np.uint64, keepdims=True)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def node_of(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).astype(np.int64))



def table_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def least_own(n: int, percent: int) -> int:
    """The least overlap of a set of n shingles with any set that it links with."""
    return -(-percent * n // 100)


def asked(n: int) -> int:
    return max(1, -(-ASKED * n // 100))


def prefix_length(n: int, percent: int) -> int:
    return min(n, n - least_own(n, percent) + asked(n))


def needed(n: int, percent: int) -> int:
    """How many of a node's prefix stand in the prefix of any partner: what the smallest possible partner asks for."""
    return min(asked(n), asked(least_own(n, percent)))


def nodes_and_postings(docs: DataFrame, size: int, percent: int, parts: int) -> DataFrame:
    """kind 0: a document's doc_id, text key, node and set size, and for the first of a node in a chunk its slot, the
    shared shingles that are found within the chunk, and how many it needs; kind 1: a part's postings of a chunk, as 4
    bytes of the hash and 2 of the slot each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in pieces(batches, 2, ROWS):
            sets = shingle_sets(some.column(2), size)
            nodes = np.array([node_of(x) for x in sets], np.int64)
            n = np.array([len(x) for x in sets], np.int64)
            chunk = xxhash.xxh3_64_intdigest(nodes.tobytes() + str(some.column(0)[0]).encode()) >> 17 << 16
            first = np.zeros(len(n), bool)
            first[np.unique(nodes, return_index=True)[1]] = True
            first &= n > 0
            at = np.flatnonzero(first)
            cut = [prefix_length(k, percent) for k in n[at].tolist()]
            token = np.concatenate([np.empty(0, np.uint64), *(sets[i][:k] for i, k in zip(at.tolist(), cut, strict=True))])
            index = np.repeat(at, cut)
            token, where, count = np.unique(token, return_inverse=True, return_counts=True)
            local = np.bincount(index[count[where] > 1], minlength=len(n))
            slot = np.empty(len(token), np.uint16)
            slot[where] = index
            slot[count > 1] = SEVERAL
            need = [needed(k, percent) for k in n.tolist()]
            yield table_of(
                kind=pa.array(np.zeros(len(n), np.int32)), doc_id=some.column(0), key=some.column(1), node=pa.array(nodes), n=pa.array(n),
                slot=pa.array(chunk + np.arange(len(n)), pa.int64(), mask=~first), local=pa.array(local, pa.int64()), need=pa.array(need, pa.int64()),
                packed=pa.nulls(len(n), pa.binary()),
            )
            if not len(token):
                continue
            part = ((token >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            low, slot, part = token[by].astype(np.uint32), slot[by], part[by]
            there, begin = np.unique(part, return_index=True)
            ends = [*begin[1:].tolist(), len(part)]
            packed = [low[a:b].tobytes() + slot[a:b].tobytes() for a, b in zip(begin.tolist(), ends, strict=True)]
            none = pa.nulls(len(there), pa.int64())
            yield table_of(
                kind=pa.array(np.ones(len(there), np.int32)), doc_id=none, key=none, node=pa.array(there), n=none,
                slot=pa.array(np.full(len(there), chunk)), local=none, need=none, packed=pa.array(packed, pa.binary()),
            )

    kinds = "kind int, doc_id long, key long, node long, n long, slot long, local long, need long, packed binary"
    return docs.select("doc_id", "key", "text").mapInArrow(run, kinds)


def shared_counts(postings: DataFrame) -> DataFrame:
    """slot and found: how many of its prefix's shingles other chunks have too. postings: part, chunk, packed."""

    def replies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: list[np.ndarray] = []
        slots: list[np.ndarray] = []
        now = None

        def done() -> pa.RecordBatch:
            _, where, count = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
            slot = np.concatenate(slots)
            slot = np.sort(slot[(count[where] > 1) & ((slot & SEVERAL) != SEVERAL)])
            chunk, begin = np.unique(slot >> 16, return_index=True)
            ends = [*begin[1:].tolist(), len(slot)][: len(begin)]
            return table_of(chunk=pa.array(chunk), packed=pa.array([slot[a:b].astype(np.uint16).tobytes() for a, b in zip(begin.tolist(), ends, strict=True)], pa.binary()))

        for batch in batches:
            for part, chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if part != now and tokens:
                    yield done()
                    tokens, slots = [], []
                now, data = part, data.as_buffer()
                m = len(data) // 6
                tokens.append(np.frombuffer(data, np.uint32, m).copy())
                slots.append(np.frombuffer(data, np.uint16, m, 4 * m).astype(np.int64) + chunk)
        if tokens:
            yield done()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, now = np.zeros(ROWS, np.int64), None

        def done() -> pa.RecordBatch:
            slot = np.flatnonzero(total)
            return table_of(slot=pa.array(slot + (now << 16), pa.int64()), found=pa.array(total[slot]))

        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if chunk != now:
                    if now is not None:
                        yield done()
                    total[:], now = 0, chunk
                total += np.bincount(np.frombuffer(data.as_buffer(), np.uint16), minlength=ROWS)
        if now is not None:
            yield done()

    found = postings.repartition("part").sortWithinPartitions("part").mapInArrow(replies, "chunk long, packed binary")
    return found.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(summed, "slot long, found long")


def sets_of(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """node and own, its sorted shingles, for each of nodes (key, doc_id: of one document that has it)."""
    keys = nodes.select(F.col("key").alias("key_"), F.col("doc_id").alias("doc_id_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for some in pieces(batches, 0):
            sets = {node_of(x): x for x in shingle_sets(some.column(0), size)}
            new = [k for k in sets if k not in seen]
            seen.update(new)
            ends = np.cumsum([0, *(len(sets[k]) for k in new)])
            flat = np.concatenate([np.empty(0, np.uint64), *(sets[k] for k in new)]).view(np.int64)
            yield table_of(node=pa.array(new, pa.int64()), own=pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)))

    if keys.count() <= SENT:
        keys = F.broadcast(keys)
    met = (docs["key"] == keys["key_"]) & docs["doc_id"].eqNullSafe(keys["doc_id_"])
    return docs.join(keys, met, "left_semi").select("text").mapInArrow(run, "node long, own array<long>").dropDuplicates(["node"])


def inverted_lists(sets: DataFrame, percent: int) -> DataFrame:
    """token and node: the rarest-first prefixes of nodes that have enough shingles in other nodes."""
    tokens = sets.select("node", F.size("own").alias("n"), F.explode("own").alias("token"))
    count = tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    shared = tokens.join(count, "token").groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("c", "token"))).alias("own"))
    least = F.ceil(F.col("n") * percent / 100)
    prefix = F.slice("own", F.lit(1), (F.size("own") - least + 1).cast("int"))
    return shared.where(F.size("own") >= least).select("node", F.explode(prefix).alias("x")).select("x.token", "node")


def least_overlap(n: int, m: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of sets of n and m shingles at which 100 * intersection >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


class Index:
    """Inverted lists over sets: the places of the sets that have a shingle, by shingle."""

    def __init__(self, sets: list[np.ndarray], places: np.ndarray):
        flat = np.concatenate([sets[i] for i in places.tolist()])
        owner = np.repeat(places, [len(sets[i]) for i in places.tolist()])
        by = np.argsort(flat, kind="stable")
        self.owner = owner[by]
        self.token, self.first = np.unique(flat[by], return_index=True)
        self.after = np.append(self.first[1:], len(flat))

    def lists(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the lists of the query's shingles begin and end, of those that there are."""
        at = np.minimum(np.searchsorted(self.token, query), len(self.token) - 1)
        at = at[self.token[at] == query]
        return self.first[at], self.after[at]


def divide_skip(query: np.ndarray, index: Index, sizes: np.ndarray, open_: np.ndarray, percent: int) -> list[int]:
    """Places of the open sets that reach the similarity with the query."""
    need = least_overlap(len(query), sizes, percent)
    able = open_ & (need <= sizes) & (need <= len(query))
    first, after = index.lists(query)
    if not able.any() or len(first) < (t := int(need[able].min())):
        return []
    length = after - first
    order = np.argsort(length, kind="stable")
    aside = max(0, min(t - 1, int(t / (MU * np.log2(length.max() + 1) + 1))))
    short, long_ = order[: len(order) - aside], order[len(order) - aside :]
    merged = heapq.merge(*(index.owner[first[k] : after[k]].tolist() for k in short.tolist()))
    counts = {k: sum(1 for _ in same) for k, same in groupby(merged)}
    at = np.array([k for k, c in counts.items() if able[k] and c >= need[k] - aside], np.int64)
    if not len(at):
        return []
    total = np.array([counts[k] for k in at.tolist()], np.int64)
    for k in long_.tolist():
        own = index.owner[first[k] : after[k]]
        total += own[np.minimum(np.searchsorted(own, at), len(own) - 1)] == at
    return at[total >= need[at]].tolist()


def joining_links(sets: list[np.ndarray], labels: list[int], percent: int) -> list[tuple[int, int]]:
    """Links between sets of different labels, as pairs of places; those that join no two components more are left out."""
    sizes = np.array([len(x) for x in sets], np.int64)
    label = np.unique(np.array(labels, np.int64), return_inverse=True)[1]
    members = np.split(np.argsort(label, kind="stable"), np.cumsum(np.bincount(label))[:-1])
    # the largest components ask last: by then little is left that could answer
    turn = sorted(range(len(members)), key=lambda k: len(members[k]))
    open_ = np.ones(len(sets), bool)
    links: list[tuple[int, int]] = []
    index, left = None, 0
    for start in turn:
        if not open_[members[start][0]]:
            continue
        asking = members[start].tolist()
        open_[asking] = False
        while asking:
            rest = int(open_.sum())
            if not rest:
                return links
            if index is None or 2 * rest <= left:
                index, left = Index(sets, np.flatnonzero(open_)), rest
            query = asking.pop()
            for k in divide_skip(sets[query], index, sizes, open_, percent):
                if open_[k]:
                    links.append((query, k))
                    asking.extend(members[label[k]].tolist())
                    open_[members[label[k]]] = False
    return links


def searched(rows: DataFrame, by: list[str], percent: int) -> DataFrame:
    """u and v: links between labels within each cell. rows: the columns ``by``, label, node and own."""
    cell = F.xxhash64(*by).alias("cell")
    rows = rows.select(cell, "label", "node", "own").repartition("cell").sortWithinPartitions("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        nodes: list[int] = []
        labels: list[int] = []
        sets: list[np.ndarray] = []

        def done() -> pa.RecordBatch:
            found = joining_links(sets, labels, percent)
            return table_of(u=pa.array([nodes[a] for a, _ in found], pa.int64()), v=pa.array([nodes[b] for _, b in found], pa.int64()))

        for batch in batches:
            own = batch.column(3)
            flat, ends = own.flatten().to_numpy().view(np.uint64), own.offsets.to_numpy() - own.offsets[0].as_py()
            for k, (cell, label, node) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)):
                if cell != now and nodes:
                    yield done()
                    nodes, labels, sets = [], [], []
                now = cell
                nodes.append(node)
                labels.append(label)
                sets.append(flat[ends[k] : ends[k + 1]].copy())
        if nodes:
            yield done()

    return rows.mapInArrow(run, "u long, v long")


def spans_of(members: DataFrame) -> DataFrame:
    """Of each list (list, root) whose nodes (n, label) are of several components: the largest as top, in how many parts
    the rest and the top are dealt, and how many rows that makes."""
    largest = members.groupBy("list", "root", "label").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    parts = lambda m, s: F.greatest(F.ceil(m / F.lit(CELL / 2)), F.ceil(s / F.lit(CELL_SHINGLES / 2)))
    lists = largest.groupBy("list", "root").agg(F.max(F.struct("m", "s", "label")).alias("top"), F.sum("m").alias("m"), F.sum("s").alias("s"))
    lists = lists.where("m > top.m").withColumn("others", F.col("m") - F.col("top.m"))
    lists = lists.withColumn("rest", parts(F.col("others"), F.col("s") - F.col("top.s"))).withColumn("tops", parts(F.col("top.m"), F.col("top.s")))
    rows = F.col("others") * (F.col("rest") + F.col("tops")) + F.col("top.m") * F.col("rest")
    return lists.select("list", "root", F.col("top.label").alias("top"), "rest", "tops", rows.alias("rows"))


def cells_of(members: DataFrame, spans: DataFrame) -> DataFrame:
    """list, i, j, node and label: each two nodes of a list meet in a cell, but for two of the list's largest component."""
    both = members.join(spans.drop("root"), "list")
    of_top = F.col("label") == F.col("top")
    own = F.when(of_top, F.col("rest") + F.pmod(F.xxhash64("node"), F.col("tops"))).otherwise(F.pmod(F.xxhash64("node"), F.col("rest")))
    met = F.sequence(F.lit(0).cast("long"), F.col("rest") - 1 + F.when(of_top, F.lit(0)).otherwise(F.col("tops")))
    both = both.withColumn("own_", own).withColumn("met_", F.explode(met))
    return both.select("list", F.least("own_", "met_").alias("i"), F.greatest("own_", "met_").alias("j"), "node", "label")


def still_open(lists: DataFrame, found: DataFrame) -> DataFrame:
    """Cells in which all nodes meet that share a list and no component yet. found: node, root, n and label. A group
    whose lists make more rows than the group itself is one list."""
    by_token = lists.join(found, "node").select(F.xxhash64(F.lit(0), "token").alias("list"), "root", "node", "n", "label")
    by_group = found.select(F.xxhash64(F.lit(1), "root").alias("list"), "root", "node", "n", "label")
    narrow, wide = staged(spans_of(by_token), "spans"), staged(spans_of(by_group), "spans")
    cost = narrow.groupBy("root").agg(F.sum("rows").alias("cost"))
    whole = wide.join(cost, "root").where("rows <= cost").drop("cost")
    narrow = narrow.join(whole.select("root"), "root", "left_anti")
    return cells_of(by_token, narrow.select(*wide.columns)).unionByName(cells_of(by_group, whole.select(*wide.columns)))


def groups_of(sets: DataFrame, percent: int) -> DataFrame:
    """node and root for nodes of components of two nodes or more, the roots themselves left out."""
    lists = staged(inverted_lists(sets, percent), "lists")
    centre = lists.groupBy("token").agg(F.min("node").alias("v"), F.count("*").alias("c")).where("c > 1").select("token", "v")
    edges = lists.join(centre, "token").select(F.col("node").alias("u"), "v").distinct()
    near = components(edges)
    nodes = near.select("node", "root").unionByName(near.select(F.col("root").alias("node"), "root").distinct())
    sized = sets.join(nodes, "node").select("node", "root", "own", F.size("own").alias("n"))
    large = sized.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    cells = F.greatest(F.ceil(F.col("m") / CELL), F.ceil(F.col("s") / CELL_SHINGLES))
    sized = staged(sized.join(large.select("root", cells.alias("cells")), "root"), "groups")
    one = sized.withColumn("label", F.col("node"))
    deal = F.when(F.col("cells") > 1, F.pmod(F.xxhash64("node"), F.col("cells"))).otherwise(0)
    links = staged(searched(one.withColumn("cell_", deal), ["root", "cell_"], percent), "links")
    roots = components(links)
    wide = sized.where("cells > 1")
    if wide.isEmpty():
        return roots
    for last in (False, True):
        found = wide.join(roots.select("node", F.col("root").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node"))
        if last:
            cells = still_open(lists, found.select("node", "root", "n", "label")).join(wide.select("node", "own"), "node")
            more = searched(cells, ["list", "i", "j"], percent)
        else:
            dealt = F.pmod(F.xxhash64(F.lit(1), "node"), F.col("cells"))
            more = searched(found.withColumn("cell_", dealt), ["root", "cell_"], percent)
        more = staged(more, "links")
        if not more.isEmpty():
            roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
    forget(sized, lists)
    return roots


def cluster(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, the smallest doc_id that is reachable by links; text_key, the
    hash of its text; and chosen, true for one (doc_id, text) of each component, that with the smallest doc_id.

    docs: doc_id and text; other columns are ignored. A null text, or one without words, has an empty set, links
    with nothing and is chosen; fewer words than ``size`` are one shingle. Rows that share a doc_id are documents of
    their own, told apart by their texts; repeated rows link with each other and are chosen together. A null doc_id
    keeps its row, and is no candidate for component_id while the component has another. Of rows with one doc_id in
    one component the least text_key is chosen. Empty tables give no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", text_key(F.col("text")).alias("key"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = staged(nodes_and_postings(docs, size, percent, parts), "nodes")
    counts = shared_counts(first.where("kind = 1").select(F.col("node").alias("part"), F.col("slot").alias("chunk"), "packed"))
    rows = first.where("kind = 0")
    able = rows.where("slot IS NOT NULL").join(counts, "slot", "left").where(F.coalesce("found", F.lit(0)) + F.col("local") >= F.col("need"))
    able = staged(able.groupBy("node").agg(F.min(F.struct("key", "doc_id")).alias("x")).select("node", "x.*"), "able")
    sets = staged(sets_of(docs, able, size), "sets")
    roots = groups_of(sets, percent)
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    named = rows.where("n > 0").groupBy("node").agg(F.min(rank).alias("least")).join(roots, "node", "left")
    named = staged(named.select("node", "least", F.coalesce("root", "node").alias("root")), "named")
    moved = named.groupBy("root").agg(F.min("least").alias("top"), F.count("*").alias("m")).where("m > 1").select("root", "top")
    named = named.join(moved, "root", "left").select("node", F.coalesce("top", "least").alias("top"))
    out = rows.select("doc_id", "key", "node", "n").join(named, "node", "left")
    whole = F.col("n") > 0
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(whole, F.col("top.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.col("key").alias("text_key"), F.when(whole, rank == F.col("top")).otherwise(True).alias("chosen"),
    )


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS g FROM (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), links AS MATERIALIZED (
  SELECT a AS u, b AS v FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n AS p ON p.doc_id = a JOIN n AS q ON q.doc_id = b WHERE 100 * o >= 75 * (p.n + q.n - o)
), reach AS (
  SELECT doc_id, doc_id AS r FROM w UNION SELECT reach.doc_id, links.v FROM reach JOIN links ON links.u = reach.r
)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN reach ON reach.doc_id = w.doc_id GROUP BY w.doc_id
"""
