"""Language identification as multilingual mixture inference.

Each language has a distribution over hashed byte trigrams of letters, learned from labelled documents. A document's
trigrams are taken for draws from a mixture of these, whose proportions expectation-maximisation estimates. The set
of languages is chosen by penalised likelihood: beginning with the likeliest one, a language is added while the
gain in log-likelihood outweighs the penalty for one more proportion. The prediction is the largest proportion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import pieces, plain_texts

BUCKETS = 1 << 16


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a document is kept from training: by the CRC of its id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts, lower-cased and with one space for each run of other characters than letters;
    and where each text's begin. A text without letters has none."""
    texts = pc.utf8_lower(plain_texts(texts))
    texts = pc.if_else(pc.match_substring_regex(texts, r"\pL"), texts, pa.scalar("", pa.large_string()))
    texts = pc.utf8_trim_whitespace(pc.replace_substring_regex(texts, r"[^\pL\pM]+", " "))
    space, none = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
    joined = pc.binary_join_element_wise(space, texts, space, none)
    size = np.where(pc.equal(texts, "").to_numpy(zero_copy_only=False), 0, pc.binary_length(texts).to_numpy().astype(np.int64))
    ends = np.cumsum(pc.binary_length(joined).to_numpy().astype(np.int64))
    data = np.frombuffer(b"".join(joined.cast(pa.large_binary()).to_pylist()), np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    gram = (data[:-2] | data[1:-1] << 8 | data[2:] << 16) * np.uint32(2654435761) >> np.uint32(16)
    # " ab..yz " has as many trigrams as its text has bytes; the two spaces around are their edges
    first = ends - size - 2
    at = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return gram[np.maximum(at, 0)].astype(np.int64), np.concatenate([[0], np.cumsum(size)])


def learned(docs: DataFrame, per_language: int, seed: int = 11) -> tuple[list[str], np.ndarray]:
    """Languages, and a row of smoothed trigram probabilities for each.

    The training documents of a language are all of them, or a sample of about ``per_language`` if it has more.
    """
    rows = docs.select("doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(found)
    if not languages:
        return [], np.zeros((0, BUCKETS))
    chance = F.coalesce(*[F.when(F.col("lang") == k, F.lit(per_language / n)) for k, n in found.items()])
    rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < chance * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for some in pieces(batches, 0):
            grams, first = trigrams(some.column(0))
            for lang, a, b in zip(some.column(1).to_pylist(), first[:-1], first[1:], strict=True):
                own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                own += np.bincount(grams[a:b], minlength=BUCKETS) if b - a > 5000 else 0
                if b - a <= 5000:
                    np.add.at(own, grams[a:b], 1)
        for lang, own in counts.items():
            there = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(there), pa.string()), pa.array(there), pa.array(own[there])], ["lang", "gram", "n"])

    # at most as many rows as there are languages times BUCKETS
    seen = rows.select("text", "lang").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((len(languages), BUCKETS), 0.05)
    row = {k: i for i, k in enumerate(languages)}
    np.add.at(counts, ([row[x] for x in seen["lang"].to_pylist()], seen["gram"].to_numpy()), seen["n"].to_numpy())
    return languages, counts / counts.sum(1, keepdims=True)


def mixture(likely: np.ndarray, weight: np.ndarray, start: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Proportions of the rows of likely (languages x trigrams), and the log-likelihood."""
    share, n = start, weight.sum()
    for _ in range(rounds):
        new = share * (likely @ (weight / (share @ likely))) / n
        moved = np.abs(new - share).max()
        share = new
        if moved < 1e-3:
            break
    return share, float(weight @ np.log(share @ likely))


def inferred(model: np.ndarray, grams: np.ndarray, penalty: float, rounds: int, least: float) -> np.ndarray:
    """The proportions of all languages; zero for those that are not in the chosen set, and for those, but the likeliest
    alone, whose proportion of the mixture of all languages is below ``least``."""
    if len(grams) > BUCKETS:
        counts = np.bincount(grams, minlength=BUCKETS)
        grams = np.flatnonzero(counts)
        weight = counts[grams].astype(float)
    else:
        weight = np.ones(len(grams))
    likely = model[:, grams]
    alone = np.log(likely) @ weight
    share = np.zeros(len(model))
    chosen = [int(alone.argmax())]
    best, own = alone[chosen[0]], np.ones(1)
    if len(model) > 1:
        whole, _ = mixture(likely, weight, np.full(len(model), 1 / len(model)), rounds)
        for k in np.argsort(-whole):
            if whole[k] < least:
                break
            if k in chosen:
                continue
            more = [*chosen, int(k)]
            start = np.append(own * 0.8, 0.2)
            found, value = mixture(likely[more], weight, start / start.sum(), rounds)
            if value - best > penalty * np.log(weight.sum() + 1):
                chosen, own, best = more, found, value
    share[chosen] = own
    return share


def identify(docs: DataFrame, per_language: int = 5000, penalty: float = 3.0, rounds: int = 30, least: float = 0.02) -> DataFrame:
    """doc_id, held_out, lang_pred, score and mixture (the proportions of the chosen languages).

    docs: doc_id, text, and lang to learn from; other columns are ignored. A null text, or one without letters, is
    ``und`` with score 0 and an empty mixture, and so is everything if nothing can be learned. A null doc_id is never
    learned from, and not held out. Of languages that are equally likely the first by name is predicted. Repeated rows
    are judged alike; empty tables give no rows. A language is tried for a document's set if the mixture of all
    languages gives it ``least`` or more.
    """
    languages, model = learned(docs, per_language)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for some in pieces(batches, 1):
            grams, first = trigrams(some.column(1))
            names, scores, mixed = [], [], []
            for a, b in zip(first[:-1], first[1:], strict=True):
                if a == b or not languages:
                    names.append("und")
                    scores.append(0.0)
                    mixed.append([])
                    continue
                share = inferred(table, grams[a:b], penalty, rounds, least)
                k = int(share.argmax())
                names.append(languages[k])
                scores.append(min(1.0, float(share[k])))
                mixed.append([{"lang": languages[j], "share": float(share[j])} for j in np.flatnonzero(share)])
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(mixed, kind)], ["doc_id", "lang_pred", "score", "mixture"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, mixture array<struct<lang:string,share:double>>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "mixture")


def report(docs: DataFrame) -> DataFrame:
    return identify(docs).select("doc_id", "held_out", "lang_pred", F.round("score", 6).alias("score"))
