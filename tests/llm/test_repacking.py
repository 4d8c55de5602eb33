"""Best-fit packing, its bounds against the true least number of bins, and whole results against the tokenizer."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vellum.llm import repacking

PLACE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length long, moves string, piece string, sequence_id long"


def least(lengths, capacity):
    """The true least number of bins, by trying all ways."""
    lengths = sorted(lengths, reverse=True)

    def fits(bins, i):
        if i == len(lengths):
            return True
        for k in sorted(range(len(bins)), key=lambda k: bins[k]):
            if bins[k] >= lengths[i] and bins[k] not in bins[:k]:
                if fits([*bins[:k], bins[k] - lengths[i], *bins[k + 1 :]], i + 1):
                    return True
        return False

    n = -(-sum(lengths) // capacity)
    while not fits([capacity] * n, 0):
        n += 1
    return n


@pytest.mark.parametrize("seed", range(40))
def test_bounds_and_bins(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 12, 30, 64])
    lengths = np.array([rng.randint(1, capacity) if seed % 2 else rng.randint(capacity // 4, capacity * 3 // 5) or 1 for _ in range(rng.randrange(1, 12))])
    bins, places = repacking.best_fit(lengths, capacity)
    by = defaultdict(list)
    for b, p, n in zip(bins, places, lengths, strict=True):
        by[b].append((p, n))
    for own in by.values():
        end = 0
        for p, n in sorted(own):
            assert p == end
            end += n
        assert end <= capacity
    counts = np.bincount(lengths, minlength=capacity + 1)
    assert repacking.least_bins(counts, capacity) <= least(lengths.tolist(), capacity) <= len(by)


def test_bounds_beat_the_sum():
    """Lengths over half, and over a third, are bounded by their number."""
    counts = np.zeros(101, np.int64)
    counts[51] = 10
    assert repacking.least_bins(counts, 100) == 10
    counts[51], counts[34] = 0, 9
    assert repacking.least_bins(counts, 100) == 5
    assert repacking.least_bins(np.zeros(101, np.int64), 100) == 0


def check(rows, found, capacity, end_id):
    coder = Tokenizer.from_file(PLACE)
    left = defaultdict(list)
    for i, text, *_ in rows:
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, end_id]
        crc = lambda part: zlib.crc32(np.array(part, "<u4").tobytes())
        left[i].append(sorted((k, s, len(ids[s : s + capacity]), crc(ids[s : s + capacity])) for k, s in enumerate(range(0, len(ids), capacity))))
    got = defaultdict(list)
    sequences = defaultdict(list)
    for r in found:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {i: sorted(p for own in x for p in own) for i, x in left.items()} == {i: sorted(x) for i, x in got.items()}
    for own in sequences.values():
        end = 0
        for at, n in sorted(own):
            assert at == end
            end += n
        assert end <= capacity
    lengths = np.array([r.length for r in found], np.int64)
    return len(sequences), repacking.least_bins(np.bincount(lengths, minlength=capacity + 1), capacity)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randrange(1, 8))) for _ in range(n))


@pytest.mark.parametrize("capacity, unit, parts", [(64, 100_000, 1), (64, 10, 5), (256, 40, 7)])
def test_whole_results(spark, capacity, unit, parts):
    rng = random.Random(capacity)
    rows = [(i, rng.choice([prose(rng, rng.randrange(60)), None, "", prose(rng, 5)]), 1, "m", "p", 2) for i in range(120)]
    rows += [(200, prose(rng, 3000), 1, "m", "p", 2), *rows[:4], (None, "a b c", 1, "m", "p", 2), (None, None, 1, "m", "p", 2)]
    found = repacking.repack(spark.createDataFrame(rows, SCHEMA).repartition(parts), PLACE, capacity, 1, unit).collect()
    n, bound = check(rows, found, capacity, 1)
    assert n <= bound + (0 if unit > 1000 else 3)


def test_partitions_give_up_what_is_not_full(spark):
    """Each of 20 tasks alone would need a sequence that is hardly filled."""
    rows = [(i, "a b c d", 1, "m", "p", 2) for i in range(20)]
    found = repacking.repack(spark.createDataFrame(rows, SCHEMA).repartition(20), PLACE, 100).collect()
    assert check(rows, found, 100, 1) == (1, 1) and all(r.certified for r in found)


def test_empty(spark):
    assert repacking.repack(spark.createDataFrame([], SCHEMA), PLACE).collect() == []
