"""The pipeline, stage by stage, on a few documents with known copies, passages and junk."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tests.llm.test_operators import brute_components, windows_of


def english(seed, n):
    rng = random.Random(seed)
    words = "the of and to in is that for it was on are with this from " + " ".join(f"{a}{b}" for a in ("ston", "mark", "fell", "grand", "wint") for b in ("er", "ing", "ed", "ly", "house"))
    pool = words.split()
    out = [rng.choice(pool) for _ in range(n)]
    return " ".join(w.capitalize() + "." if k % 12 == 11 else w for k, w in enumerate(out))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    exam = english(999, 40)
    rows = [(i, english(i, 120 + i % 7)) for i in range(24)]
    rows += [(30, rows[3][1]), (31, rows[3][1] + " more words at the end."), (32, english(40, 60) + " " + exam + " " + english(41, 60))]
    rows += [(33, " ".join(["junk"] * 200)), (34, "short"), (35, None), (36, "#$% " * 80), (50 + 1, english(50, 400))]
    rows += [(60 + i, f"{english(60 + i, 70)}\nall the sites carry this line\n{english(90 + i, 70)}") for i in range(9)]
    data = [(i, t, "en", f"s{i % 10}", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, exam)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_take_effect(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        if name != "harmonic_packing":
            assert docs.columns == columns
    kept = {k: {r.doc_id: r.text for r in rows} for k, rows in seen.items() if k != "harmonic_packing"}
    assert not {33, 34, 35, 36} & set(kept["quality_rules"]) and set(range(24)) <= set(kept["quality_rules"])
    assert set(kept["line_dedup"]) == set(kept["quality_rules"])
    assert sum("all the sites" in t for t in kept["line_dedup"].values()) == 1
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"])
    before = sorted(kept["line_dedup"].items())
    want = {before[root][0] for _, root in brute_components(before)}
    assert set(kept["ngram_jaccard"]) == want and not {30, 31} & want
    exam = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    for i, t in kept["ngram_jaccard"].items():
        w, _ = windows_of(t)
        hit = {k + d for win in windows_of(exam)[1] for k in range(len(w) - 12) if tuple(w[k : k + 13]) == win for d in range(13)}
        assert (i in kept["decontamination"]) == (not (hit and 20 * len(hit) >= len(w)))
    assert 32 not in kept["decontamination"] and len(kept["decontamination"]) == len(want) - 1
    pieces = defaultdict(int)
    for r in seen["harmonic_packing"]:
        pieces[r.doc_id, r.doc_tokens] += r.length
    assert {i for i, _ in pieces} == set(kept["decontamination"]) and all(n == total for (_, n), total in pieces.items())


def test_run_is_registered_and_gives_the_same(spark, sf_dir):
    got = __spark_entry__.queries()["pipeline"](spark, sf_dir)
    assert got.agg(F.count_distinct("doc_id")).first()[0] > 20


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_null_and_repeated_ids_and_clashing_columns(spark, tmp_path):
    """Rows that share an id are judged by their own texts, and a caller's columns come through with their values."""
    a, b, c = (english(k, 150) for k in (1, 2, 3))
    rows = [(6, c), (6, b + " end."), (2, b), (2, b), (None, a), (None, c + " More words."), (None, None), (8, "short"), (9, f"{a}\nkept")]
    names = "n_words n_removed kept quality row key text_key chosen gone_ boxed found_id component_id".split()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", len(t or ""), *[f"{n}{k}" for n in names]) for k, (i, t) in enumerate(rows)], schema)
    spark.createDataFrame([(0, english(77, 40))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, left, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        left = spark.read.parquet(f"{tmp_path}/{name}")
        assert left.columns == docs.columns
    got = sorted(left.collect(), key=lambda r: r.source)
    # of b two equal rows and a near copy, of c two, of a two; the smallest id stays, and null is the largest
    assert [(r.doc_id, r.text) for r in got if r.text != rows[2][1]] == [rows[0], rows[8]]
    assert sum(r.text == b for r in got) == 1 and {r.doc_id for r in got} == {2, 6, 9}
    assert all(r[n] == f"{n}{r.source[1:]}" for r in got for n in names)
    assert corpus_pipeline.harmonic_packing(spark, left, str(tmp_path)).count() >= 3
