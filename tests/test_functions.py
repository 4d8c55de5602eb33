"""Golden vectors and independent models of the builders and graders."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vellum.functions import citations, geometry, grading, messages, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "given,want",
    [("The  Cat, an owl!", "cat owl"), ("A\u00a0\u3000b", "b"), ("", ""), ("theory a-b", "theory ab"), ("été a", "été")],
)
def test_normalize_answer(spark, given, want):
    assert one(spark, text.normalize_answer(F.lit(given))) == want


def test_other_normalisers(spark):
    assert one(spark, text.normalize_agent_answer(F.lit("The_cat’s x"))) == "cat s x"
    assert one(spark, text.normalize_zh_answer(F.lit("你 好，A。b!"))) == "你好ab"
    assert one(spark, text.alnum(F.lit("2,521 Yes!"))) == "2521yes"
    assert one(spark, text.scrubbed(F.lit("\x00 a\x01b \x02"))) == "a\nb"


def model_f1(p, g):
    same = sum((Counter(p) & Counter(g)).values())
    return 0.0 if not same else 2 * same / (len(p) + len(g))


def model_edit(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def model_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_token_metrics_against_models(spark):
    rng = random.Random(4)
    rows = [([rng.choice("abcd") for _ in range(rng.randrange(7))], [rng.choice("abcd") for _ in range(rng.randrange(7))]) for _ in range(120)]
    p, g = F.col("p"), F.col("g")
    got = spark.createDataFrame(rows, "p array<string>, g array<string>").select("p", "g", text.token_f1(p, g).alias("f"), text.edit_distance(p, g).alias("e"), text.longest_common(p, g).alias("l"), text.word_error_rate(p, g).alias("w")).collect()
    for r in got:
        assert r.f == pytest.approx(model_f1(r.p, r.g)) and r.e == model_edit(r.p, r.g) and r.l == model_lcs(r.p, r.g)
        assert r.w == (float("inf") if not r.g else pytest.approx(model_edit(r.p, r.g) / len(r.g)))


@pytest.mark.parametrize(
    "said,want",
    [("\\boxed{B}", "B"), ("\\boxed{the answer is C}", "C"), ("**Answer**: D", "D"), ("answer: b", "B"), ("I think E", "E"), ("none here", None), ("A or B", "B")],
)
def test_choice_letter(spark, said, want):
    assert one(spark, text.choice_letter(F.lit(said))) == want


def test_recall_and_rates(spark):
    golds = F.array(F.lit("Paris"), F.lit("rome"))
    assert one(spark, text.substring_recall(F.lit("in PARIS"), golds)) == 0.5
    assert one(spark, text.substring_any(F.lit("in PARIS"), golds)) == 1.0
    assert one(spark, text.substring_recall(F.lit("x"), F.array().cast("array<string>"))) is None
    assert one(spark, text.number_hit_rate(F.lit("3, 4 and ٣"), F.lit("3"))) == pytest.approx(1 / 3)
    assert one(spark, text.retrieval_hit_rate(F.lit("5"), F.lit("Paragraph 5 x"))) == 1.0
    classes = F.array(F.lit("cat"), F.lit("catalog"), F.lit("dog"))
    assert one(spark, text.classification_credit(F.lit("a catalog of dog"), F.lit("catalog"), classes)) == 0.5
    assert one(spark, text.wer_hit(F.lit("the big Cat"), F.lit("big cat"))) == 1.0
    assert one(spark, text.first_line(F.lit("\n\na\nb"))) == "a"
    assert one(spark, text.line_blocks(F.lit("a\nb\nc"), 2)) == ["a\nb", "c"]
    assert one(spark, text.char_error_rate(F.lit("ete"), F.lit("été"))) == pytest.approx(2 / 3)
    assert one(spark, text.reasoning_and_answer(F.lit("r</think>a</think>"))).answer == "a</think>"


def test_human_count(spark):
    rows = spark.createDataFrame([(999,), (1000,), (1_500_000,), (2_000_000_000,), (3_250_000_000_000,)], "n long")
    assert [r.x for r in rows.select(text.human_count(F.col("n")).alias("x")).collect()] == ["999", "1.00K", "1.50M", "2.00B", "3.25T"]


def test_boxes(spark):
    box = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, geometry.iou(box(0, 0, 10, 10), box(5, 5, 15, 15))) == pytest.approx(25 / 175)
    assert one(spark, geometry.iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0.0
    for bad in ((0, 0, 1), (0, 0, 0, 1), (0, 0, float("nan"), 1), (-1, 0, 1, 1), (0, 0, 1001, 1)):
        assert not one(spark, geometry.valid_box(box(*bad)))
    assert one(spark, geometry.expanded_box(box(0, 0, 10, 10))) == [0, 0, 80, 80]
    assert one(spark, geometry.expanded_box(box(900, 400, 1000, 600))) == [880, 380, 1000, 620]
    assert one(spark, geometry.pixel_box(box(1, 1, 999, 1000), F.lit(100), F.lit(50))) == [0, 0, 100, 50]
    assert tuple(one(spark, geometry.smart_resize(F.lit(100.0), F.lit(30.0), 28, 784, 10**6))) == (112, 28)


def test_messages(spark):
    turns = F.from_json(F.lit('[{"role":"user","content":"a<image>b"},{"role":"assistant","content":"x"},{"from":"gpt","value":"y"}]'), "array<struct<from:string,value:string,role:string,content:string>>")
    unified = messages.unified_turns(turns)
    assert [tuple(m) for m in one(spark, unified)] == [("user", "a<image>b"), ("assistant", "x"), ("assistant", "y")]
    assert [m.content for m in one(spark, messages.without_last_assistant(unified))] == ["a<image>b", "x"]
    assert one(spark, messages.tags_match(unified, F.lit(1))) and not one(spark, messages.tags_match(unified, F.lit(2)))
    parts = one(spark, messages.interleaved(F.lit("<image>b<image>"), F.array(F.lit("1.png"), F.lit("2.png"))))
    assert [tuple(p) for p in parts] == [("image", "1.png"), ("text", "b"), ("image", "2.png")]
    found = one(spark, messages.evidence_boxes(F.lit("Page 3 <box>[1, 2.5, 30, 40]</box> and Page 12 <box>[0,0,1,1]")))
    assert [tuple(b) for b in found] == [(3, 1.0, 2.5, 30.0, 40.0), (12, 0.0, 0.0, 1.0, 1.0)]


def test_masks(spark):
    ids = F.array(*[F.lit(x) for x in (5, 9, 7, 9)])
    assert one(spark, messages.until_first(ids, 9)) == [1, 1, 0, 0] and one(spark, messages.until_first(ids, 1)) == [1, 1, 1, 1]
    mask = F.array(*[F.lit(x) for x in (0, 1, 1, 0)])
    assert one(spark, messages.positions_by_count(mask)) == [0, 0, 1, 1] and one(spark, messages.positions_by_index(mask)) == [0, 1, 2, 0]
    assert one(spark, messages.expanded_media(ids, 9, F.array(F.lit(2), F.lit(3)))) == [5, 9, 9, 7, 9, 9, 9]
    assert one(spark, messages.padded(ids, F.lit(6), 0, "left")) == [0, 0, 5, 9, 7, 9] and one(spark, messages.padded(ids, F.lit(2), 0, truncate="left")) == [7, 9]


def test_graders():
    assert grading.last_boxed("a \\boxed{1} b \\boxed{x^{2}}") == "x^{2}" and grading.last_boxed("none") is None and grading.last_boxed("\\boxed{open") is None
    assert grading.math_score("\\boxed{\\dfrac12}", "\\frac{1}{2}") == 1.0 and grading.math_score("\\boxed{3/4}", "\\frac{3}{4}") == 1.0 and grading.math_score("7", "7") == 0.0
    assert grading.math_signed_score("Answer: 5", "5") == 1.0 and grading.math_signed_score("x", "5") == -1.0
    assert grading.numbers_agree("50%", "0.5") and not grading.numbers_agree("1", "2") and not grading.numbers_agree("x", "1")
    assert grading.prefixed_ratio("k abc", "k abc", "k ") == 1.0 and grading.prefixed_ratio("abc", "k abc", "k ") == 0.0
    assert grading.code_similarity("# note\nx = 1\n", "x = 1") == 1.0
    assert grading.matched_golds("4 and 2,521", ["2521", "4"]) == 2 and grading.matched_golds("42", ["4"]) == 0
    assert grading.matched_golds("red", ["red", "red"]) == 1 and grading.matched_golds("new york city", ["york city", "new york", "city"]) == 2
    assert grading.final_answer("t</think><answer> b </answer><|im_end|>") == "b" and grading.final_answer("<answer>a</answer> more") == ""
    calls, broken = grading.tool_calls('<tool_call>{"name": "z"}</tool_call><tool_call><function=z><parameter=page>1</parameter></function></tool_call><tool_call>{')
    assert calls == [{"name": "z"}, {"name": "z", "arguments": {"page": 1}}] and broken == 1
    assert grading.assigned([[0.9, 0.8], [0.7, 0.0]]) == (pytest.approx(1.5), 2) and grading.assigned([]) == (0.0, 0)


def test_assignment_against_all_permutations():
    rng = random.Random(1)
    for _ in range(150):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        w = [[rng.choice([0.0, 0.0, round(rng.random(), 2)]) for _ in range(m)] for _ in range(n)]
        tall = w if n <= m else [list(c) for c in zip(*w, strict=True)]
        best = max(sum(tall[i][c] for i, c in enumerate(p)) for p in itertools.permutations(range(len(tall[0])), len(tall)))
        assert grading.assigned(w)[0] == pytest.approx(best)
    big = [[rng.random() for _ in range(60)] for _ in range(40)]
    assert grading.assigned(big)[1] == 40


def test_quantities():
    same = [("12 dollars", "12"), ("x = 1,234", "1234"), ("$\\frac12$ feet", "\\frac{1}{2}"), ("\\text{5 cm}", "5"), ("the sum is $7$ or so", "7"), ("\\sqrt3", "\\sqrt{3}"), ("\\boxed{4}", "4")]
    for said, gold in same:
        assert grading.math_signed_score(f"so\nAnswer: {said}", gold) == 1.0, said
    assert grading.math_signed_score("the box is \\boxed{5}", "5") == -1.0 and grading.math_signed_score("Answer: 5\nAnswer: 6", "5") == -1.0
    assert grading.last_boxed("\\boxed 5$ then \\boxed{7}") == "5" and grading.math_boxed_score("\\boxed{x+1}", "x+1") == 1.0 and grading.math_boxed_score("x" * 90 + "\\boxed{1}" + " " * 100, "1") == -1.0


def test_page_references():
    pages = {1: [3], 2: [3, 4], 3: [9], 4: [6], 5: [7]}
    for text, want in [
        ("Pages 1-2, 4 and 5", "Pages 3, 4, 6 and 7"), ("page 3rd", "page 3rd"), ("pages 3 or 4", "Pages 9 and 6"), ("PAGE 1 & 2.", "Pages 3 and 4."), ("pages 1, and 3", "Pages 3 and 9"),
        ("pages 1 to 3x", "Page 3 to 3x"), ("page 4\u20135!", "Pages 6 and 7!"), ("homepage 1, page2", "homepage 1, Pages 3 and 4"), ("pages 1, 4th", "Page 3, 4th"), ("page one", "page one"), ("page 1\nand 2", "Page 3\nand 2"),
    ]:
        assert citations.pages_rewritten(text, pages) == want, text
    for bad in ("page 9", "pages 3-1"):
        with pytest.raises(ValueError):
            citations.pages_rewritten(bad, pages)


def test_citations():
    box = "<|box_start|>[1, 2, 3, 4]<|box_end|>"
    places = [{"source": {"page": 3, "bbox": [1, 2, 3, 4]}, "targets": [{"page": 5, "bbox": [6, 7.5, 8, 9]}, {"page": 6, "bbox": [0, 0, 1, 1]}]}]
    turns = [{"role": "user", "content": "Page 1\n<image>\nPage 2\n<image>\nWhere?"}, {"from": "gpt", "value": f"On Page 3 {box} and page 3.</think>page 3 {box}"}]
    got = citations.conversation_rewritten(turns, places, {"3": [5, 6]}, 6)
    assert got[0]["content"] == "".join(f"Page {k}\n<image>\n" for k in range(1, 7)) + "Where?"
    assert got[1]["value"] == f"On Page 5 <|box_start|>[6, 7.5, 8, 9]<|box_end|> Page 6 <|box_start|>[0, 0, 1, 1]<|box_end|> and Pages 5 and 6.</think>page 3 {box}"
    meta = {"evidence_locations": [{"page": 3, "bbox": [1, 2, 3, 4], "bbox_abs": 1, "k": "v"}], "task": "t"}
    assert citations.metadata_rewritten(meta, places) == {"task": "t", "evidence_locations": [{"page": 5, "bbox": [6, 7.5, 8, 9], "k": "v"}, {"page": 6, "bbox": [0, 0, 1, 1], "k": "v"}]}
    assert citations.places_of(meta, turns) == [(3, (1, 2, 3, 4))]
    assert citations.strict(f"Page 3 {box} Page 4<|begin_of_box|>[1,2,3,4]<|end_of_box|>") and citations.strict("none")
    for bad in (box, "Page 3 <|box_start|>[1, 2, 3, 4]<|end_of_box|>", "Page 3 <|box_start|>[1, 2, 3]<|box_end|>", "Page 0 " + box, "Page 3 <|box_start|>[3, 2, 1, 4]<|box_end|>", box + "<|box_end|>"):
        assert not citations.strict(bad), bad
    with pytest.raises(ValueError):
        citations.citations_rewritten(f"Page 4 {box}", {4: [1]}, citations.place_map(places))
    with pytest.raises(ValueError):
        citations.conversation_rewritten([{"role": "user", "content": "see <image>"}], [], {}, 1)
