"""Rewards of recorded answers: document questions with evidence boxes, sources of other kinds, and user scorers."""

from __future__ import annotations

import inspect
import re
import os
import importlib.util
import hashlib
import functools
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import geometry, grading, text

#: Weights of the document reward. Fixed values.
ANSWER_WEIGHT, FORMAT_WEIGHT, TOOL_WEIGHT = 0.8, 0.2, 0.2
#: How a prompt ends that opens the thinking. Fixed value.
PREFILLED = "<|im_start|>assistant\n<think>"
#: How evidence boxes are widened. Fixed values.
EXPANSION, LEAST_SIDE = 1.2, 80.0


def parsed(rows: DataFrame) -> DataFrame:
    """rows (solution, golds, evidence, num_pages) with p: what only a parser can find in the solution.

    evidence: array of struct(page, box) with expanded boxes. A prompt column, where there is one, says whether the thinking
    was opened before the solution begins: its end opens an assistant turn and the thinking. p: the final answer, matched golds, whether its form is
    right, calls, invalid calls, valid calls, and the sum and best of the boxes' overlap with evidence, one to one.
    """
    kind = "answer string, matched int, formed boolean, calls int, invalid int, valid int, quality double, best_iou double, used int"

    def judge(solution: str, golds, places, areas, num_pages, prompt) -> tuple:
        answer = grading.final_answer(solution)
        said = "\n".join(grading.assistant_turns(solution))
        calls, broken = grading.tool_calls(said)
        boxes = []
        for c in calls:
            a = c.get("arguments")
            page, box = (a.get("page"), a.get("bbox_2d")) if isinstance(a, dict) else (None, None)
            whole = isinstance(page, int) and not isinstance(page, bool) and 1 <= page and (num_pages is None or page <= num_pages)
            if c.get("name") == "zoom_region" and whole and is_box(box):
                boxes.append((page, box))
        evidence = [(p, b.tolist()) for p, b in zip(places, areas, strict=True)] if boxes else []
        ious = [[grading.box_iou(b, box) if p == page else 0.0 for page, box in evidence] for p, b in boxes]
        # a box of more than half a page counts less, a whole page nothing
        weights = [[x * min(1.0, 2 * (1 - (b[2] - b[0]) * (b[3] - b[1]) / 1e6)) if x else 0.0 for x in row] for row, (_, b) in zip(ious, boxes, strict=True)]
        quality, used = grading.assigned(weights) if boxes and evidence else (0.0, 0)
        end = grading.without_end(said)
        opened = end.count("<think>") + (prompt or "").rstrip().endswith(PREFILLED)
        formed = bool(answer) and opened == end.count("</think>") and not end.rpartition("</answer>")[2].strip()
        best = max((x for row in ious for x in row), default=0.0)
        return answer, grading.matched_golds_of(answer, tuple(golds)), formed, len(calls) + broken, broken + len(calls) - len(boxes), len(boxes), quality, best, used

    @F.pandas_udf(kind)
    def run(packed: pd.DataFrame) -> pd.DataFrame:
        pages = packed["num_pages"].map(lambda x: None if x is None or math.isnan(x) else int(x))
        columns = (packed["solution"], packed["golds"], packed["places"], packed["areas"], pages, packed["prompt"])
        found = [judge(s or "", *rest) for s, *rest in zip(*columns, strict=True)]
        return pd.DataFrame(found, columns=[c.split()[0] for c in kind.split(", ")])

    # columns of numbers, as structs inside arrays reach Python one by one
    evidence = (F.col("evidence")["page"].alias("places"), F.col("evidence")["box"].alias("areas"))
    prompt = F.col("prompt") if "prompt" in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("p", run(F.struct("solution", "golds", *evidence, F.col("num_pages").cast("double").alias("num_pages"), prompt.alias("prompt"))))


def is_box(box) -> bool:
    if not isinstance(box, list) or len(box) != 4:
        return False
    for x in box:
        # what JSON holds is of these types themselves; NaN fails the comparison
        if type(x) not in (int, float) or not 0 <= x <= 1000:
            return False
    return box[0] < box[2] and box[1] < box[3]


def evidence_of(pairs: Column) -> Column:
    """Distinct valid (page, box) pairs, their boxes widened."""
    valid = F.filter(pairs, lambda e: (e["page"] >= 1) & geometry.valid_box(e["box"]))
    return F.array_distinct(F.transform(valid, lambda e: F.struct(e["page"].alias("page"), geometry.expanded_box(e["box"], EXPANSION, LEAST_SIDE).alias("box"))))


def document_reward(rows: DataFrame) -> DataFrame:
    """rows (solution, golds, evidence pairs, num_pages, dpi) with score and its parts; the arithmetic stays native."""
    found = parsed(rows.withColumn("evidence", evidence_of(F.col("evidence"))))
    p, n = F.col("p"), F.size("evidence")
    found = found.withColumns(
        {
            "acc_reward": F.coalesce(F.try_divide(p["matched"], F.size("golds")), F.lit(0.0)),
            "iou_reward": F.coalesce(F.try_divide(p["quality"], F.least(p["calls"], n)), F.lit(0.0)),
            "call_efficiency": F.least(F.lit(1.0), F.coalesce(F.try_divide(n, p["calls"]), F.lit(0.0))),
            "format_reward": (p["formed"] & (p["calls"] <= n) & (p["invalid"] == 0)).cast("double"),
            "answer_correct": ((p["answer"] != "") & (F.size("golds") > 0) & (p["matched"] == F.size("golds"))).cast("double"),
            "dpi_factor": F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (144.0 - F.coalesce("dpi", F.lit(72.0))) / 72.0)), F.lit(2)),
        }
    )
    bonus = TOOL_WEIGHT * F.col("answer_correct") * F.col("dpi_factor") * F.col("iou_reward") * F.col("call_efficiency")
    return found.withColumn("tool_bonus", bonus).withColumn(
        "score", ANSWER_WEIGHT * F.col("acc_reward") + FORMAT_WEIGHT * F.col("format_reward") + F.col("tool_bonus")
    )


#: The parts of a document reward that with_parts gives, beside the constants of evidence boxes. Fixed values.
PARTS = (
    "score", "acc_reward", "answer_matches", "answer_partial", "answer_correct", "final_answer_present", "format_reward", "structural_format_reward", "actual_tool_called", "dpi", "dpi_factor",
    "tool_reward", "matched_evidence", "iou_reward", "call_efficiency", "excess_call_ratio", "best_iou", "tool_calls", "valid_tool_calls", "invalid_tool_calls",
)


def with_parts(found: DataFrame) -> DataFrame:
    """What document_reward found, with every part of it as a column: answer_exact, answer_count, tool_bonus, evidence_count and
    the sizes of evidence boxes too. answer_partial is the best share of a gold's words that an answer without a match has."""
    p, n = F.col("p"), F.size("evidence")
    words = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("([a-z0-9]+)"), F.lit(1)))
    shares = F.transform("golds", lambda g: text.token_set_overlap(words(p["answer"]), words(g)))
    return found.withColumns(
        {
            "answer_exact": F.col("acc_reward"), "answer_matches": p["matched"], "answer_count": F.size("golds"), "final_answer_present": (p["answer"] != "").cast("double"),
            "answer_partial": F.when(p["matched"] == 0, F.coalesce(F.array_max(shares), F.lit(0.0))).otherwise(0.0), "structural_format_reward": p["formed"].cast("double"),
            "actual_tool_called": (p["valid"] > 0).cast("double"), "dpi": F.coalesce("dpi", F.lit(72.0)), "tool_reward": F.col("tool_bonus") / TOOL_WEIGHT, "evidence_count": n,
            "evidence_expansion": F.lit(EXPANSION), "min_evidence_width": F.lit(LEAST_SIDE), "min_evidence_height": F.lit(LEAST_SIDE), "matched_evidence": p["used"],
            "excess_call_ratio": F.greatest(F.lit(0), p["calls"] - n) / F.greatest(F.lit(1), p["calls"]), "best_iou": p["best_iou"],
            "tool_calls": p["calls"], "valid_tool_calls": p["valid"], "invalid_tool_calls": p["invalid"],
        }
    )


#: Scorers by data source: functions of the prediction and gold columns.
SCORERS: dict[str, Callable[[Column, Column], Column]] = {}


def register_scorer(source: str, scorer: Callable[[Column, Column], Column]) -> None:
    """A scorer for a source; it must take a prediction and a gold column."""
    try:
        inspect.signature(scorer).bind(None, None)
    except TypeError:
        raise ValueError("a scorer takes a prediction and a gold column") from None
    SCORERS[source] = scorer


def dispatched(source: Column, pred: Column, gold: Column) -> Column:
    """Each row's score by its source's scorer; an unknown source raises."""
    out = F.raise_error(F.concat(F.lit("no scorer for "), source)).cast("double")
    for name, scorer in SCORERS.items():
        out = F.when(source == name, scorer(pred, gold).cast("double")).otherwise(out)
    return out


def exact_match(pred: Column, gold: Column) -> Column:
    """1 if an answer is the gold, both as retrieval agents' answers are normalised; null texts match nothing."""
    return F.coalesce(text.normalize_agent_answer(pred) == text.normalize_agent_answer(gold), F.lit(False)).cast("double")


register_scorer("gsm", grading.gsm_score)
register_scorer("math", grading.math_score_udf)


def load_scorer(path: str, name: str, **bound) -> Callable[[Column, Column], Column]:
    """A scorer from a user's file: a function of a prediction and a gold, and of further arguments that are bound here.

    A function that takes columns and gives one is used as it is; one marked ``plain = True`` takes texts and gives a
    number (or a dict with ``score``), and runs over Arrow batches. A file or name that isn't there raises.
    """
    spec = importlib.util.spec_from_file_location("scorer_" + hashlib.sha1(path.encode()).hexdigest(), path)
    if spec is None or not os.path.exists(path):
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise AttributeError(f"no {name} in {path}")
    own = functools.partial(getattr(module, name), **bound)
    if not getattr(module, "plain", False):
        return own
    source = open(path).read()

    def build(pred: Column, gold: Column) -> Column:
        @F.pandas_udf("double")
        def run(pred: pd.Series, gold: pd.Series) -> pd.Series:
            # the file travels as text, so that executors needn't see it
            space: dict = {"__name__": "scorer"}
            exec(compile(source, path, "exec"), space)  # noqa: S102 - the user's own scorer
            found = [space[name](p, g, **bound) for p, g in zip(pred, gold, strict=True)]
            return pd.Series([float(x["score"]) if isinstance(x, dict) else float(x) for x in found])

        return run(pred, gold)

    return build


#: Markers of retrieved documents and queries in agent transcripts. Fixed values.
DOCUMENTS, DOCUMENTS_END, QUERY, QUERY_END = "<|begin_of_documents|>", "<|end_of_documents|>", "<|begin_of_query|>", "<|end_of_query|>"


def retrieval_answer(said: Column) -> Column:
    """What the last answer tag opens, up to its end."""
    return F.trim(F.element_at(F.split(F.element_at(F.split(said, "<answer>"), -1), "</answer>"), 1))


def retrieval_reward(pred: Column, gold: Column) -> Column:
    """Reward of an agent that may retrieve: twice the token F1 of its answer, +1 or -1 for having retrieved, and -1 for a
    transcript out of form. The prediction goes on from an opened think tag.

    Out of form: numbers of document and query markers that differ, roles spelled out, think tags out of balance, not
    exactly one answer, markers inside it, or one of more than ten words.
    """
    said = F.concat(F.lit("<think>"), pred)
    count = lambda x: F.regexp_count(said, F.lit(re.escape(x)))
    marks = [count(x) for x in (DOCUMENTS + "\n", DOCUMENTS_END + "\n", QUERY, QUERY_END, DOCUMENTS, DOCUMENTS_END, DOCUMENTS + "\n(1)")]
    uneven = F.array_min(F.array(*marks)) != F.array_max(F.array(*marks))
    answer = retrieval_answer(said)
    bad = (
        uneven | (F.regexp_count(said, F.lit("[Aa]ssistant:")) > 0) | (count("<think>") != count("</think>")) | (count("<answer>") != 1) | (count("</answer>") != 1)
        | answer.contains("begin_of_query") | answer.contains("begin_of_documents") | (F.size(text.tokens(answer)) > 10)
    )
    return 2.0 * text.agent_f1(answer, gold)["f1"] + F.when(marks[-1] >= 1, 1.0).otherwise(-1.0) + F.when(bad, -1.0).otherwise(0.0)


def retrieval_exact(pred: Column, gold: Column) -> Column:
    """1 if what the last answer tag behind the last thinking holds is the gold, but for case and ASCII punctuation."""
    plain = lambda x: F.translate(F.lower(x), text.PUNCTUATION, "")
    said = F.trim(F.regexp_replace(retrieval_answer(F.substring_index(pred, "</think>", -1)), r"(?U)^\s+|\s+$", ""))
    return F.coalesce(plain(said) == plain(gold), F.lit(False)).cast("double")


register_scorer("retrieval", retrieval_reward)
register_scorer("retrieval_test", retrieval_exact)
