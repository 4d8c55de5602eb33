"""Queries of graders and rewards, over answers that are made from the tables by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import citations, geometry, grading, messages, text
from vellum.operators import rewards
from vellum.plans.scores import TOKENS
from vellum.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


@query()
def mrcr_ratio(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("k7 "), "text").alias("a"), F.concat(F.lit("k7 "), F.expr("substring(text, 11)")).alias("b"))
    return rows.select("doc_id", F.round(grading.prefixed_ratio_udf("a", "b", F.lit("k7 ")), 6).alias("ratio"))


@query("SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS score FROM events")
def boxed_math(spark, sf_dir):
    e = F.col("event_id").cast("string")
    said = F.concat(F.lit("so \\boxed{\\frac"), e, F.lit("{7}} or \\boxed{"), e, F.when(F.col("event_id") % 3 == 0, "").otherwise("1"), F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", grading.math_score_udf(said, e).alias("score"))


@query("SELECT event_id, CAST(event_id % 4 > 0 AS DOUBLE) AS score, CAST(event_id AS VARCHAR) AS answer FROM events")
def gsm_scores(spark, sf_dir):
    e = F.col("event_id").cast("string")
    said = F.concat(F.lit("2 and 3 make #### "), F.format_number("event_id", 0), F.lit(" ok"))
    gold = F.when(F.col("event_id") % 4 > 0, e).otherwise("x")
    return table(spark, sf_dir, "events").select("event_id", grading.gsm_score(said, gold).alias("score"), grading.gsm_answer(said).alias("answer"))


@query("SELECT event_id, 1 AS calls, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS invalid FROM events")
def tool_call_parse(spark, sf_dir):
    call = F.format_string('<tool_call>{"name": "zoom_region", "arguments": {"page": %d}}</tool_call>', F.col("event_id") % 9)
    said = F.concat(F.lit("a "), call, F.when(F.col("event_id") % 2 == 0, " then <tool_call>{").otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", messages.tool_calls(said).alias("t")).select("event_id", F.size("t.calls").alias("calls"), "t.invalid")


@query("SELECT doc_id, 'see Pages ' || (doc_id % 5 + 10) || ' and ' || (doc_id % 5 + 11) || ', then Page ' || (doc_id % 5 + 11) AS said FROM documents")
def remap_conversation(spark, sf_dir):
    n = F.col("doc_id") % 5
    said = F.format_string("see pages %d-%d, then Page %d", n + 1, n + 2, n + 2)
    pages = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda p: F.struct(p.alias("page"), F.array(p + 9).alias("targets")))
    return table(spark, sf_dir, "documents").select("doc_id", citations.pages_rewritten_udf(said, pages).alias("said"))


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 800 AS DOUBLE) AS x0, CAST(l_suppkey * 3 % 800 AS DOUBLE) AS y0,
  CAST(l_partkey % 800 + l_quantity * 4 AS DOUBLE) AS x1, CAST(l_suppkey * 3 % 800 + 60 AS DOUBLE) AS y1 FROM lineitem),
s AS (SELECT *, least(1000, greatest(80, (x1 - x0) * 1.2)) AS w, least(1000, greatest(80, (y1 - y0) * 1.2)) AS h FROM x)
SELECT l_orderkey, l_linenumber, round(least(greatest((x0 + x1) / 2 - w / 2, 0), 1000 - w), 6) AS left_x, round(least(greatest((y0 + y1) / 2 - h / 2, 0), 1000 - h), 6) AS top_y,
  round(w, 6) AS width, round(h, 6) AS height FROM s""")
def expanded_evidence(spark, sf_dir):
    x, y = F.col("l_partkey") % 800, F.col("l_suppkey") * 3 % 800
    box = F.array(x.cast("double"), y.cast("double"), (x + F.col("l_quantity") * 4).cast("double"), (y + 60).cast("double"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", geometry.expanded_box(box).alias("b"))
    r6 = lambda c, n: F.round(c, 6).alias(n)
    return rows.select("l_orderkey", "l_linenumber", r6(F.col("b")[0], "left_x"), r6(F.col("b")[1], "top_y"), r6(F.col("b")[2] - F.col("b")[0], "width"), r6(F.col("b")[3] - F.col("b")[1], "height"))


@query("""
SELECT event_id, CAST(floor(x * 1200 / 1000) AS BIGINT) AS px0, CAST(ceil(least(1000, x + 77) * 1200 / 1000) AS BIGINT) AS px1 FROM (SELECT event_id, CAST(event_id * 13 % 950 AS DOUBLE) AS x FROM events)""")
def pixel_boxes(spark, sf_dir):
    x = (F.col("event_id") * 13 % 950).cast("double")
    box = geometry.pixel_box(F.array(x, F.lit(0.0), F.least(F.lit(1000.0), x + 77), F.lit(1000.0)), F.lit(1200), F.lit(1600))
    return table(spark, sf_dir, "events").select("event_id", box[0].cast("long").alias("px0"), box[2].cast("long").alias("px1"))


@query()
def document_reward(spark, sf_dir):
    d = F.col("doc_id")
    call = F.format_string('<tool_call>{"name": "zoom_region", "arguments": {"page": %d, "bbox_2d": [100, 100, 300, %d]}}</tool_call>', d % 3 + 1, 200 + d % 100)
    said = F.concat(F.lit("<think>look "), call, F.lit("</think><answer>"), F.when(d % 2 == 0, F.col("lang")).otherwise("none"), F.lit("</answer>"))
    pair = F.struct((d % 3 + 1).cast("int").alias("page"), F.array(*[F.lit(float(x)) for x in (120, 110, 280, 230)]).alias("box"))
    rows = table(spark, sf_dir, "documents").select("doc_id", said.alias("solution"), F.array("lang").alias("golds"), F.array(pair).alias("evidence"), F.lit(5).alias("num_pages"), F.lit(72.0).alias("dpi"))
    return rewards.document_reward(rows).select("doc_id", *[F.round(c, 6).alias(c) for c in ("score", "acc_reward", "format_reward", "iou_reward", "tool_bonus")])


@query("SELECT event_id, CAST(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS score FROM events")
def dispatched_scores(spark, sf_dir):
    e = F.col("event_id")
    source = F.when(e % 3 == 0, "gsm").otherwise("math")
    said = F.when(e % 3 == 0, F.concat(F.lit("#### "), e.cast("string"))).otherwise(F.concat(F.lit("\\boxed{"), e.cast("string"), F.lit("}")))
    gold = F.when(e % 2 == 0, e.cast("string")).otherwise("no")
    return table(spark, sf_dir, "events").select("event_id", rewards.dispatched(source, said, gold).alias("score"))


@query(f"""
WITH t AS (SELECT doc_id, array_to_string({TOKENS.replace('{0}', 'text')}, ' ') AS n FROM documents)
SELECT doc_id, length(n) AS n, md5(n) AS digest FROM t""")
def normalized_answers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_answer(F.col("text")).alias("t")).select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


@query("SELECT doc_id, CASE WHEN n_chars >= 1000000 THEN printf('%.2fM', n_chars / 1e6) WHEN n_chars >= 1000 THEN printf('%.2fK', floor(n_chars / 10.0 + 0.5) / 100) ELSE CAST(n_chars AS VARCHAR) END AS said FROM documents")
def human_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.human_count(F.col("n_chars")).alias("said"))
