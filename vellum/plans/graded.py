"""Queries of graders over texts as they stand in the tables: letters, tool calls, formats, numbers, media and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import grading, messages, text
from vellum.operators import measures, rewards
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


@query(r"""
WITH t AS (SELECT doc_id, replace(replace(replace(coalesce(text, ''), ' the ', ' \boxed{ '), ' of ', ' } '), ' for ', ' **Answer**: ') AS x FROM documents),
b AS (SELECT doc_id, x, list_transform(string_split(x, '\boxed{')[2:], lambda p: CASE WHEN contains(p, '}') AND NOT contains(string_split(p, '}')[1], '{') THEN string_split(p, '}')[1] END) AS held FROM t),
c AS (SELECT doc_id, x, trim(list_last(list_filter(held, lambda h: h IS NOT NULL)), ' ') AS boxed FROM b),
l AS (SELECT doc_id, boxed, upper(list_last(regexp_extract_all(x, '(?i)answer[*_]{0,2}\s*:[\s*_]{0,2}\s*([a-z])(?:[^a-z0-9]|$)', 1))) AS stated,
  list_last(list_filter(regexp_split_to_array(x, '[^\p{L}\p{M}\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z]'))) AS lone,
  list_last(list_filter(regexp_split_to_array(coalesce(boxed, ''), '[^\p{L}\p{M}\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z]'))) AS inside FROM c)
SELECT doc_id, coalesce(CASE WHEN length(boxed) = 1 THEN upper(boxed) ELSE inside END, stated, lone) AS letter FROM l""")
def choice_letters(spark, sf_dir):
    """Letters of whole documents in which some words have become boxes and answer lines."""
    said = F.coalesce("text", F.lit(""))
    for old, new in ((" the ", " \\boxed{ "), (" of ", " } "), (" for ", " **Answer**: ")):
        said = F.replace(said, F.lit(old), F.lit(new))
    return table(spark, sf_dir, "documents").select("doc_id", text.choice_letter(said).alias("letter"))


@query("""
WITH c AS (SELECT click_id, coalesce(props, '') AS p, kind IS NOT DISTINCT FROM 'error' AS more FROM clicks)
SELECT click_id, CASE WHEN json_valid(p) AND starts_with(p, '{') THEN 1 ELSE 0 END AS calls, 1 + more::INT - CASE WHEN json_valid(p) AND starts_with(p, '{') THEN 1 ELSE 0 END AS invalid FROM c""")
def property_calls(spark, sf_dir):
    """The properties of clicks as bodies of tool calls: objects, broken ones and none, some with another call left open."""
    said = F.concat(F.lit("look <tool_call> "), F.coalesce("props", F.lit("")), F.lit(" </tool_call>"), F.when(F.col("kind") == "error", " then <tool_call>{").otherwise(""))
    return table(spark, sf_dir, "clicks").select("click_id", messages.tool_calls(said).alias("t")).select("click_id", F.size("t.calls").alias("calls"), "t.invalid")


@query(r"""
WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS x, coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS gold, role FROM conversations)
SELECT conv_id, turn, CAST(role <> 'system' AND trim(CASE WHEN length(x) % 3 = 0 THEN '  ' ELSE gold END) <> '' AND length(x) % 4 > 0 AS DOUBLE) AS reward FROM c""")
def turn_formats(spark, sf_dir):
    """Turns as answers: the thinking is the turn, the answer the next one, with something behind it or the thinking left open for some."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    x = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", x.alias("x"), F.coalesce(F.lead("text").over(w), F.lit("")).alias("gold"))
    n = F.length("x")
    said = F.concat("x", F.when(F.col("role") == "system", "").otherwise("</think>"), F.lit("<answer>"), F.when(n % 3 == 0, "  ").otherwise(F.col("gold")), F.lit("</answer>"), F.when(n % 4 == 0, " and more").otherwise(" \n"))
    return rows.select("conv_id", "turn", text.format_reward(said).alias("reward"))


@query(r"""
WITH p AS (SELECT click_id, props AS x, replace(props, '"k": ', '#### ') AS y FROM clicks WHERE props IS NOT NULL),
a AS (SELECT click_id, list_last(list_filter(regexp_extract_all(x, '-?[0-9.,]+'), lambda n: n NOT IN ('', '.'))) AS last, nullif(replace(regexp_extract(y, '#### (-?[0-9.,]+)', 1), ',', ''), '') AS marked, json_extract_string(CASE WHEN json_valid(x) THEN x END, '$.k') AS k FROM p)
SELECT click_id, last, marked, CAST(coalesce(marked = k, false) AS DOUBLE) AS score FROM a""")
def property_numbers(spark, sf_dir):
    """The last number of a text, the marked one, and its score against the property it stands for."""
    x = F.col("props")
    marked = F.replace(x, F.lit('"k": '), F.lit("#### "))
    gold = F.get_json_object(F.when(F.try_parse_json(x).isNotNull(), x), "$.k")
    rows = table(spark, sf_dir, "clicks").where(x.isNotNull())
    return rows.select("click_id", grading.gsm_answer(x, strict=False).alias("last"), grading.gsm_answer(marked).alias("marked"), grading.gsm_score(marked, gold).alias("score"))


@query("""
WITH c AS (SELECT conv_id, turn, replace(coalesce(text, ''), '. ', '<image>') AS x FROM conversations),
p AS (SELECT conv_id, turn, unnest(string_split(x, '<image>')) AS piece, unnest(range(0, len(string_split(x, '<image>')))) AS i FROM c),
t AS (SELECT conv_id, turn, 2 * i - 1 AS pos, 'image' AS type, CASE WHEN i <= 3 THEN i || '.png' END AS v FROM p WHERE i > 0 UNION ALL SELECT conv_id, turn, 2 * i, 'text', piece FROM p WHERE piece <> '')
SELECT conv_id, turn, count(*) AS parts, count(v) FILTER (type = 'image') AS images, md5(string_agg(type || coalesce(v, '?'), '|' ORDER BY pos)) AS digest FROM t GROUP BY conv_id, turn""")
def interleaved_turns(spark, sf_dir):
    """Turns whose full stops have become media tags, with images for the first three."""
    x = F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit("<image>"))
    rows = table(spark, sf_dir, "conversations").where("text <> ''").select("conv_id", "turn", messages.interleaved(x, F.array(*[F.lit(f"{i}.png") for i in (1, 2, 3)])).alias("p"))
    said = F.array_join(F.transform("p", lambda p: F.concat(p["type"], F.coalesce(p["value"], F.lit("?")))), "|")
    return rows.select("conv_id", "turn", F.size("p").cast("long").alias("parts"), F.size(F.filter("p", lambda p: (p["type"] == "image") & p["value"].isNotNull())).cast("long").alias("images"), F.md5(said).alias("digest"))


@query("""
WITH d AS (SELECT doc_id, list_transform(string_split(left(coalesce(text, ''), 300), ' '), lambda w: length(w)) AS x FROM documents),
e AS (SELECT doc_id, x, len(x) AS n, x[1] % 9 + 1 AS p, greatest(len(x) // 3, 1) AS q FROM d), t AS (SELECT *, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i FROM e),
m AS (SELECT *, (v > 2)::INT AS att, (v % 2)::INT AS act FROM t)
SELECT doc_id, CAST(coalesce(sum((i + 1) * CASE WHEN i = least(p + q, n) - 1 OR (p > 1 AND i < least(p, n) - 1) THEN 0 ELSE att END), 0) AS BIGINT) AS loss_mask, CAST(coalesce(sum(att) FILTER (i < n - q), 0) AS BIGINT) AS prompt_length,
  CAST(coalesce(sum(att * act) FILTER (i >= n - q), 0) AS BIGINT) AS response_length, CAST(coalesce(sum(att * (1 - act)) FILTER (i >= n - q), 0) AS BIGINT) AS obs_length FROM m GROUP BY doc_id""")
def masks_of_words(spark, sf_dir):
    """Words that open a document as a sample: its loss mask, and the lengths of its prompt, response and observations."""
    x = F.transform(F.split(F.substring(F.coalesce("text", F.lit("")), 1, 300), " "), lambda w: F.length(w))
    rows = table(spark, sf_dir, "documents").select("doc_id", x.alias("x")).withColumn("q", F.greatest(F.floor(F.size("x") / 3), F.lit(1)).cast("int"))
    attention, action = F.transform("x", lambda v: (v > 2).cast("int")), F.transform("x", lambda v: (v % 2).cast("int"))
    mask = messages.supervised_mask(attention, (F.col("x")[0] % 9 + 1).cast("int"), F.col("q"))
    info = measures.response_info(attention, F.col("q"), action)
    at = F.aggregate(F.transform(mask, lambda v, i: (i + 1).cast("long") * v), F.lit(0).cast("long"), lambda a, v: a + v)
    return rows.select("doc_id", at.alias("loss_mask"), info.alias("i")).select("doc_id", "loss_mask", "i.prompt_length", "i.response_length", "i.obs_length")


@query("""
WITH s AS (SELECT sale_id, status, total, priority FROM sales WHERE status IS NOT NULL AND total IS NOT NULL)
SELECT sale_id, CAST(CASE status WHEN 'open' THEN CASE WHEN priority % 2 = 0 THEN 1 ELSE 0 END WHEN 'done' THEN CASE WHEN priority IS NOT NULL AND priority < 3 THEN 1 ELSE 0 END ELSE CASE WHEN priority = 2 THEN 1 ELSE 0 END END AS DOUBLE) AS score FROM s""")
def scores_by_source(spark, sf_dir):
    """Sales as answers of three sources, each scored by its own rule: a marked number, a boxed one, or an exact text."""
    rewards.register_scorer("exact", rewards.exact_match)
    amount = F.format_string("%.2f", "total")
    p = F.col("priority")
    said = F.when(F.col("status") == "open", F.concat(F.lit("so #### "), amount)).when(F.col("status") == "done", F.concat(F.lit("it is \\boxed{"), amount, F.lit("}"))).otherwise(F.concat(F.lit(" The "), amount, F.lit(".")))
    gold = (
        F.when(F.col("status") == "open", F.when(p % 2 == 0, amount).otherwise("none")).when(F.col("status") == "done", F.when(p < 3, amount).otherwise("none"))
        .otherwise(F.when(p == 2, F.concat(F.lit("the "), amount)).otherwise("another"))
    )
    source = F.when(F.col("status") == "open", "gsm").when(F.col("status") == "done", "math").otherwise("exact")
    rows = table(spark, sf_dir, "sales").where("status IS NOT NULL AND total IS NOT NULL")
    return rows.select("sale_id", rewards.dispatched(source, said, gold).alias("score"))


@query("""
WITH c AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS x, length(text) AS n FROM conversations WHERE regexp_full_match(coalesce(text, ''), '[\\x00-\\x7F]*')),
p AS (SELECT conv_id, turn, n, lower(translate(x, '!"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', '')) AS plain FROM c)
SELECT conv_id, turn, CAST(CASE WHEN n % 3 = 0 THEN plain = '' WHEN n % 3 = 1 THEN true ELSE n IS NULL END AS DOUBLE) AS score FROM p""")
def retrieval_matches(spark, sf_dir):
    """Turns in ASCII as answers of retrieval agents, in other case and without punctuation for a third of them, against the turn."""
    x = F.coalesce("text", F.lit(""))
    n = F.length("text")
    rows = table(spark, sf_dir, "conversations").where(x.rlike(r"\A[\x00-\x7F]*\z"))
    answer = F.when(n % 3 == 1, F.upper(x)).otherwise(F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("other "), x)))
    said = F.concat(F.lit("<answer>no</answer></think>x <answer>"), F.coalesce(answer, F.lit("")), F.lit("</answer> y"))
    gold = F.regexp_replace(x, r"^\s+|\s+$", "")
    return rows.select("conv_id", "turn", rewards.retrieval_exact(said, gold).alias("score"))
