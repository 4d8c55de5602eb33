"""Queries of generation summaries, training-set rows and page references, over records of many shapes made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import citations, messages, prompts
from vellum.operators import batches, measures, rewards, rollup, scoring
from vellum.session import table
from vellum.sources import training

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def records(spark, sf_dir):
    """Events as prediction records: some failed, some with empty error texts, counts missing or zero."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("task"), (e % 101 / 100.0).alias("score"), F.when(e % 13 == 0, "timeout").when(e % 13 == 1, "").alias("error"),
        F.when(e % 3 > 0, F.when(e % 3 == 1, 0).otherwise(e % 700)).alias("initial_prompt_tokens"), (e % 900).alias("prompt_tokens"),
        F.when(e % 5 > 0, e % 50).alias("completion_tokens"), F.when(e % 4 == 0, e % 300).alias("vision_tokens_est"), (e % 6).alias("num_pages"),
        F.when(e % 7 == 0, "length").when(e % 7 < 6, "stop").alias("finish_reason"),
    )


RECORDS = """r AS (SELECT event_type AS task, event_id % 101 / 100.0 AS score, CASE event_id % 13 WHEN 0 THEN 'timeout' WHEN 1 THEN '' END AS error,
  CASE event_id % 3 WHEN 1 THEN 0 WHEN 2 THEN event_id % 700 END AS initial, event_id % 900 AS prompt, CASE WHEN event_id % 5 > 0 THEN event_id % 50 END AS completion,
  CASE WHEN event_id % 4 = 0 THEN event_id % 300 END AS vision, event_id % 6 AS pages, CASE WHEN event_id % 7 = 0 THEN 'length' WHEN event_id % 7 < 6 THEN 'stop' END AS finish FROM events),
x AS (SELECT *, coalesce(error, '') = '' AS ok FROM r)"""


@query(f"""WITH {RECORDS}
SELECT task, count(*) AS n, round(avg(CASE WHEN ok THEN score ELSE 0 END), 6) AS accuracy, round(avg(nullif(coalesce(initial, prompt), 0)) FILTER (ok), 6) AS prompt_tokens,
  round(avg(nullif(completion, 0)) FILTER (ok), 6) AS completion_tokens, round(avg(nullif(vision, 0)) FILTER (ok), 6) AS vision_tokens_est,
  round(avg(nullif(pages, 0)) FILTER (ok), 6) AS num_pages, count(*) FILTER (NOT ok) AS errors, count(*) FILTER (ok AND finish = 'length') AS truncated
FROM x GROUP BY task""")
def task_summaries(spark, sf_dir):
    found = scoring.task_summary(records(spark, sf_dir), ["task"])
    rounded = ("accuracy", "prompt_tokens", "completion_tokens", "vision_tokens_est", "num_pages")
    return found.select("task", "n", *[F.round(c, 6).alias(c) for c in rounded], "errors", "truncated")


@query("""
WITH r AS (SELECT lang, doc_id AS d, n_chars AS c, doc_id % 5 / 4.0 AS g, doc_id % 3 > 0 AS hit, CASE WHEN n_chars > 6000 THEN 'pages' WHEN doc_id % 19 = 0 THEN '' END AS skipped,
  CASE WHEN doc_id % 17 = 0 THEN 'x' END AS error, CASE WHEN doc_id % 2 = 0 THEN n_chars % 800 END AS initial, CASE WHEN doc_id % 8 > 0 THEN n_chars % 990 END AS prompt,
  CASE WHEN doc_id % 4 = 0 THEN doc_id % 70 END AS all_turns, doc_id % 60 AS completion, CASE WHEN doc_id % 6 > 0 THEN n_chars // 500 END AS pages, CASE WHEN doc_id % 9 = 0 THEN 'length' END AS finish FROM documents),
x AS (SELECT *, coalesce(skipped, '') = '' AND coalesce(error, '') = '' AS made FROM r)
SELECT lang, count(*) AS requested, count(*) FILTER (made) AS generated, count(*) FILTER (coalesce(skipped, '') <> '') AS skipped, count(error) AS errors, count(*) FILTER (made AND finish = 'length') AS truncated,
  round_even(100.0 * count(*) FILTER (made) / count(*), 2) AS coverage_pct, round_even(100 * coalesce(sum(g) FILTER (made), 0) / count(*), 2) AS score_all,
  round_even(100 * avg(g) FILTER (made), 2) AS score_generated, round_even(100.0 * count(*) FILTER (made AND hit) / count(*) FILTER (made), 2) AS prefix_hit_pct,
  CAST(round_even(avg(coalesce(initial, prompt)) FILTER (made), 0) AS BIGINT) AS mean_prompt_tokens, max(coalesce(initial, prompt)) FILTER (made) AS max_prompt_tokens,
  CAST(round_even(avg(coalesce(all_turns, completion)) FILTER (made), 0) AS BIGINT) AS mean_response_tokens, max(coalesce(all_turns, completion)) FILTER (made) AS max_response_tokens,
  round_even(avg(coalesce(pages, 0)), 1) AS mean_pages, CAST(coalesce(max(coalesce(pages, 0)), 0) AS BIGINT) AS max_pages
FROM x GROUP BY GROUPING SETS ((), (lang))""")
def needle_summary(spark, sf_dir):
    d, c = F.col("doc_id"), F.col("n_chars")
    rows = table(spark, sf_dir, "documents").select(
        "lang", (d % 5 / 4.0).alias("g"), (d % 3 > 0).alias("hit"), F.when(c > 6000, "pages").when(d % 19 == 0, "").alias("skipped_reason"), F.when(d % 17 == 0, "x").alias("error"),
        F.when(d % 2 == 0, c % 800).alias("initial_prompt_tokens"), F.when(d % 8 > 0, c % 990).alias("prompt_tokens"),
        F.struct(F.when(d % 4 == 0, d % 70).alias("completion_tokens")).alias("cumulative_usage"), (d % 60).alias("completion_tokens"),
        F.when(d % 6 > 0, F.floor(c / 500)).alias("num_pages"), F.when(d % 9 == 0, "length").alias("finish_reason"),
    )
    return rollup.overall_and_by(rows, ["lang"], scoring.needle_measures(F.col("g"), F.col("hit")))


@query("""
WITH r AS (SELECT doc_id, lower(text) AS said, [lang, 'the', source] AS golds, [CAST(doc_id % 2 AS DOUBLE), 0.25, 0.0] AS hits, doc_id % 3 > 0 AS exact, doc_id % 4 < 2 AS each FROM documents),
x AS (SELECT *, list_sum(hits) / 3 AS base, list_transform(golds, lambda g: CASE WHEN contains(said, lower(g)) THEN 1.0 ELSE 0.0 END) AS inside FROM r)
SELECT doc_id, round(CASE WHEN NOT exact OR said = '' THEN base WHEN each THEN list_sum(list_transform([1, 2, 3], lambda i: greatest(hits[i], inside[i]))) / 3 ELSE greatest(base, list_max(inside)) END, 6) AS score FROM x""")
def reasoning_credit(spark, sf_dir):
    d = F.col("doc_id")
    golds, hits = F.array(F.col("lang"), F.lit("the"), F.col("source")), F.array((d % 2).cast("double"), F.lit(0.25), F.lit(0.0))
    base = F.aggregate(hits, F.lit(0.0), lambda a, x: a + x) / 3
    score = scoring.with_reasoning(base, hits, golds, F.col("text"), d % 3 > 0, d % 4 < 2)
    return table(spark, sf_dir, "documents").select("doc_id", F.round(score, 6).alias("score"))


@query("""
WITH r AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN [] WHEN 1 THEN ['  ', lang] ELSE [lang, ' ' || source || ' '] END AS gold, 1 + doc_id % 3 AS low, 1 + doc_id % 3 + (doc_id % 11 = 0)::INT AS high,
  doc_id % 5 = 0 AS alone, doc_id % 13 = 0 AS same, doc_id % 4 AS kind FROM documents),
x AS (SELECT *, list_filter(list_transform(gold, lambda g: trim(g)), lambda g: g <> '') AS golds, CASE kind WHEN 0 THEN 96 WHEN 1 THEN 144 WHEN 2 THEN 72 ELSE 144 END AS hi, CASE kind WHEN 3 THEN 144 ELSE 72 END AS lo FROM r)
SELECT doc_id, CAST(len(golds) AS INT) AS golds, CAST(CASE WHEN alone THEN 1 ELSE 2 END AS INT) AS turns, CAST(lo AS DOUBLE) AS dpi, CAST(hi AS DOUBLE) AS high_res_dpi,
  CASE WHEN len(golds) = 0 THEN 'no gold answer' WHEN alone THEN 'no user turn' WHEN low <> high THEN 'page counts differ' WHEN kind <> 3 AND same THEN 'both pages are one file'
    WHEN kind <> 3 AND hi <= lo THEN 'the higher resolution isn''t higher' END AS reason FROM x""")
def rollout_preparation(spark, sf_dir):
    d = F.col("doc_id")
    turn = lambda role, text: F.struct(F.lit(role).alias("from"), text.alias("value"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("content"))
    asked, answered = turn("human", F.concat(F.lit("ask "), F.col("lang"))), turn("gpt", F.col("source"))
    pages = lambda n, dpi: F.transform(F.sequence(F.lit(1).cast("long"), n), lambda p: F.concat(F.lit("d/"), dpi, F.lit("/"), p.cast("string")))
    low, kind = 1 + d % 3, d % 4
    high = low + F.when(d % 11 == 0, 1).otherwise(0)
    own = F.when(d % 13 == 0, F.lit("low")).otherwise(F.lit("high"))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", d.alias("index"), d.alias("id"), F.when(d % 5 == 0, F.array(answered)).otherwise(F.array(asked, answered)).alias("conversations"),
        F.when(d % 7 == 0, F.array().cast("array<string>")).when(d % 7 == 1, F.array(F.lit("  "), F.col("lang"))).otherwise(F.array(F.col("lang"), F.concat(F.lit(" "), F.col("source"), F.lit(" ")))).alias("gold"),
        pages(low, F.lit("low")).alias("images"), F.when(kind != 0, pages(high, own)).alias("high_res_images"), F.when(kind == 0, pages(high, own)).alias("image_dpi96"),
        F.when(kind == 3, 144.0).otherwise(72.0).alias("low_dpi"), F.when(kind == 2, 72.0).when(kind > 0, 144.0).alias("high_dpi"),
    )
    found = training.rollout_rows(rows, "vision", "pages", "Answer from the pages.", " Answer.")
    return found.select(F.col("extra_info.index").alias("doc_id"), F.size("extra_info.gold").alias("golds"), F.size("prompt").alias("turns"), "extra_info.dpi", "extra_info.high_res_dpi", "reason")


@query("""
SELECT conv_id, chosen, md5(response) AS digest FROM (
  SELECT conv_id, true AS chosen, text AS response FROM conversations WHERE role = 'assistant' AND turn < 4 UNION ALL SELECT conv_id, false, text || '!' FROM conversations WHERE role = 'assistant' AND turn < 4)""")
def preference_rows(spark, sf_dir):
    pairs = table(spark, sf_dir, "conversations").where("role = 'assistant' AND turn < 4").select(F.col("conv_id").alias("prompt"), F.col("text").alias("chosen"), F.concat("text", F.lit("!")).alias("rejected"))
    return training.stacked(pairs).select(F.col("prompt").alias("conv_id"), F.col("is_chosen").alias("chosen"), F.md5("response").alias("digest"))


@query("""
WITH r AS (SELECT doc_id, doc_id % 6 + 1 AS p, doc_id % 3 + 1 AS w, doc_id % 8 AS shape FROM documents)
SELECT doc_id, CASE shape WHEN 0 THEN printf('as page %dth says', p) WHEN 1 THEN printf('on Page %d.', p + 20) WHEN 2 THEN printf('Pages %d and %d', p + 20, p + 21)
  WHEN 3 THEN printf('see Pages %d, %d and %d', p + 20, p + 21, p + 22) WHEN 4 THEN printf('homepage %d only', p) WHEN 5 THEN printf('Page %d', p + 20)
  WHEN 6 THEN printf('Pages %d and %d%s', p + 20, p + 21 + w, repeat('!', CAST(w AS INT))) ELSE printf('Page %d, %drd', p + 20, p) END AS said FROM r""")
def page_references(spark, sf_dir):
    p, w, shape = F.col("doc_id") % 6 + 1, F.col("doc_id") % 3 + 1, F.col("doc_id") % 8
    said = (
        F.when(shape == 0, F.format_string("as page %dth says", p)).when(shape == 1, F.format_string("on PAGE %d.", p)).when(shape == 2, F.format_string("pages %d or %d", p, p + 1))
        .when(shape == 3, F.format_string("see pages %d-%d, and %d", p, p + 1, p + 2)).when(shape == 4, F.format_string("homepage %d only", p)).when(shape == 5, F.format_string("page %d & %d", p, p))
        .when(shape == 6, F.concat(F.format_string("Page%d and %d", p, p + 1 + w), F.repeat(F.lit("!"), w.cast("int")))).otherwise(F.format_string("pages %d, %drd", p, p))
    )
    pages = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda x: F.struct(x.alias("page"), F.array(x + 20).alias("targets")))
    return table(spark, sf_dir, "documents").select("doc_id", citations.pages_rewritten_udf(said, pages).alias("said"))


@query("""
WITH r AS (SELECT doc_id, doc_id % 9 + 1 AS p, doc_id % 5 AS shape FROM documents)
SELECT doc_id, CASE shape WHEN 0 THEN printf('at Page %d <|box_start|>[10.0, 20.0, 30.0, 40.0]<|box_end|> and Page %d.</think>page %d', p + 1, p + 1, p)
  WHEN 1 THEN printf('Page %d <|begin_of_box|>[10.0, 20.0, 30.0, 40.0]<|end_of_box|> Page %d', p + 1, p + 1) WHEN 2 THEN printf('</think>page %d', p) END AS said, shape < 3 AS strict FROM r""")
def citation_rewriting(spark, sf_dir):
    p, shape = F.col("doc_id") % 9 + 1, F.col("doc_id") % 5
    box = "[5.0, 6.0, 7.0, 8.0]"
    said = (
        F.when(shape == 0, F.format_string(f"at page %d <|box_start|>{box}<|box_end|> and page %d.</think>page %d", p, p, p))
        .when(shape == 1, F.format_string(f"Page %d <|begin_of_box|> {box}<|end_of_box|> pages %d", p, p)).when(shape == 2, F.format_string("</think>page %d", p))
        .when(shape == 3, F.format_string(f"Page %d <|box_start|>{box}<|end_of_box|>", p)).otherwise(F.lit("alone <|box_end|>"))
    )
    numbers = F.sequence(F.lit(1), F.lit(9))
    pages = F.transform(numbers, lambda x: F.struct(x.alias("page"), F.array(x + 1).alias("targets")))
    place = lambda page, *xs: F.struct(page.alias("page"), F.array(*[F.lit(float(x)) for x in xs]).alias("bbox"))
    places = F.transform(numbers, lambda x: F.struct(place(x, 5, 6, 7, 8).alias("source"), F.array(place(x + 1, 10, 20, 30, 40)).alias("targets")))
    return table(spark, sf_dir, "documents").select("doc_id", citations.citations_rewritten_udf(said, pages, places, quiet=True).alias("said"), citations.strict_udf(F.regexp_replace(said, "(?s)</think>.*", "")).alias("strict"))


@query()
def majority_at_k(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.when(F.col("event_type") == "click", 1.0).otherwise(0.0).alias("score"))
    found = scoring.majority_at(rows, ["user_id"], "event_type", "score", 8)
    return found.select("user_id", F.round("maj_at_8_mean", 6).alias("maj_at_8_mean"), F.round("maj_at_8_std", 6).alias("maj_at_8_std"))


#: How the tails of retrieval prompts go on, by task; a number and words of the document follow.
TAILS = {
    "mk_niah_basic": "\nWhat is the special magic number for ", "mv_niah_basic": "\nWhat are all the special magic numbers for ", "mk_niah_easy": "\n\nPlease copy the Question 7 from the context. ",
    "mk_niah_medium": "\n\nHere are some examples to help you understand the task:\n\n", "mk_niah_hard": "\n\nHere are some examples to help you understand the task:\n\n",
    "mv_niah_easy": "\n\nPlease find and copy all the Question 12 from the context. ", "mv_niah_medium": "\n\nPlease first copy all the Question 3 from the context, ",
    "mv_niah_hard": "\n\nPlease copy the 3rd (1 indexed) Question 7 from the context. ", "qa_basic": "\n\nText: ", "qa_easy": "\n\nQuestion: ",
    "qa_medium": "\n\nPlease first find and copy paste the documents relevant to ", "qa_hard": "\n\nPlease answer the following question based on the documents. ", "qa_none": "\n\nNothing: ",
}
quoted = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query(f"""
WITH t AS (SELECT * FROM (VALUES {", ".join(f"({i}, {quoted(k)}, {quoted(prompts.RETRIEVAL[k][0]) if k in prompts.RETRIEVAL else 'NULL'}, {quoted(v)})" for i, (k, v) in enumerate(TAILS.items()))}) v(i, task, head, tail)),
r AS (SELECT doc_id, task, coalesce(text, '') AS hay, doc_id // 13 % 7 AS k, head, tail || left(coalesce(text, ''), 20) AS tail FROM documents JOIN t ON doc_id % 13 = i),
x AS (SELECT *, CASE WHEN k = 0 THEN 'no_tail' WHEN k = 1 THEN 'many_tails' WHEN head IS NULL OR k = 2 THEN 'other_header' WHEN k = 3 OR hay = '' THEN 'nothing_between' END AS problem FROM r)
SELECT doc_id, CASE WHEN head IS NULL THEN 'other_task' ELSE problem END AS problem, CASE WHEN problem IS NULL THEN md5(hay) END AS haystack,
  CASE WHEN problem IS NULL THEN length(head) END AS header, CASE WHEN problem IS NULL THEN tail END AS tail FROM x""")
def split_prompts(spark, sf_dir):
    """Prompts of all tasks around whole documents; some lack their tail, have it twice, begin otherwise, or have nothing between."""
    d, k = F.col("doc_id"), F.floor(F.col("doc_id") / 13) % 7
    task = F.element_at(F.array(*map(F.lit, TAILS)), (d % 13 + 1).cast("int"))
    hay = F.coalesce("text", F.lit(""))
    head = F.coalesce(prompts.by_task(task, {t: h for t, (h, _) in prompts.RETRIEVAL.items()}), F.lit(""))
    tail = F.concat(prompts.by_task(task, TAILS), F.substring(hay, 1, 20))
    said = F.concat(F.when(k == 2, F.concat(F.lit("> "), head)).otherwise(head), F.when(k == 3, "").otherwise(hay), F.when(k == 0, "").when(k == 1, F.concat(tail, tail)).otherwise(tail))
    parts = table(spark, sf_dir, "documents").select("doc_id", prompts.split_retrieval(task, said).alias("p"))
    return parts.select("doc_id", "p.problem", F.md5("p.haystack").alias("haystack"), F.length("p.header").cast("long").alias("header"), "p.tail")


@query("""
WITH r AS (SELECT user_id, event_id, CAST(event_id % 7 - 1 AS BIGINT) AS p, CAST(event_id % 5 - 1 AS BIGINT) AS q FROM events),
u AS (SELECT user_id, count(*) AS calls, count(*) FILTER (p >= 0 AND q >= 0) AS n, sum(p) FILTER (p >= 0 AND q >= 0) AS p, sum(q) FILTER (p >= 0 AND q >= 0) AS q FROM r GROUP BY user_id)
SELECT round(avg(calls), 6) AS tool_call_mean, CAST(max(calls) AS BIGINT) AS tool_call_max, CAST(min(calls) AS BIGINT) AS tool_call_min, round((sum(p) + sum(q)) / sum(n), 6) AS sample_length_mean,
  round(sum(p) / sum(n), 6) AS prompt_length_mean, round(sum(q) / sum(n), 6) AS response_length_mean, round(avg(n), 6) AS turns_mean FROM u""")
def agent_turn_metrics(spark, sf_dir):
    e = F.col("event_id")
    lengths = [F.collect_list((e % n - 1).cast("long")).alias(c) for n, c in ((7, "agent_prompt_lengths"), (5, "agent_response_lengths"))]
    found = measures.agent_turns(table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("tool_cnt"), *lengths))
    return found.select(*[F.round(c, 6).alias(c) if c.endswith("mean") else F.col(c) for c in found.columns])


@query("""
WITH r AS (SELECT doc_id, 6 + doc_id % 4 AS n, 2 + doc_id % 3 AS k FROM documents),
x AS (SELECT doc_id, n, k, unnest(range(CAST(n AS BIGINT))) AS i FROM r), m AS (SELECT *, ((doc_id + i) % 5 > 0)::INT AS att, ((doc_id * 3 + i) % 4 > 0)::INT AS act FROM x)
SELECT doc_id, CAST(coalesce(sum(att) FILTER (i < n - k), 0) AS BIGINT) AS prompt_length, CAST(coalesce(sum(att * act) FILTER (i >= n - k), 0) AS BIGINT) AS response_length,
  CAST(coalesce(sum(att * (1 - act)) FILTER (i >= n - k), 0) AS BIGINT) AS obs_length FROM m GROUP BY doc_id""")
def response_lengths(spark, sf_dir):
    d = F.col("doc_id")
    places = F.sequence(F.lit(0).cast("long"), 5 + d % 4)
    attention, action = F.transform(places, lambda i: ((d + i) % 5 > 0).cast("int")), F.transform(places, lambda i: ((d * 3 + i) % 4 > 0).cast("int"))
    info = measures.response_info(attention, (2 + d % 3).cast("int"), action)
    return table(spark, sf_dir, "documents").select("doc_id", info.alias("x")).select("doc_id", "x.prompt_length", "x.response_length", "x.obs_length")


@query("SELECT round((6.0 * (((512 * 1408 * 3 + 512 * (2 * 64 * 8 + 2 * 64 * 2)) * 12 + 2 * 32000 * 512)) * sum(n_chars) + 12.0 * 64 * 8 * 12 * sum(n_chars * n_chars)) / 2.5 / 1e12, 6) AS tflops FROM documents")
def dense_flops(spark, sf_dir):
    found = measures.dense_flops(table(spark, sf_dir, "documents").select(F.col("n_chars").alias("length")), 512, 32_000, 12, 2, 8, 1408, 2.5)
    return found.select(F.round("tflops", 6).alias("tflops"))


@query("""
WITH e AS (SELECT unnest(range(3)) AS epoch) SELECT CAST(epoch AS INT) AS epoch, item_id, CAST(item_id // 5 AS BIGINT) AS step, CAST(item_id % 5 AS BIGINT) AS slot FROM benchmark, e""")
def minibatch_epochs(spark, sf_dir):
    return batches.minibatches(table(spark, sf_dir, "benchmark").select("item_id"), "item_id", 5, 3).select("epoch", "item_id", F.col("step").cast("long").alias("step"), F.col("slot").cast("long").alias("slot"))


@query("""
WITH n AS (SELECT count(*) // 8 * 8 AS n FROM documents), d AS (SELECT doc_id, e.epoch FROM documents, n, (VALUES (0), (1)) e(epoch) WHERE doc_id < n),
r AS (SELECT doc_id, epoch, row_number() OVER (PARTITION BY epoch ORDER BY md5('17:' || epoch || ':' || doc_id), doc_id) - 1 AS pos FROM d)
SELECT CAST(epoch AS INTEGER) AS epoch, doc_id, pos // 8 AS step, pos % 8 AS slot FROM r""")
def shuffled_minibatches(spark, sf_dir):
    """Documents in batches of eight, shuffled anew in each of two epochs; the last, shorter batch isn't made."""
    rows = table(spark, sf_dir, "documents").select("doc_id")
    total = rows.count() // 8 * 8
    found = batches.minibatches(rows.where(F.col("doc_id") < total), "doc_id", 8, 2, total, seed=17)
    return found.select("epoch", "doc_id", F.col("step").cast("long").alias("step"), F.col("slot").cast("long").alias("slot"))


@query("""
WITH r AS (SELECT doc_id, doc_id % 7 AS shape FROM documents)
SELECT doc_id, round(CASE shape WHEN 0 THEN 2.0 - 1 WHEN 1 THEN 2.0 + 1 WHEN 2 THEN 0.0 - 1 - 1 WHEN 3 THEN 2.0 - 1 - 1 WHEN 4 THEN 2 * 0.666667 - 1 WHEN 5 THEN 2.0 + 1 - 1 ELSE 0.0 - 1 END, 4) AS reward FROM r""")
def retrieval_rewards(spark, sf_dir):
    shape = F.col("doc_id") % 7
    found = "<|begin_of_query|>q<|end_of_query|><|begin_of_documents|>\n(1) x<|end_of_documents|>\n"
    answer = "</think><answer>{}</answer>"
    shapes = ["so" + answer.format("red"), found + answer.format("Red"), "no tags", "assistant: " + answer.format("red"), "x" + answer.format("red fox"), found.replace("q<|end_of_query|>", "q") + answer.format("red"), "x" + answer.format("blue")]
    said = F.coalesce(*[F.when(shape == k, F.lit(x)) for k, x in enumerate(shapes)])
    return table(spark, sf_dir, "documents").select("doc_id", F.round(rewards.retrieval_reward(said, F.lit("the red")), 4).alias("reward"))


@query("""
WITH r AS (SELECT doc_id, 4 + doc_id % 5 AS n, 1 + doc_id % 4 AS p, 1 + doc_id % 3 AS q FROM documents), x AS (SELECT *, unnest(range(CAST(n AS BIGINT))) AS i FROM r)
SELECT doc_id, string_agg(CASE WHEN i = least(p + q, n) - 1 OR (p > 1 AND i < least(p, n) - 1) THEN 0 ELSE 1 END, '' ORDER BY i) AS loss_mask,
  string_agg(CASE WHEN i IN (0, 2) THEN -100 ELSE i + 5 END, ' ' ORDER BY i) AS labels FROM x GROUP BY doc_id""")
def supervised_masks(spark, sf_dir):
    d = F.col("doc_id")
    places = F.transform(F.sequence(F.lit(0).cast("long"), 3 + d % 5), lambda i: i.cast("int"))
    mask = messages.supervised_mask(F.transform(places, lambda i: F.lit(1)), (1 + d % 4).cast("int"), (1 + d % 3).cast("int"))
    labels = messages.packed_labels(F.transform(places, lambda i: i + 5), F.array(F.lit(0), F.lit(2)))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(mask, "").alias("loss_mask"), F.array_join(labels, " ").alias("labels"))
