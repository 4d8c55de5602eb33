"""Queries of manifests and messages: fan-out, prompts, contracts, lookups, masks and batch metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellum.functions import geometry, messages, text
from vellum.operators import rollup, tables
from vellum.session import table
from vellum.sources import manifests, sinks

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def r6(c, name):
    return F.round(c, 6).alias(name)


def held_turns(spark, sf_dir):
    own = F.struct("turn", "role", F.col("text").alias("content"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(own)).alias("x"))


@query("""
SELECT doc_id, dpi, doc_id || '_dpi' || dpi AS id, CAST(ceil(n_chars / (dpi * 20.0)) AS BIGINT) AS pages FROM documents, (SELECT unnest([72, 80, 96, 112, 120, 128, 144]) AS dpi)""")
def dpi_fan_out(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("dpi", F.explode(F.array(*[F.lit(d) for d in (72, 80, 96, 112, 120, 128, 144)])))
    return rows.select("doc_id", "dpi", F.concat(F.col("doc_id").cast("string"), F.lit("_dpi"), F.col("dpi").cast("string")).alias("id"), F.ceil(F.col("n_chars") / (F.col("dpi") * 20.0)).alias("pages"))


@query("""
SELECT conv_id, count(*) >= 1 AND count(*) FILTER (role = 'user') = 2 AND count(*) FILTER (role = 'assistant' AND trim(text) <> '') > 0 AS ok FROM conversations GROUP BY conv_id""")
def conversation_contract(spark, sf_dir):
    tagged = F.transform("x", lambda m: F.struct(m["role"].alias("role"), F.when(m["role"] == "user", F.concat(F.lit("<image>"), m["content"])).otherwise(m["content"]).alias("content")))
    return held_turns(spark, sf_dir).select("conv_id", messages.tags_match(tagged, F.lit(2)).alias("ok"))


@query("""
WITH c AS (SELECT conv_id, turn, role, text, max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS last FROM conversations)
SELECT conv_id, md5(string_agg(upper(role[1]) || substr(role, 2) || ': ' || text, chr(10) || chr(10) ORDER BY turn)) AS history FROM c WHERE last IS NULL OR turn <> last GROUP BY conv_id""")
def history_serialised(spark, sf_dir):
    last = F.array_max(F.transform("x", lambda m, i: F.when(m["role"] == "user", i)))
    kept = F.filter("x", lambda m, i: last.isNull() | (i != last))
    said = F.transform(kept, lambda m: F.concat(F.initcap(m["role"]), F.lit(": "), m["content"]))
    return held_turns(spark, sf_dir).where(F.size(kept) > 0).select("conv_id", F.md5(F.array_join(said, "\n\n")).alias("history"))


@query("""
SELECT doc_id, n_chars % 4 + 1 AS pages, CAST(2 * (n_chars % 4 + 1) + 1 AS INT) AS parts FROM documents""")
def interleaved_prompt(spark, sf_dir):
    n = (F.col("n_chars") % 4 + 1).cast("int")
    pages = F.transform(F.sequence(F.lit(1), n), lambda p: F.concat(F.lit("Page "), p.cast("string"), F.lit("\n<image>")))
    content = F.concat(F.array_join(pages, "\n"), F.lit("\nwhat?"))
    images = F.transform(F.sequence(F.lit(1), n), lambda p: F.concat(p.cast("string"), F.lit(".png")))
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 4 + 1).alias("pages"), F.size(messages.interleaved(content, images)).alias("parts"))


@query("""
SELECT doc_id, 'root/dpi_144/' || source || '/dpi_72/' || doc_id || '.png' AS path FROM documents""")
def dpi_path_swap(spark, sf_dir):
    path = F.concat(F.lit("root/dpi_72/"), F.col("source"), F.lit("/dpi_72/"), F.col("doc_id").cast("string"), F.lit(".png"))
    return table(spark, sf_dir, "documents").select("doc_id", manifests.swapped_dpi(path, 144).alias("path"))


@query("""
SELECT source, list_transform(list_sort(list(struct_pack(k := doc_id, v := n_chars))), lambda s: s.v) AS responses FROM documents WHERE doc_id < 200 GROUP BY source""".replace(" WHERE doc_id < 200", ""))
def transposed_responses(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("sample"), F.col("n_chars").alias("response"))
    return sinks.transposed_samples(rows, "source")


@query("""
WITH t AS (SELECT l_orderkey % 200 AS page, l_linenumber AS ordinal, min(l_partkey) AS target FROM lineitem GROUP BY ALL)
SELECT o_orderkey, list_transform(list_sort(list(struct_pack(o := ordinal, t := target))), lambda s: s.t) AS targets
FROM orders JOIN t ON o_orderkey % 200 = page GROUP BY o_orderkey""")
def location_targets(spark, sf_dir):
    targets = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 200).alias("page"), F.col("l_linenumber").alias("ordinal")).agg(F.min("l_partkey").alias("target"))
    wanted = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 200).alias("page"))
    known = wanted.join(targets.select("page").distinct(), "page", "left_semi")
    return tables.location_lookup(known, targets, ["page"]).select("o_orderkey", "targets")


@query("""
WITH i AS (SELECT doc_id, doc_id % 4 + 1 AS k FROM documents)
SELECT doc_id, CAST(2 + k + 2 AS INT) AS n, '1 ' || array_to_string(list_transform(range(0, k), lambda x: 9), ' ') || ' 2 9 9' AS ids FROM i""")
def media_expansion(spark, sf_dir):
    k = F.col("doc_id") % 4 + 1
    ids = messages.expanded_media(F.array(*[F.lit(x) for x in (1, 9, 2, 9)]), 9, F.array(k, F.lit(2).cast("long")))
    return table(spark, sf_dir, "documents").select("doc_id", ids.alias("i")).select("doc_id", F.size("i").alias("n"), F.array_join("i", " ").alias("ids"))


@query("""
SELECT doc_id, CAST((n_chars % 30) * 200 + (n_chars % 30) * 8 + floor(n_chars / 3) + 256 AS BIGINT) AS tokens,
  CASE WHEN (n_chars % 30) > 20 THEN printf('%d pages', n_chars % 30) END AS skipped FROM documents""")
def context_budget(spark, sf_dir):
    pages = F.col("n_chars") % 30
    tokens = geometry.prompt_tokens(pages * 200, pages, F.col("n_chars"))
    return table(spark, sf_dir, "documents").select("doc_id", tokens.cast("long").alias("tokens"), F.when(pages > 20, F.format_string("%d pages", pages)).alias("skipped"))


@query("""
WITH u AS (SELECT user_id, avg(value) AS m, max(value) AS hi, min(value) AS lo, count(*) AS n, sum((event_type = 'error')::INT) AS obs FROM events GROUP BY user_id)
SELECT round(avg(m), 6) AS reward_mean, round(max(m), 6) AS reward_max, round(min(m), 6) AS reward_min, round(avg(n), 6) AS length_mean, CAST(max(n) AS BIGINT) AS length_max,
  round(avg((n >= 70)::INT), 6) AS clip_ratio, round(avg(obs), 6) AS observed_mean FROM u""")
def batch_metrics(spark, sf_dir):
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("m"), F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("obs"))
    return per.agg(
        r6(F.avg("m"), "reward_mean"), r6(F.max("m"), "reward_max"), r6(F.min("m"), "reward_min"), r6(F.avg("n"), "length_mean"), F.max("n").alias("length_max"),
        r6(F.avg((F.col("n") >= 70).cast("int")), "clip_ratio"), r6(F.avg("obs"), "observed_mean"),
    )


@query("""
WITH x AS (SELECT value AS ret, value * 0.5 + event_id % 7 AS v FROM events)
SELECT round(1 - var_samp(ret - v) / (var_samp(ret) + 1e-5), 6) AS explained FROM x""")
def explained_variance(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("value").alias("ret"), (F.col("value") * 0.5 + F.col("event_id") % 7).alias("v"))
    return rows.agg(r6(1 - F.var_samp(F.col("ret") - F.col("v")) / (F.var_samp("ret") + 1e-5), "explained"))


@query("""
SELECT event_id, CAST(CASE WHEN event_id % 4 IN (0, 1) THEN 1 ELSE 0 END AS DOUBLE) AS reward FROM events""")
def format_rewards(spark, sf_dir):
    e = F.col("event_id") % 4
    said = F.concat(F.lit("think</think>"), F.when(e == 2, "").otherwise("<answer>4</answer>"), F.when(e == 3, " more").when(e == 1, " \n").otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", text.format_reward(said).alias("reward"))


@query("""
SELECT lang, count(*) FILTER (doc_id % 3 > 0 AND doc_id * 7 % 1100 + doc_id % 3 * 40 <= 1000) AS valid, count(*) AS n FROM documents GROUP BY lang""")
def box_validity(spark, sf_dir):
    d = F.col("doc_id")
    x = (d * 7 % 1100).cast("double")
    box = F.array(x, F.lit(0.0), x + d % 3 * 40, F.lit(50.0))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(geometry.valid_box(box)).alias("valid"), F.count("*").alias("n"))


@query("""
SELECT doc_id, contains_cjk, blocks FROM (SELECT doc_id, regexp_matches(text, '[　-鿿]') AS contains_cjk, CAST(ceil((length(text) - length(replace(text, chr(10), '')) + 1) / 4.0) AS INT) AS blocks FROM documents)""")
def layout_blocks(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", text.contains_cjk(F.col("text")).alias("contains_cjk"), F.size(text.line_blocks(F.col("text"), 4)).alias("blocks"))


@query("""
WITH t AS (SELECT conv_id, turn, length(text) AS n, role = 'assistant' AS speaks, sum(length(text)) OVER w AS used, count(*) FILTER (role = 'user') OVER w AS asked
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT *, CASE WHEN used > 900 THEN 'token_budget' WHEN asked > 2 THEN 'turn_limit' END AS why FROM t),
f AS (SELECT conv_id, min(turn) FILTER (why IS NOT NULL) AS stop FROM s GROUP BY conv_id)
SELECT s.conv_id, CAST(count(*) FILTER (stop IS NULL OR turn < stop) AS BIGINT) AS turns, CAST(coalesce(sum(n) FILTER (stop IS NULL OR turn < stop), 0) AS BIGINT) AS tokens,
  greatest(CAST(900 - coalesce(sum(n) FILTER (stop IS NULL OR turn < stop), 0) AS BIGINT), 0) AS remaining, coalesce(max(why) FILTER (turn = stop), 'done') AS status
FROM s JOIN f ON s.conv_id = f.conv_id GROUP BY s.conv_id""")
def trajectory_budget(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"), F.sum(F.length("text")).over(w).alias("used"), F.count_if(F.col("role") == "user").over(w).alias("asked"))
    rows = rows.withColumn("why", F.when(F.col("used") > 900, "token_budget").when(F.col("asked") > 2, "turn_limit"))
    rows = rows.withColumn("before", F.coalesce(F.count("why").over(w), F.lit(0)) == 0)
    stop = F.min_by(F.when(~F.col("before"), F.col("why")), F.when(~F.col("before"), F.col("turn")))
    tokens = F.coalesce(F.sum(F.when(F.col("before"), F.col("n"))), F.lit(0))
    return rows.groupBy("conv_id").agg(F.count_if("before").alias("turns"), tokens.alias("tokens"), F.greatest(900 - tokens, F.lit(0).cast("long")).alias("remaining"), F.coalesce(stop, F.lit("done")).alias("status"))
