"""Queries of summaries by dataset, resolution, sample and step, of settings and prompts, and of rewards with all their parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import messages, positions
from vellum.operators import measures, rewards, rollup, scoring, summaries
from vellum.plans.coverage import scratch
from vellum.session import table
from vellum.sources import sinks

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


#: Clicks as records of datasets: the kind picks a dataset, the value its score, and the properties the counts.
NAMES = {"view": "qasper", "click": "lsht", "error": "trec", "purchase": "gov_report", "signup": "vcsum"}
RECORDS = """r AS (SELECT click_id, CASE kind WHEN 'view' THEN 'qasper' WHEN 'click' THEN 'lsht' WHEN 'error' THEN 'trec' WHEN 'purchase' THEN 'gov_report' WHEN 'signup' THEN 'vcsum' END AS dataset, coalesce(value, 0) / 250 AS score,
  CASE WHEN props IS NULL THEN 'no properties' WHEN client_id IS NULL THEN '' END AS error, CASE WHEN length(props) % 3 > 0 THEN length(props) % 90 END AS initial_prompt_tokens,
  CASE WHEN client_id % 4 > 0 THEN client_id * 3 % 700 END AS prompt_tokens, CASE WHEN length(props) > 60 THEN length(props) // 25 END AS num_pages, CASE WHEN value > 60 THEN 'length' ELSE 'stop' END AS finish_reason FROM clicks)"""


def records(spark, sf_dir):
    n, c = F.length("props").cast("long"), F.col("client_id")
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    return table(spark, sf_dir, "clicks").select(
        "click_id", F.try_element_at(names, F.col("kind")).alias("dataset"), (F.coalesce("value", F.lit(0.0)) / 250).alias("score"), F.when(n.isNull(), "no properties").when(c.isNull(), "").alias("error"),
        F.when(n % 3 > 0, n % 90).alias("initial_prompt_tokens"), F.when(c % 4 > 0, c * 3 % 700).alias("prompt_tokens"), F.when(n > 60, F.floor(n / 25)).alias("num_pages"),
        F.when(F.col("value") > 60, "length").otherwise("stop").alias("finish_reason"),
    )


@query(f"""
WITH {RECORDS}, x AS (SELECT *, CASE WHEN initial_prompt_tokens IS NULL THEN nullif(prompt_tokens, 0) ELSE nullif(initial_prompt_tokens, 0) END AS p, CASE WHEN coalesce(initial_prompt_tokens, 0) <> 0 THEN nullif(prompt_tokens, 0) END AS b FROM r)
SELECT dataset, round_even(100 * avg(score), 2) AS score, count(*) AS n, count(*) FILTER (coalesce(error, '') <> '') AS errors, count(*) FILTER (finish_reason = 'length') AS truncated,
  CAST(round_even(avg(p), 0) AS BIGINT) AS mean_prompt_tokens, max(p) AS max_prompt_tokens, CAST(round_even(avg(b), 0) AS BIGINT) AS mean_cumulative_prompt_tokens, max(b) AS max_cumulative_prompt_tokens,
  round_even(avg(coalesce(num_pages, 0)), 1) AS mean_pages, max(coalesce(num_pages, 0)) AS max_pages FROM x WHERE dataset IS NULL OR dataset NOT IN ('multifieldqa_zh', 'dureader', 'vcsum', 'lsht', 'passage_retrieval_zh') GROUP BY dataset""")
def dataset_statistics(spark, sf_dir):
    """Statistics of datasets that take part, with means and maxima of first-turn and cumulative tokens."""
    return summaries.dataset_stats(summaries.taking_part(records(spark, sf_dir), "dataset"), ["dataset"])


@query(f"""
WITH {RECORDS}, s AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{m}', {n}, {str(f).lower()})" for k, (m, n, f) in summaries.SETTINGS.items())}) v(dataset, metric, most_tokens, first_line))
SELECT metric, first_line, count(*) AS n, CAST(sum(most_tokens) AS BIGINT) AS most_tokens FROM r LEFT JOIN s USING (dataset) GROUP BY ALL""")
def dataset_settings(spark, sf_dir):
    """Records with the metric and the budget of their dataset; those without a dataset have neither."""
    found = summaries.with_settings(records(spark, sf_dir), "dataset", strict=False)
    return found.groupBy("metric", "first_line").agg(F.count("*").alias("n"), F.sum(F.col("most_tokens").cast("long")).alias("most_tokens"))


@query("""
SELECT priority AS dpi, count(*) AS n, round_even(avg(CASE WHEN status <> 'held' THEN client_id % 40 END), 1) AS mean_pages, round_even(avg(total), 1) AS mean_tokens FROM sales GROUP BY priority""")
def resolution_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "sales").select(F.col("priority").alias("dpi"), F.when(F.col("status") != "held", F.col("client_id") % 40).alias("pages"), F.col("total").alias("tokens"))
    return summaries.by_resolution(rows)


@query("""
SELECT sale_id, count(*) AS turns, CAST(coalesce(sum(quantity), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(CASE WHEN flag <> 'kept' THEN line_no END), 0) AS BIGINT) AS completion_tokens,
  CAST(coalesce(sum(item_id), 0) AS BIGINT) AS total_tokens FROM sale_lines GROUP BY sale_id""")
def usage_by_sample(spark, sf_dir):
    """The lines of a sale as the turns of a sample: what they used in sum, with counts that turns don't report."""
    rows = table(spark, sf_dir, "sale_lines").select("sale_id", F.col("quantity").alias("prompt_tokens"), F.when(F.col("flag") != "kept", F.col("line_no")).alias("completion_tokens"), F.col("item_id").alias("total_tokens"))
    return summaries.usage(rows, ["sale_id"])


@query("SELECT source, op, segment, count(*) AS n FROM client_changes GROUP BY ALL")
def distinct_changes(spark, sf_dir):
    return summaries.distinct_values(table(spark, sf_dir, "client_changes"), ["source", "op", "segment"])


@query("""
WITH b AS (SELECT date_trunc('week', sold_at) AS week, priority AS rank, status, coalesce(total, 0) AS total FROM sales WHERE sold_at IS NOT NULL AND priority IS NOT NULL),
q AS (SELECT week, rank, status, CAST(round_even(sum(total), 0) AS BIGINT) AS t FROM b GROUP BY ALL),
m AS (SELECT week, rank, count(*) AS samples, round(avg(total), 6) AS loss, CAST(floor(min(total)) AS BIGINT) AS least, CAST(ceil(max(total)) AS BIGINT) AS most FROM b GROUP BY ALL),
t AS (SELECT week, rank, list(t ORDER BY status) AS tokens FROM q GROUP BY ALL),
r AS (SELECT CAST(epoch(week) AS BIGINT) // 604800 AS step, rank, tokens, samples, loss, least, most, list_sum(tokens) * 6e3 AS flops, 1.0 + samples % 7 AS seconds FROM m JOIN t USING (week, rank)),
s AS (SELECT step, avg(loss) AS loss, sum(flops / 2 / 1e6) / count(*) AS mfu, sum(list_sum(tokens) / len(tokens)) / count(*) AS seq_len_avg, min(list_min(tokens)) AS seq_len_min, max(list_max(tokens)) AS seq_len_max, min(least) AS micro_seq_len_min,
  max(most) AS micro_seq_len_max, sum(list_sum(tokens) / 2) / sum(samples) AS micro_seq_len_avg, sum(list_sum(tokens) / 2) AS l, sum(samples) AS n, max(seconds) AS d, count(*) AS ranks FROM r GROUP BY step)
SELECT step, round(loss, 6) AS loss, round_even(mfu, 2) AS mfu, round(seq_len_avg, 6) AS seq_len_avg, seq_len_min, seq_len_max, micro_seq_len_min, micro_seq_len_max, round(micro_seq_len_avg, 6) AS micro_seq_len_avg, CAST(round_even(d, 2) AS DOUBLE) AS delta_time,
  sum(l) OVER w AS total_tokens, CAST(sum(n) OVER w AS BIGINT) AS total_samples, CAST(round_even(l / d, 0) AS BIGINT) AS tokens_per_second, CAST(round_even(l / d / 2 / ranks, 0) AS BIGINT) AS tokens_per_device FROM s WINDOW w AS (ORDER BY step)""")
def training_steps(spark, sf_dir):
    """Weeks of sales as steps of a training, priorities as ranks and statuses as batches."""
    b = table(spark, sf_dir, "sales").where("sold_at IS NOT NULL AND priority IS NOT NULL").select(F.date_trunc("week", "sold_at").alias("week"), F.col("priority").alias("rank"), "status", F.coalesce("total", F.lit(0.0)).alias("total"))
    q = b.groupBy("week", "rank", "status").agg(F.bround(F.sum("total"), 0).cast("long").alias("t"))
    t = q.groupBy("week", "rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("status", "t"))), lambda x: x["t"]).alias("tokens"))
    m = b.groupBy("week", "rank").agg(F.count("*").alias("samples"), F.round(F.avg("total"), 6).alias("loss"), F.floor(F.min("total")).alias("least"), F.ceil(F.max("total")).alias("most"))
    total = F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    rows = m.join(t, ["week", "rank"]).select(F.floor(F.unix_timestamp("week") / 604800).alias("step"), "tokens", "samples", "loss", "least", "most", (total * F.lit(6e3)).alias("flops"), (1.0 + F.col("samples") % 7).alias("seconds"))
    found = summaries.step_metrics(rows, peak=1e6, split=2)
    return found.select(*[F.round(c, 6).alias(c) if c in ("loss", "seq_len_avg", "micro_seq_len_avg") else c for c in found.columns])


@query("""
WITH p AS (SELECT conv_id, turn, role, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) AS said FROM conversations),
f AS (SELECT conv_id, min(turn) FILTER (role = 'system') AS first FROM p GROUP BY conv_id),
k AS (SELECT conv_id, turn, role, said FROM p JOIN f USING (conv_id) WHERE role <> 'system' OR turn = first
  UNION ALL SELECT conv_id, -1, 'system', 'You are a helpful assistant' FROM f WHERE first IS NULL UNION ALL SELECT conv_id, 1000000, 'assistant', '<think>' || chr(10) FROM f)
SELECT conv_id, string_agg(role, ' ' ORDER BY turn) AS roles, count(*) FILTER (said <> '') AS texts, md5(string_agg(said, '|' ORDER BY turn) FILTER (said <> '')) AS digest FROM k GROUP BY conv_id""")
def thinking_prompts(spark, sf_dir):
    """Conversations in the shape that a thinking model was trained on."""
    none = F.lit(None).cast("string")
    parts = lambda t: F.array(F.struct(F.lit("text").alias("type"), F.coalesce(t["text"], F.lit("")).alias("text"), none.alias("url")))
    held = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    rows = held.select("conv_id", summaries.thinking(F.transform("t", lambda t: F.struct(t["role"].alias("role"), parts(t).alias("content")))).alias("m"))
    said = F.flatten(F.transform("m", lambda m: F.transform(m["content"], lambda p: p["text"])))
    return rows.select("conv_id", F.array_join(F.transform("m", lambda m: m["role"]), " ").alias("roles"), F.size(said).cast("long").alias("texts"), F.md5(F.array_join(said, "|")).alias("digest"))


@query("""
WITH b AS (SELECT sale_id, count(*) AS calls, bool_or(quantity = 7) AS broken FROM sale_lines GROUP BY sale_id),
c AS (SELECT sale_id, CASE WHEN line_no % 4 = 0 THEN NULL ELSE 1 + item_id % 3 END AS page, vendor_id % 30 * 10 AS x, quantity * 8 AS y, 100 + line_no * 40 AS w, line_no FROM sale_lines),
s AS (SELECT sale_id, status, priority, client_id, 1 + client_id % 3 AS page, client_id % 40 * 10 AS ex, priority * 60 AS ey, CASE WHEN client_id % 2 = 0 THEN 72.0 WHEN client_id % 5 > 0 THEN 96.0 END AS dpi FROM sales WHERE client_id IS NOT NULL AND priority IS NOT NULL),
e AS (SELECT *, least(greatest(ex + 50 - least(120.0, 1000) / 2, 0), 1000 - 120.0) AS a, least(greatest(ey + 75 - least(180.0, 1000) / 2, 0), 1000 - 180.0) AS b FROM s),
j AS (SELECT e.sale_id, coalesce(c.page IS NOT NULL AND x + w <= 1000 AND y + w <= 1000, false) AS ok, CASE WHEN c.page = e.page THEN greatest(0, least(x + w, a + 120) - greatest(x, a)) * greatest(0, least(y + w, b + 180) - greatest(y, b)) ELSE 0 END AS i, w FROM e JOIN c USING (sale_id)),
q AS (SELECT sale_id, count(*) AS n, count(*) FILTER (NOT ok) AS bad, max(CASE WHEN ok THEN i / (w * w + 120 * 180 - i) END) AS best, max(CASE WHEN ok THEN i / (w * w + 120 * 180 - i) * least(1, 2 * (1 - w * w / 1e6)) END) AS quality FROM j GROUP BY sale_id),
f AS (SELECT e.*, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad, coalesce(best, 0) AS best, coalesce(quality, 0) AS quality, CASE status WHEN 'done' THEN 2 WHEN 'open' THEN 1 ELSE 0 END AS m, status IS NOT NULL AS said, client_id % 7 > 0 AS opened FROM e LEFT JOIN q USING (sale_id)),
g AS (SELECT *, m / 2.0 AS acc, (m = 2)::DOUBLE AS correct, pow(greatest(0, least(1, (144 - coalesce(dpi, 72)) / 72)), 2) AS factor, CASE WHEN n > 0 THEN quality / least(n, 1) ELSE 0 END AS iou, CASE WHEN n > 0 THEN least(1, 1.0 / n) ELSE 0 END AS eff, (said AND opened)::DOUBLE AS shape FROM f),
h AS (SELECT *, CASE WHEN shape > 0 AND n <= 1 AND bad = 0 THEN 1.0 ELSE 0 END AS form, correct * factor * iou * eff AS tool FROM g)
SELECT sale_id, round(0.8 * acc + 0.2 * form + 0.2 * tool, 6) AS score, round(acc, 6) AS acc_reward, CAST(m AS INTEGER) AS answer_matches, CAST(CASE WHEN m > 0 THEN 0 WHEN status = 'held' THEN 0.5 ELSE 0 END AS DOUBLE) AS answer_partial, correct AS answer_correct,
  said::DOUBLE AS final_answer_present, CAST(form AS DOUBLE) AS format_reward, shape AS structural_format_reward, (n > bad)::DOUBLE AS actual_tool_called, CAST(coalesce(dpi, 72) AS DOUBLE) AS dpi, round(factor, 6) AS dpi_factor, round(tool, 6) AS tool_reward,
  CAST((quality > 0) AS INTEGER) AS matched_evidence, round(iou, 6) AS iou_reward, round(eff, 6) AS call_efficiency, round(greatest(0, n - 1) / greatest(1.0, n), 6) AS excess_call_ratio, round(best, 6) AS best_iou,
  CAST(n AS INTEGER) AS tool_calls, CAST(n - bad AS INTEGER) AS valid_tool_calls, CAST(bad AS INTEGER) AS invalid_tool_calls FROM h""")
def document_reward_parts(spark, sf_dir):
    """Sales as answers about documents: the lines are calls of the zoom tool, the client's place is the evidence, and the
    status says which golds the answer holds; with all parts of the reward."""
    lines = table(spark, sf_dir, "sale_lines")
    page = F.when(F.col("line_no") % 4 == 0, F.lit("null")).otherwise((1 + F.col("item_id") % 3).cast("string"))
    x, y, w = F.col("vendor_id") % 30 * 10, F.col("quantity") * 8, 100 + F.col("line_no") * 40
    numbers = F.concat_ws(", ", *[c.cast("int").cast("string") for c in (x, y, x + w, y + w)])
    body = F.concat(F.lit('<tool_call>{"name": "zoom_region", "arguments": {"page": '), F.coalesce(page, F.lit("null")), F.lit(', "bbox_2d": ['), numbers, F.lit("]}}</tool_call>"))
    calls = lines.select("sale_id", "line_no", body.alias("body")).groupBy("sale_id").agg(F.array_join(F.sort_array(F.collect_list("body")), " ").alias("calls"))
    # few bytes, but much work: Spark may not put these parts together
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = table(spark, sf_dir, "sales").where("client_id IS NOT NULL AND priority IS NOT NULL").repartition(parts, "sale_id").join(calls, "sale_id", "left")
    c = F.col("client_id")
    answer = F.when(F.col("status") == "done", "alpha one and beta two").when(F.col("status") == "open", "alpha one").when(F.col("status") == "held", "two").otherwise("")
    said = F.concat(F.lit("look "), F.coalesce("calls", F.lit("")), F.lit("</think><answer>"), answer, F.lit("</answer>"))
    ex, ey = (c % 40 * 10).cast("double"), (F.col("priority") * 60).cast("double")
    evidence = F.array(F.struct((1 + c % 3).cast("int").alias("page"), F.array(ex, ey, ex + 100, ey + 150).alias("box")))
    dpi = F.when(c % 2 == 0, 72.0).when(c % 5 > 0, 96.0)
    rows = s.select("sale_id", said.alias("solution"), F.array(F.lit("alpha one"), F.lit("beta two")).alias("golds"), evidence.alias("evidence"), F.lit(None).cast("int").alias("num_pages"), dpi.alias("dpi"), F.when(c % 7 > 0, "<|im_start|>assistant\n<think>\n").otherwise("<think> is a tag").alias("prompt"))
    found = rewards.with_parts(rewards.document_reward(rows))
    exact = ("answer_matches", "matched_evidence", "tool_calls", "valid_tool_calls", "invalid_tool_calls")
    return found.select("sale_id", *[c if c in exact else F.round(c, 6).alias(c) for c in rewards.PARTS])


@query("""
WITH l AS (SELECT sale_id, line_no, coalesce(amount, 0) AS amount, coalesce(discount, 0) AS discount, quantity, flag IS NOT DISTINCT FROM 'kept' AS kept FROM sale_lines WHERE sale_id IS NOT NULL),
s AS (SELECT sale_id, sum(amount) / 1000 AS score, sum(amount * (1 - discount)) / 1000 AS reward, CAST(coalesce(sum(quantity) FILTER (kept), 0) AS BIGINT) AS response_length, CAST(coalesce(sum(quantity) FILTER (NOT kept), 0) AS BIGINT) AS obs_length, count(*) AS prompt_length FROM l GROUP BY sale_id),
t AS (SELECT amount / 100 AS advantage, amount * discount AS r, discount * 100 AS v FROM l WHERE kept),
m AS (SELECT * FROM (UNPIVOT (SELECT avg(score) AS "critic/score/mean", max(score) AS "critic/score/max", min(score) AS "critic/score/min", avg(reward) AS "critic/rewards/mean", max(reward) AS "critic/rewards/max", min(reward) AS "critic/rewards/min",
    avg(response_length) AS "response_length/mean", max(response_length)::DOUBLE AS "response_length/max", min(response_length)::DOUBLE AS "response_length/min", avg((response_length = 40)::INT) AS "response_length/clip_ratio",
    avg(obs_length) AS "obs_length/mean", max(obs_length)::DOUBLE AS "obs_length/max", min(obs_length)::DOUBLE AS "obs_length/min", avg(prompt_length) AS "prompt_length/mean", max(prompt_length)::DOUBLE AS "prompt_length/max", min(prompt_length)::DOUBLE AS "prompt_length/min",
    avg((prompt_length = 7)::INT) AS "prompt_length/clip_ratio", avg(prompt_length + response_length + obs_length) AS "actor/sample_length/mean", avg(prompt_length) AS "actor/prompt_length/mean", avg(response_length) AS "actor/response_length/mean", avg(obs_length) AS "actor/observation_length/mean" FROM s)
  ON COLUMNS(*) INTO NAME metric VALUE value)
  UNION ALL SELECT * FROM (UNPIVOT (SELECT avg(advantage) AS "critic/advantages/mean", max(advantage) AS "critic/advantages/max", min(advantage) AS "critic/advantages/min", avg(r) AS "critic/returns/mean", max(r) AS "critic/returns/max", min(r) AS "critic/returns/min",
    avg(v) AS "critic/values/mean", max(v) AS "critic/values/max", min(v) AS "critic/values/min", 1 - var_samp(r - v) / (var_samp(r) + 1e-5) AS "critic/vf_explained_var" FROM t) ON COLUMNS(*) INTO NAME metric VALUE value))
SELECT metric, round(value, 6) AS value FROM m""")
def data_metrics(spark, sf_dir):
    """Sales as sequences and their lines as tokens: all series of a batch's metrics."""
    kept = F.coalesce(F.col("flag") == "kept", F.lit(False))
    l = table(spark, sf_dir, "sale_lines").where("sale_id IS NOT NULL").select("sale_id", "quantity", kept.alias("kept"), F.coalesce("amount", F.lit(0.0)).alias("amount"), F.coalesce("discount", F.lit(0.0)).alias("discount"))  # noqa: E741
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("quantity").cast("long"))), F.lit(0))
    sequences = l.groupBy("sale_id").agg(
        (F.sum("amount") / 1000).alias("score"), (F.sum(F.col("amount") * (1 - F.col("discount"))) / 1000).alias("reward"), n(F.col("kept")).alias("response_length"), n(~F.col("kept")).alias("obs_length"), F.count("*").alias("prompt_length")
    )
    tokens = l.select((F.col("amount") / 100).alias("advantage"), (F.col("amount") * F.col("discount")).alias("return"), (F.col("discount") * 100).alias("value"), F.col("kept").cast("int").alias("mask"))
    return measures.data_metrics(sequences, tokens, 7, 40).select("metric", F.round("value", 6).alias("value"))


@query("""
WITH t AS (SELECT sum(prompt_length) AS p, sum(response_length) AS r FROM (SELECT count(*) AS prompt_length, coalesce(sum(quantity), 0) AS response_length FROM sale_lines WHERE sale_id IS NOT NULL GROUP BY sale_id))
SELECT round(1000 * 12.5 / r, 6) AS gen, round(1000 * 3.0 / (p + r), 6) AS ref, round(1000 * 0.5 / (p + r), 6) AS adv, CAST(p + r AS BIGINT) AS tokens, round((p + r) / (20.0 * 4), 6) AS throughput FROM t""")
def step_timing(spark, sf_dir):
    """Seconds of a step's sections spread over the tokens of the sales, and the tokens a second and device."""
    rows = table(spark, sf_dir, "sale_lines").where("sale_id IS NOT NULL").groupBy("sale_id").agg(F.count("*").alias("prompt_length"), F.coalesce(F.sum("quantity"), F.lit(0)).alias("response_length"))
    found = measures.timing(rows, {"gen": 12.5, "ref": 3.0, "adv": 0.5, "step": 20.0}, devices=4)
    each = lambda k: F.round(F.col(f"`timing_per_token_ms/{k}`"), 6).alias(k)
    return found.select(each("gen"), each("ref"), each("adv"), F.col("`perf/total_num_tokens`").alias("tokens"), F.round(F.col("`perf/throughput`"), 6).alias("throughput"))


@query("""
WITH b AS (SELECT brand, item_id // 64 AS block, median(price) AS mid FROM items WHERE brand IS NOT NULL AND item_id IS NOT NULL AND price IS NOT NULL GROUP BY ALL), r AS (SELECT brand, block, row_number() OVER (PARTITION BY brand ORDER BY mid, block) AS bin FROM b)
SELECT 'b' || bin AS bin_name, count(*) AS n, CAST(sum(item_id) AS BIGINT) AS ids FROM items JOIN r ON items.brand = r.brand AND item_id // 64 = block WHERE price IS NOT NULL GROUP BY bin""")
def items_in_bins(spark, sf_dir):
    """Items with the name of the bin that their brand's block of 64 falls into by its median price."""
    rows = table(spark, sf_dir, "items").where("brand IS NOT NULL AND item_id IS NOT NULL AND price IS NOT NULL")
    bins = rollup.median_bins(rows, ["brand"], "item_id", "price", 64)
    found = rollup.with_bins(rows, bins, ["brand"], "item_id", 64, F.concat(F.lit("b"), F.col("bin").cast("string")))
    return found.groupBy("bin_name").agg(F.count("*").alias("n"), F.sum("item_id").alias("ids"))


@query("""
WITH r AS (SELECT coalesce(segment, '-') AS segment, count(*) AS n, round(sum(balance), 2) AS total FROM clients GROUP BY 1)
SELECT k.form, count(*) AS n, CAST(sum(r.n) AS BIGINT) AS clients, md5(string_agg(segment, ',' ORDER BY segment)) AS segments FROM r, (VALUES ('json'), ('csv'), ('markdown')) k(form) GROUP BY k.form""")
def report_files(spark, sf_dir):
    """A report of clients by segment written as JSON, CSV and Markdown, and read again."""
    at = scratch(spark, "report")
    rows = table(spark, sf_dir, "clients").groupBy(F.coalesce("segment", F.lit("-")).alias("segment")).agg(F.count("*").alias("n"), F.round(F.sum("balance"), 2).alias("total"))
    sinks.reports(rows, at, ["segment"])
    schema = "segment string, n long, total double"
    cells = F.split(F.col("value"), r" \| ")
    lines = spark.read.text(f"{at}/markdown").where("value NOT LIKE '|%---%' AND value NOT LIKE '| segment |%'")
    found = [spark.read.schema(schema).json(f"{at}/json"), spark.read.schema(schema).option("header", "true").csv(f"{at}/csv"), lines.select(F.substring(cells[0], 3, 100).alias("segment"), cells[1].cast("long").alias("n"), F.lit(None).cast("double").alias("total"))]
    out = None
    for form, df in zip(("json", "csv", "markdown"), found, strict=True):
        own = df.agg(F.lit(form).alias("form"), F.count("*").alias("n"), F.sum("n").alias("clients"), F.md5(F.array_join(F.array_sort(F.collect_list("segment")), ",")).alias("segments"))
        out = own if out is None else out.unionByName(own)
    return out


@query("""
WITH d AS (SELECT doc_id, list_transform(string_split(left(coalesce(text, ''), 300), ' '), lambda w: length(w)) AS x FROM documents), t AS (SELECT doc_id, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM d),
k AS (SELECT *, sum((v = 7)::INT) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS turn FROM t),
f AS (SELECT doc_id, i, 0 AS a, v FROM k WHERE v <> 7 UNION ALL SELECT doc_id, i, 10 * f + j, CASE WHEN j = 0 THEN 100 + f ELSE 7 END FROM k, (SELECT unnest(range(6)) AS f), (SELECT unnest(range(4)) AS j) WHERE v = 7 AND turn < 4 AND f <= turn AND j <= 2 + f % 2)
SELECT doc_id, count(*) AS n, CAST(sum(o * v) AS BIGINT) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, a) AS o FROM f) GROUP BY doc_id""")
def frame_expansion(spark, sf_dir):
    """Words that open a document as ids, those of seven letters as videos of one to four frames with time stamps each."""
    x = F.transform(F.split(F.substring(F.coalesce("text", F.lit("")), 1, 300), " "), lambda w: F.length(w))
    frame = lambda f: F.struct(F.array(F.lit(100 + f)).alias("stamp"), F.lit(2 + f % 2).alias("n"))
    frames = F.array(*[F.array(*[frame(f) for f in range(k + 1)]) for k in range(4)])
    rows = table(spark, sf_dir, "documents").select("doc_id", positions.expanded_frames(x, 7, frames).alias("x")).where(F.size("x") > 0)
    digest = F.aggregate(F.transform("x", lambda v, i: (i + 1).cast("long") * v), F.lit(0).cast("long"), lambda a, v: a + v)
    return rows.select("doc_id", F.size("x").cast("long").alias("n"), digest.alias("digest"))


@query("""
SELECT client_id % 50 AS index, CASE WHEN segment IS NULL THEN NULL ELSE 's-' || segment END AS dataset, count(*) AS n, count(DISTINCT source) AS sources, CAST(sum(coalesce(CASE WHEN seq % 3 = 0 THEN seq * 10 END, CASE WHEN balance > 0 THEN CAST(floor(balance) AS BIGINT) END)) AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS other
FROM client_changes WHERE client_id IS NOT NULL GROUP BY ALL""")
def common_records(spark, sf_dir):
    """Changes of clients as records of a run: the fields that all share, and the tokens of their responses, in sum where known."""
    rows = table(spark, sf_dir, "client_changes").where("client_id IS NOT NULL").select(
        (F.col("client_id") % 50).alias("index"), F.concat(F.lit("s-"), "segment").alias("dataset"), F.col("source").alias("source_file"), "op",
        F.struct(F.when(F.col("seq") % 3 == 0, F.col("seq").cast("long") * 10).alias("completion_tokens")).alias("cumulative_usage"), F.when(F.col("balance") > 0, F.floor("balance")).alias("completion_tokens"),
    )
    kept = scoring.common_record(rows.withColumn("vision_tokens", scoring.response_tokens(rows)))
    return kept.groupBy("index", "dataset").agg(F.count("*").alias("n"), F.count_distinct("source_file").alias("sources"), F.sum("vision_tokens").alias("tokens"), F.count("n_needles").alias("other"))


@query("""
WITH d AS (SELECT doc_id, list_transform(string_split(left(coalesce(text, ''), 300), ' '), lambda w: length(w)) AS x FROM documents), t AS (SELECT doc_id, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i, len(x) AS n, x FROM d),
k AS (SELECT doc_id, n, x, count(*) FILTER (v NOT IN (2, 3)) AS ones, CAST(sum((i + 1) * (v NOT IN (2, 3))::INT) AS BIGINT) AS mask FROM t GROUP BY doc_id, n, x)
SELECT doc_id, mask, CAST(coalesce(list_sum(x[n - ones + 1:]), 0) AS BIGINT) AS kept, CAST(x[1] + coalesce(x[3], 0) + coalesce(x[n], 0) AS BIGINT) AS gathered FROM k""")
def turn_masks(spark, sf_dir):
    """Words that open a document as ids: the mask of all turns, what is left of a sequence padded on the left, and ids by place."""
    x = F.transform(F.split(F.substring(F.coalesce("text", F.lit("")), 1, 300), " "), lambda w: F.length(w))
    rows = table(spark, sf_dir, "documents").select("doc_id", x.alias("x")).withColumn("m", messages.mask_of_all_turns(F.col("x"), [2, 3]))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, v: a + F.coalesce(v, F.lit(0)))
    at = F.transform("m", lambda v, i: (i + 1).cast("long") * v)
    places = F.array(F.lit(0), F.lit(2), F.size("x") - 1)
    return rows.select("doc_id", total(at).alias("mask"), total(messages.unpadded_left(F.col("x"), F.col("m"))).alias("kept"), total(messages.gathered(F.col("x"), places)).alias("gathered"))
