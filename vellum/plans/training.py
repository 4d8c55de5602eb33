"""Queries of the training layer: advantages, losses, metrics, sharding, packing and messages."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellum.functions import messages
from vellum.operators import advantage, resample, sequences
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


def r6(c, name):
    return F.round(c, 6).alias(name)


GROUPS = "SELECT event_id, user_id * 10 + length(event_type) AS uid, value, ts FROM events"


def rollouts(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", (F.col("user_id") * 10 + F.length("event_type")).alias("uid"), "user_id", "event_type", "value", "ts")


@query(f"""
SELECT event_id, round((value - CASE WHEN n = 1 THEN 0 ELSE m END) / (CASE WHEN n = 1 THEN 1 ELSE s END + 1e-6), 6) AS advantage
FROM (SELECT *, count(*) OVER w AS n, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s FROM ({GROUPS}) WINDOW w AS (PARTITION BY uid))""")
def grpo_advantage(spark, sf_dir):
    return advantage.grpo(rollouts(spark, sf_dir), "uid", "value").select("event_id", r6(F.col("advantage"), "advantage"))


@query(f"""
SELECT event_id, round(CASE WHEN n = 1 THEN value ELSE value * n / (n - 1) - m * n / (n - 1) END, 9) AS advantage
FROM (SELECT *, count(*) OVER w AS n, avg(value) OVER w AS m FROM ({GROUPS}) WINDOW w AS (PARTITION BY uid))""")
def rloo_advantage(spark, sf_dir):
    return advantage.rloo(rollouts(spark, sf_dir), "uid", "value").select("event_id", F.round("advantage", 9).alias("advantage"))


@query(f"""
WITH c AS (SELECT event_id, event_id % 4 > 0 AS k, value - CASE WHEN n = 1 THEN 0 ELSE m END AS a
  FROM (SELECT *, count(*) OVER w AS n, avg(value) OVER w AS m FROM ({GROUPS}) WINDOW w AS (PARTITION BY uid))),
t AS (SELECT avg(a) AS m, var_samp(a) AS v FROM c WHERE k)
SELECT event_id, round((a - m) / sqrt(v + 1e-8), 6) AS advantage FROM c, t""")
def rfpp_baseline(spark, sf_dir):
    rows = rollouts(spark, sf_dir).withColumn("mask", (F.col("event_id") % 4 > 0).cast("double"))
    return advantage.rfpp_baseline(rows, "uid", "value", "mask").select("event_id", F.round("advantage", 6).alias("advantage"))


@query("""
SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC), 4) AS ret FROM events""")
def discounted_return(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.sum("value").over(w), 4).alias("ret"))


TURNS = """
t AS (SELECT conv_id, list(CAST(length(text) % 10 AS DOUBLE) ORDER BY turn) AS r, list(CASE WHEN role = 'assistant' THEN 1.0 ELSE 0.0 END ORDER BY turn) AS m,
  list(CAST(length(text) % 7 AS DOUBLE) ORDER BY turn) AS v FROM conversations GROUP BY conv_id)"""


def turn_arrays(spark, sf_dir):
    n = F.length("text")
    own = F.struct("turn", (n % 10).cast("double").alias("r"), F.when(F.col("role") == "assistant", 1.0).otherwise(0.0).alias("m"), (n % 7).cast("double").alias("v"), F.col("text"), F.col("role"))
    held = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(own)).alias("x"))
    return held.select("conv_id", *[F.col(f"x.{k}").alias(k) for k in ("r", "m", "v", "text", "role")])


@query(f"""
WITH RECURSIVE {TURNS}, f AS (
  SELECT conv_id, r, m, len(r) AS i, CAST(0.0 AS DOUBLE) AS g FROM t
  UNION ALL SELECT conv_id, r, m, i - 1, r[i] + CASE WHEN m[i] = 1 THEN 0.9 ELSE 1 END * g FROM f WHERE i > 0)
SELECT conv_id, CAST(i AS BIGINT) AS turn, round(g, 6) AS ret FROM f WHERE i < len(r)""")
def masked_discounted_return(spark, sf_dir):
    rows = turn_arrays(spark, sf_dir).select("conv_id", F.posexplode(advantage.discounted_returns(F.col("r"), F.col("m"), 0.9)).alias("turn", "ret"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), r6(F.col("ret"), "ret"))


@query(f"""
WITH RECURSIVE {TURNS}, f AS (
  SELECT conv_id, r, m, v, len(r) AS i, CAST(0.0 AS DOUBLE) AS a, CAST(0.0 AS DOUBLE) AS ret, CAST(0.0 AS DOUBLE) AS nv FROM t
  UNION ALL SELECT conv_id, r, m, v, i - 1,
    (r[i] + CASE WHEN m[i] = 1 THEN 0.99 ELSE 1 END * nx - v[i]) * m[i] + CASE WHEN m[i] = 1 THEN 0.99 * 0.95 ELSE 1 END * a,
    CASE WHEN m[i] = 1 THEN 0.99 ELSE 1 END * ret + m[i] * r[i], nx
  FROM (SELECT *, CASE WHEN i = len(r) THEN 0.0 WHEN m[i + 1] = 1 THEN v[i + 1] ELSE nv END AS nx FROM f WHERE i > 0))
SELECT conv_id, CAST(i AS BIGINT) AS turn, round(a, 6) AS advantage, round(ret, 6) AS ret FROM f WHERE i < len(r)""")
def gae_returns(spark, sf_dir):
    rows = turn_arrays(spark, sf_dir).select("conv_id", F.posexplode(advantage.gae(F.col("r"), F.col("v"), F.col("m"), 0.99, 0.95)).alias("turn", "g"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), r6(F.col("g.advantage"), "advantage"), r6(F.col("g.ret"), "ret"))


@query(f"""
WITH {TURNS} SELECT conv_id, round(list_sum(list_transform(range(1, len(r) + 1), lambda i: r[i] * m[i])) - 2.5 * m[1], 6) AS first,
  CAST(list_sum(m) AS BIGINT) AS tokens FROM t""")
def remax_first_token(spark, sf_dir):
    a = advantage.remax(F.col("r"), F.col("m"), F.lit(2.5))
    return turn_arrays(spark, sf_dir).select("conv_id", r6(a[0], "first"), F.aggregate("m", F.lit(0.0), lambda s, x: s + x).cast("long").alias("tokens"))


TOKENS = "SELECT user_id, event_id, value / 50 AS loss, CASE WHEN event_id % 5 > 0 THEN 1 ELSE 0 END AS mask FROM events"


@query(f"""
WITH p AS (SELECT user_id, sum(loss * mask) AS s, sum(mask) AS n FROM ({TOKENS}) GROUP BY user_id)
SELECT round(sum(s) / (sum(n) + 1e-8), 6) AS token_mean, round(avg(s), 6) AS seq_mean_token_sum,
  round(avg(CASE WHEN n > 0 THEN s / n END), 6) AS seq_mean_token_mean, round(sum(s) / 128, 6) AS seq_mean_token_sum_norm FROM p""")
def masked_loss_modes(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    out = advantage.loss_modes(rows, "user_id", F.col("value") / 50, F.when(F.col("event_id") % 5 > 0, 1).otherwise(0), 128)
    return out.select(*[r6(F.col(c), c) for c in out.columns])


@query("""
WITH x AS (SELECT event_type, exp((event_id % 200 - 100) / 100.0) AS ratio, (value - 20) / 20 AS a FROM events),
y AS (SELECT event_type, a, -a * ratio AS p, -a * least(greatest(ratio, 0.8), 1.28) AS c, -a * 3 AS f FROM x)
SELECT event_type, round(avg(CASE WHEN a < 0 THEN least(f, greatest(p, c)) ELSE greatest(p, c) END), 6) AS loss,
  round(avg(CASE WHEN c > p THEN 1 ELSE 0 END), 6) AS clipped, round(avg(CASE WHEN a < 0 AND greatest(p, c) > f THEN 1 ELSE 0 END), 6) AS clipped_low
FROM y GROUP BY event_type""")
def dual_clip_loss(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.exp((F.col("event_id") % 200 - 100) / 100.0).alias("ratio"), ((F.col("value") - 20) / 20).alias("a"))
    parts = advantage.dual_clip(F.col("ratio"), F.col("a"), 0.2, 0.28, 3.0)
    return rows.groupBy("event_type").agg(*[r6(F.avg(c), n) for n, c in parts.items()])


@query("""
WITH d AS (SELECT event_type, (event_id % 300 - 150) / 50.0 AS d FROM events)
SELECT event_type, round(avg(d), 6) AS kl, round(avg(abs(d)), 6) AS abs_kl, round(avg(0.5 * d * d), 6) AS mse_kl,
  round(avg(greatest(-10, least(10, exp(-d) + d - 1))), 6) AS low_var_kl FROM d GROUP BY event_type""")
def kl_estimates(spark, sf_dir):
    d, zero = (F.col("event_id") % 300 - 150) / 50.0, F.lit(0.0)
    kinds = {"kl": "kl", "abs_kl": "abs", "mse_kl": "mse", "low_var_kl": "low_var_kl"}
    return table(spark, sf_dir, "events").groupBy("event_type").agg(*[r6(F.avg(advantage.kl_estimate(d, zero, k)), n) for n, k in kinds.items()])


@query("""
SELECT lang, doc_id, lang || '_' || lpad(CAST(row_number() OVER w - 1 AS VARCHAR), 4, '0') AS task_id
FROM documents WINDOW w AS (PARTITION BY lang ORDER BY doc_id) QUALIFY row_number() OVER w <= 10""")
def topn_per_group_ids(spark, sf_dir):
    return sequences.first_per_group(table(spark, sf_dir, "documents").select("lang", "doc_id"), ["lang"], ["doc_id"], 10, F.col("lang"))


@query("SELECT doc_id, CAST(ntile(7) OVER (ORDER BY doc_id) AS BIGINT) AS shard FROM documents")
def contiguous_shards(spark, sf_dir):
    return sequences.contiguous_shards(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7)


@query("SELECT doc_id FROM documents QUALIFY (row_number() OVER (ORDER BY doc_id) - 1) % 5 = 2")
def strided_shards(spark, sf_dir):
    return sequences.strided_shard(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 5, 2)


@query("""
WITH RECURSIVE n AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents WHERE n_chars <= 6000),
f AS (SELECT source, doc_id, i, n_chars, CAST(0 AS BIGINT) AS pack, CAST(0 AS BIGINT) AS start FROM n WHERE i = 1
  UNION ALL SELECT n.source, n.doc_id, n.i, n.n_chars,
    CASE WHEN f.start + f.n_chars + n.n_chars > 8000 THEN f.pack + 1 ELSE f.pack END, CASE WHEN f.start + f.n_chars + n.n_chars > 8000 THEN 0 ELSE f.start + f.n_chars END
  FROM f JOIN n ON n.source = f.source AND n.i = f.i + 1)
SELECT source, doc_id, pack, start AS "offset" FROM f""")
def nextfit_pack(spark, sf_dir):
    return sequences.nextfit(table(spark, sf_dir, "documents"), ["source"], "doc_id", "n_chars", 8000, 6000)


@query("""
WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE n_chars < 3000)
SELECT lang, doc_id, i // 16 AS batch FROM r WHERE i // 16 < n // 16""")
def rebatch_drop_last(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("n_chars < 3000").select("lang", "doc_id")
    return sequences.rebatched(rows, ["lang"], "doc_id", 16)


@query("""
SELECT n_nationkey, false AS is_pad FROM nation UNION ALL
SELECT n_nationkey, true FROM nation QUALIFY row_number() OVER (ORDER BY n_nationkey) <= (8 - (SELECT count(*) FROM nation) % 8) % 8""")
def pad_to_divisor(spark, sf_dir):
    return sequences.padded_to(table(spark, sf_dir, "nation").select("n_nationkey"), ["n_nationkey"], 8)


@query("SELECT r_regionkey, CAST(range AS INT) AS copy, r_regionkey * 4 + range AS place FROM region, range(4)")
def repeat_interleave(spark, sf_dir):
    rows = sequences.repeated(table(spark, sf_dir, "region").select("r_regionkey"), F.col("r_regionkey"), 4, True)
    return rows.select("r_regionkey", "copy", (F.col("position.a") * 4 + F.col("position.b")).alias("place"))


@query("""
WITH t AS (SELECT lang, n_chars, ntile(8) OVER (ORDER BY doc_id) AS s FROM documents), p AS (SELECT s, sum(n_chars) AS x FROM t GROUP BY s)
SELECT CAST(min(x) AS BIGINT) AS least, CAST(max(x) AS BIGINT) AS most, CAST(max(x) - min(x) AS BIGINT) AS difference FROM p""")
def overlap_imbalance(spark, sf_dir):
    return sequences.imbalance(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["doc_id"], "n_chars", 8)


@query("""
WITH m AS (SELECT conv_id, max(turn) FILTER (role = 'assistant') AS last FROM conversations GROUP BY conv_id)
SELECT conv_id, count(*) AS turns, string_agg(role, '|' ORDER BY turn) AS roles FROM conversations JOIN m USING (conv_id)
WHERE last IS NULL OR turn <> last GROUP BY conv_id""")
def message_drop_last_assistant(spark, sf_dir):
    held = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("x"))
    kept = held.select("conv_id", messages.without_last_assistant(F.col("x")).alias("x")).where(F.size("x") > 0)
    return kept.select("conv_id", F.size("x").cast("long").alias("turns"), F.array_join(F.transform("x", lambda m: m["role"]), "|").alias("roles"))


@query("""
WITH t AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations), s AS (
  SELECT conv_id, turn, role, n, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM t)
SELECT conv_id, turn, CAST(start AS BIGINT) AS first, CAST(start + n AS BIGINT) AS after, role = 'assistant' AS counts FROM s""")
def loss_mask_spans(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, sf_dir, "conversations").withColumn("n", F.length("text"))
    start = F.coalesce(F.sum("n").over(w), F.lit(0))
    return rows.select("conv_id", "turn", start.alias("first"), (start + F.col("n")).alias("after"), (F.col("role") == "assistant").alias("counts"))


@query("""
WITH x AS (SELECT user_id, event_id, event_type, ts, lag(event_type) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(CASE WHEN p = event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM x)
SELECT user_id, CAST(island AS BIGINT) AS island, any_value(event_type) AS kind, count(*) AS n FROM i GROUP BY user_id, island""")
def islands_modality(spark, sf_dir):
    return resample.islands(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("""
SELECT event_id, round(0.8 * (value > 10)::INT + 0.2 * (event_id % 3 = 0)::INT + least(-(event_id % 100 - 80) / 20.0 * 1.0, 0), 6) AS reward FROM events""")
def reward_linear(spark, sf_dir):
    e = F.col("event_id")
    score = 0.8 * (F.col("value") > 10).cast("int") + 0.2 * (e % 3 == 0).cast("int")
    return table(spark, sf_dir, "events").select("event_id", r6(score + advantage.overlong_penalty(e % 100, F.lit(100), F.lit(20), 1.0), "reward"))


@query("""
SELECT event_id, CAST(list_transform(range(1, 9), lambda i: CASE WHEN i = event_id % 8 + 1 THEN value ELSE 0 END) AS DOUBLE[]) AS series FROM events""")
def reward_on_last_token(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", advantage.on_last_token(F.col("event_id") % 8 + 1, F.col("value"), F.lit(8)).alias("series"))


@query("""
WITH i AS (SELECT doc_id, list_transform(range(0, doc_id % 9 + 1), lambda k: (doc_id * 7 + k * 5) % 11) AS ids FROM documents),
p AS (SELECT doc_id, ids, list_position(ids, 3) AS e FROM i)
SELECT doc_id, len(ids) AS n, CAST(coalesce(e, len(ids)) AS BIGINT) AS kept, array_to_string(list_concat(ids[1:6], list_transform(range(0, greatest(0, 6 - len(ids))), lambda x: CAST(0 AS BIGINT))), ' ') AS padded FROM p""")
def eos_and_padding(spark, sf_dir):
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.sequence(F.lit(0), (d % 9).cast("int")), lambda k: (d * 7 + k * 5) % 11).alias("ids"))
    kept = F.aggregate(messages.until_first(F.col("ids"), 3), F.lit(0), lambda a, x: a + x)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n"), kept.cast("long").alias("kept"), F.array_join(messages.padded(F.col("ids"), F.lit(6), 0), " ").alias("padded"))


@query("""
SELECT floor(epoch(ts) / 3600) * 3600 AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def events_tumbling(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour"), "event_type")
    out = rows.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.unix_timestamp("window.start").cast("double").alias("hour"), "event_type", "n", "total")


@query("""
WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS s FROM events),
i AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM x)
SELECT user_id, count(*) AS n, epoch_us(min(ts)) AS first_us FROM i GROUP BY user_id, k""")
def events_session(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    out = rows.groupBy("user_id", F.session_window("at", "6 hours")).agg(F.count("*").alias("n"), F.min("at").alias("first_at"))
    return out.select("user_id", "n", F.unix_micros("first_at").alias("first_us"))


@query("""
WITH q AS (SELECT vec_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id, b.vec_id AS other, round(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) /
  sqrt(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(q.e AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS cosine
  FROM q, embeddings b WHERE b.vec_id <> q.vec_id)
SELECT vec_id, other, cosine FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, other) <= 5""")
def vec_pairs_topk(spark, sf_dir):
    return resample.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0, 5)


@query()
def karmarkar_karp(spark, sf_dir):
    return sequences.balanced(table(spark, sf_dir, "documents"), ["source"], "doc_id", "n_chars", 4)


@query()
def micro_batches(spark, sf_dir):
    return sequences.micro_batches(table(spark, sf_dir, "documents"), ["source"], "doc_id", "n_chars", 20_000)


@query()
def best_fit_pack(spark, sf_dir):
    return sequences.packed_by(table(spark, sf_dir, "documents"), ["source"], "doc_id", "n_chars", partial(sequences.bestfit_bins, capacity=32_768, look_ahead=256))


@query()
def length_grouped_pack(spark, sf_dir):
    bins = partial(sequences.length_grouped_bins, capacity=32_768, most_items=1024, most_tokens=8 * 32_768, padded=True)
    return sequences.packed_by(table(spark, sf_dir, "documents"), ["source"], "doc_id", "n_chars", bins)


#: resample.poisson_weights in SQL: w is how often a unit (its text: u) is in draw d of the given number.
def weighed(rows: str, unit: str, draws: int, seed: int) -> str:
    steps = " ".join(f"WHEN x < {t} THEN {k}" for k, t in enumerate(resample.POISSON))
    part = lambda at: f"CAST('0x' || substr(md5('{seed}:' || coalesce(CAST({unit} AS VARCHAR), '')), {at}, 15) AS BIGINT)"
    return f"""(SELECT *, CASE {steps} ELSE {len(resample.POISSON)} END AS w FROM (
  SELECT *, (a + b * d) % {resample.PRIME} AS x FROM (SELECT *, {part(1)} % {resample.PRIME} AS a, {part(16)} % {resample.PRIME - 1} + 1 AS b FROM {rows}), (SELECT range AS d FROM range({draws}))))"""


@query(f"""
WITH m AS (SELECT user_id, d, sum(w * value) / sum(w) AS m FROM {weighed("(SELECT * FROM events WHERE value IS NOT NULL)", "event_id", 200, 42)} WHERE w > 0 GROUP BY ALL),
q AS (SELECT user_id, quantile_cont(m, [0.025, 0.975]) AS q FROM m GROUP BY user_id)
SELECT user_id, n, mean, round(q[1], 9) AS low, round(q[2], 9) AS high FROM (SELECT user_id, count(value) AS n, round(avg(value), 9) AS mean FROM events WHERE value IS NOT NULL GROUP BY user_id) JOIN q USING (user_id)""")
def bootstrap_ci(spark, sf_dir):
    found = resample.bootstrap(table(spark, sf_dir, "events"), ["user_id"], "value", draws=200, seed=42, unit="event_id")
    return found.select("user_id", "n", *[F.round(c, 9).alias(c) for c in ("mean", "low", "high")])


@query("""
WITH c AS (SELECT event_type AS s, user_id AS p, coalesce(value, 'nan') AS v, count(*) AS c FROM events GROUP BY ALL),
r AS (SELECT *, sum(c) OVER (PARTITION BY s, p ORDER BY v) - c AS below, sum(c) OVER (PARTITION BY s, p) AS n, sum(v * c) OVER (PARTITION BY s, p) / sum(c) OVER (PARTITION BY s, p) AS mean FROM c),
k AS (SELECT *, unnest(list_append(list_filter(list_transform(range(1, 40), lambda b: CAST(1 AS BIGINT) << b), lambda k: k < n), CAST(n AS BIGINT))) AS k FROM r),
w AS (SELECT *, v - mean AS y, pow((below + c) / n, k) - pow(below / n, k) AS b, pow((n - below) / n, k) - pow((n - below - c) / n, k) AS w FROM k),
x AS (SELECT s, p, k, any_value(mean) AS mean, sum(y * b) AS b1, sum(y * y * b) AS b2, sum(y * w) AS w1, sum(y * y * w) AS w2 FROM w GROUP BY ALL),
m AS (
  SELECT s, 'mean@' || CAST(n AS BIGINT) AS metric, any_value(mean) AS v FROM r GROUP BY s, p, n UNION ALL
  SELECT s, 'std@' || CAST(n AS BIGINT), sqrt(sum((v - mean) * (v - mean) * c) / sum(c)) FROM r GROUP BY s, p, n UNION ALL
  SELECT s, 'best@' || k || '/mean', mean + b1 FROM x UNION ALL SELECT s, 'best@' || k || '/std', sqrt(greatest(b2 - b1 * b1, 0)) FROM x UNION ALL
  SELECT s, 'worst@' || k || '/mean', mean + w1 FROM x UNION ALL SELECT s, 'worst@' || k || '/std', sqrt(greatest(w2 - w1 * w1, 0)) FROM x)
SELECT s AS event_type, metric, round(avg(v), 9) AS value FROM m GROUP BY ALL""")
def bootstrap_best_at_k(spark, sf_dir):
    found = resample.validation_metrics(table(spark, sf_dir, "events"), "event_type", "user_id", "value")
    return found.select("event_type", "metric", F.round("value", 9).alias("value"))


@query()
def validation_with_votes(spark, sf_dir):
    """Success of answers to prompts (the clients' clicks of a kind), with majorities of what they chose."""
    rows = table(spark, sf_dir, "events").select("event_type", "user_id", F.floor(F.col("value") / 20).alias("pred"), (F.floor(F.col("value") / 20) % 3 == 0).cast("double").alias("score"))
    found = resample.validation_metrics(rows, "event_type", "user_id", "score", vote="pred", draws=50)
    return found.select("event_type", "metric", F.round("value", 6).alias("value"))


@query(f"""
WITH s AS (SELECT status, client_id, priority, avg(CASE WHEN total > 25 * priority THEN 1.0 ELSE 0 END) AS y FROM sales WHERE client_id IS NOT NULL AND total IS NOT NULL AND priority IS NOT NULL GROUP BY ALL),
x AS (SELECT status, count(DISTINCT priority) AS xs FROM s GROUP BY status),
u AS (SELECT status, client_id FROM s JOIN x USING (status) GROUP BY status, client_id, xs HAVING count(DISTINCT priority) = xs),
f AS (SELECT s.* FROM s JOIN u USING (status, client_id)),
c AS (SELECT status, priority, d, sum(w * y) / sum(w) AS m FROM {weighed("f", "client_id", 300, 7)} WHERE w > 0 GROUP BY ALL),
n AS (SELECT *, lead(priority) OVER v AS p2, lead(m) OVER v AS m2 FROM c WINDOW v AS (PARTITION BY status, d ORDER BY priority)),
t AS (SELECT status, d, round(arg_min(exp(ln(priority) + (0.5 - m) / (m2 - m) * (ln(p2) - ln(priority))), priority), 6) AS t FROM n WHERE (m - 0.5) * (m2 - 0.5) <= 0 AND m <> m2 GROUP BY ALL)
SELECT status, count(t) AS crossed, CASE WHEN count(t) > 50 THEN round(quantile_cont(t, 0.025), 5) END AS low, CASE WHEN count(t) > 50 THEN round(quantile_cont(t, 0.975), 5) END AS high FROM t GROUP BY status""")
def threshold_intervals(spark, sf_dir):
    """Where the share of a client's sales above a rising level falls below a half, with the interval over clients."""
    rows = table(spark, sf_dir, "sales").where("client_id IS NOT NULL AND total IS NOT NULL AND priority IS NOT NULL")
    rows = rows.groupBy("status", "client_id", "priority").agg(F.avg(F.when(F.col("total") > 25 * F.col("priority"), 1.0).otherwise(0.0)).alias("y"))
    found = resample.threshold_interval(rows, ["status"], "client_id", "priority", "y", 0.5, draws=300, seed=7)
    return found.select("status", "crossed", *[F.round(c, 5).alias(c) for c in ("low", "high")])
