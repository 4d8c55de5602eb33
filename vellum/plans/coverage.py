"""Queries of readers, sinks, batches, prompts, texts and training arithmetic over the columns of the tables.

Readers and sinks work on tables that are written below the shared folder first, in the formats they read.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellum.functions import geometry, messages, positions, prompts, text
from vellum.operators import advantage, batches, measures, rollup, scoring, sequences
from vellum.session import scratch, table
from vellum.sources import manifests, sinks, training

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


# --- readers and sinks ---


@query("""
WITH c AS (SELECT client_id, name, segment, round(balance, 2) AS balance FROM clients), n AS (SELECT nation_id, name FROM (SELECT n_nationkey AS nation_id, n_name AS name FROM nation))
SELECT k.kind, count(*) AS n, count(DISTINCT c.client_id) AS ids, md5(string_agg(coalesce(name, '-'), '|' ORDER BY c.client_id, name)) AS names, count(segment) AS segments, round(sum(balance), 1) AS balance
FROM c, (VALUES ('jsonl'), ('csv'), ('parquet'), ('orc')) k(kind) GROUP BY k.kind
UNION ALL SELECT 'json', count(*), count(DISTINCT nation_id), md5(string_agg(name, '|' ORDER BY nation_id, name)), 0, NULL FROM n""")
def typed_sources(spark, sf_dir):
    """Clients as JSON lines, CSV, Parquet and ORC, nations as a JSON array in a file, loaded by kind and put together."""
    clients = table(spark, sf_dir, "clients").select("client_id", "name", "segment", F.round("balance", 2).alias("balance"))
    at = scratch(spark, "sources")
    schema = "client_id long, name string, segment string, balance double"
    parts = []
    for kind, form, options in (("jsonl", "json", {}), ("csv", "csv", {"header": "true", "escape": '"'}), ("parquet", "parquet", {}), ("orc", "orc", {})):
        clients.write.format(form).options(**options).save(f"{at}/{kind}")
        parts.append(manifests.load(spark, f"{at}/{kind}", kind, None if form in ("parquet", "orc") else schema).withColumn("kind", F.lit(kind)))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("client_id"), F.col("n_name").alias("name"))
    # a dimension of 25 rows, as an array in one file
    nations.agg(F.to_json(F.collect_list(F.struct("client_id", "name")))).coalesce(1).write.text(f"{at}/json")
    parts.append(manifests.load(spark, f"{at}/json", "json", "client_id long, name string").withColumn("kind", F.lit("json")))
    named = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("client_id", F.coalesce("name", F.lit("-")).alias("name")))), lambda x: x["name"]), "|")
    return manifests.concatenated(parts).groupBy("kind").agg(
        F.count("*").alias("n"), F.count_distinct("client_id").alias("ids"), F.md5(named).alias("names"), F.count("segment").alias("segments"), F.round(F.sum("balance"), 1).alias("balance")
    )


@query("""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lang, source, n_chars FROM documents)
SELECT 'rollouts' AS reader, count(*) AS n, md5(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id)) AS digest FROM d WHERE n_chars IS NULL OR n_chars <= 3000
UNION ALL SELECT 'supervised', count(*), md5(string_agg(text || lang, ',' ORDER BY text || lang)) FROM (SELECT doc_id, text, coalesce(lang, '?') AS lang FROM d)
UNION ALL SELECT 'conversations', count(*), md5(string_agg(roles, ',' ORDER BY roles)) FROM (SELECT string_agg(role, ' ' ORDER BY turn) || conv_id AS roles FROM conversations GROUP BY conv_id)
UNION ALL SELECT 'preferences', 2 * count(*), md5(string_agg(text || '+' || coalesce(source, '?'), ',' ORDER BY text || '+' || coalesce(source, '?'))) FROM d
UNION ALL SELECT 'evaluations', CAST(sum(n) AS BIGINT), md5(string_agg(lang || n, ',' ORDER BY lang || n)) FROM (SELECT coalesce(lang, '?') AS lang, len(string_split(text, chr(10))) AS n FROM d)""")
def training_readers(spark, sf_dir):
    """The five readers of training sets over documents and conversations written as their Parquet files, two files each."""
    at = scratch(spark, "training")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("?")).alias("lang"), F.coalesce("source", F.lit("?")).alias("source"), "n_chars")
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content")))), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))

    def two(rows, name: str, key: str) -> list[str]:
        for part in (0, 1):
            rows.where(F.pmod(F.col(key), F.lit(2)) == part).write.parquet(f"{at}/{name}{part}")
        return [f"{at}/{name}0", f"{at}/{name}1"]

    def row(name: str, df, key, order=None, n=None):
        found = sinks.digest_of_all(df.select((key if order is None else order).alias("order"), key.alias("text"), (F.lit(1) if n is None else n).cast("long").alias("n")), "text", "order", "n")
        return found.select(F.lit(name).alias("reader"), F.col("n") if n is None else F.when(F.col("digest").isNotNull(), F.col("n")).alias("n"), "digest")

    asked = training.rollouts(spark, two(docs, "rollouts", "doc_id"), "n_chars", 3000)
    deep = docs.select("doc_id", F.struct("text").alias("extra"), F.array(F.struct(F.col("lang").alias("said"))).alias("reply"))
    taught = training.supervised(spark, two(deep, "supervised", "doc_id"), "extra", "reply", ["text"], ["said"])
    spoken = training.conversations(spark, two(turns, "chats", "conv_id")).select(F.array_join(F.transform("messages", lambda m: m["role"]), " ").alias("roles"))
    numbered = turns.select("conv_id", F.array_join(F.transform("messages", lambda m: m["role"]), " ").alias("roles"))
    spoken = spoken.groupBy("roles").count().join(numbered, "roles")
    pairs = training.stacked(training.preferences(spark, two(docs.select("doc_id", F.col("text").alias("prompt"), F.col("text").alias("chosen"), F.col("source").alias("rejected")), "pairs", "doc_id")))
    rejected = row("preferences", pairs.where("NOT is_chosen"), F.concat_ws("+", "prompt", "response"))
    graded = docs.select("doc_id", F.split("text", "\n").alias("responses"), F.col("lang").alias("data_source"), F.struct(F.col("source").alias("ground_truth")).alias("reward_model"))
    graded = training.evaluations(spark, two(graded, "graded", "doc_id")).groupBy("row", "data_source").agg(F.count("*").alias("n"))
    total = pairs.agg(F.count("*").alias("n")).crossJoin(rejected.select("reader", "digest")).select("reader", "n", "digest")  # one row each
    parts = [
        row("rollouts", asked, F.col("doc_id").cast("string"), F.col("doc_id")), row("supervised", taught, F.concat("prompt", "response")), row("conversations", spoken, F.concat("roles", F.col("conv_id").cast("string"))),
        total, row("evaluations", graded, F.concat("data_source", F.col("n").cast("string")), n=F.col("n")),
    ]
    return manifests.concatenated(parts)


@query("""
WITH c AS (SELECT client_id, seq, op, coalesce(segment, '?') AS segment, CASE WHEN op = 'delete' THEN 'gone' END AS error, seq % 3 AS attempt, change_id FROM client_changes WHERE client_id IS NOT NULL AND seq IS NOT NULL AND change_id IS NOT NULL),
w AS (SELECT client_id, attempt, arg_max(struct_pack(segment, error), change_id) AS x FROM c GROUP BY ALL), l AS (SELECT client_id, arg_max(x, attempt) AS x FROM w GROUP BY client_id)
SELECT 'kept' AS what, count(*) AS n, md5(string_agg(client_id || ':' || x.segment || ':' || coalesce(x.error, ''), ',' ORDER BY client_id)) AS digest FROM l
UNION ALL SELECT 'to_do', count(*), md5(string_agg(CAST(client_id AS VARCHAR), ',' ORDER BY client_id)) FROM (SELECT DISTINCT client_id FROM clients WHERE client_id IS NOT NULL) k WHERE client_id NOT IN (SELECT client_id FROM l WHERE x.error IS NULL)""")
def result_log(spark, sf_dir):
    """Changes of clients as results of three attempts: appended, compacted to the last record of each, and what is still to do."""
    at = scratch(spark, "results")
    c = table(spark, sf_dir, "client_changes").where("client_id IS NOT NULL AND seq IS NOT NULL AND change_id IS NOT NULL")
    c = c.select("client_id", F.coalesce("segment", F.lit("?")).alias("segment"), F.when(F.col("op") == "delete", "gone").alias("error"), (F.col("seq") % 3).alias("a"), "change_id")
    for attempt in range(3):
        own = c.where(F.col("a") == attempt).groupBy("client_id").agg(F.max_by(F.struct("segment", "error"), "change_id").alias("x")).select("client_id", "x.*")
        sinks.append_results(own, at, attempt)
    found = spark.read.parquet(at)
    kept = sinks.compacted(found, ["client_id"], ["client_id"])
    wanted = table(spark, sf_dir, "clients").where("client_id IS NOT NULL").select("client_id").distinct()
    digest = lambda c: F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("client_id", c.alias("s")))), lambda x: x["s"]), ","))
    key = F.col("client_id").cast("string")
    one = kept.agg(F.lit("kept").alias("what"), F.count("*").alias("n"), digest(F.concat_ws(":", key, "segment", F.coalesce("error", F.lit("")))).alias("digest"))
    return one.unionByName(sinks.still_to_do(wanted, found, ["client_id"]).agg(F.lit("to_do").alias("what"), F.count("*").alias("n"), digest(key).alias("digest")))


@query("""
SELECT priority AS dpi, count(*) AS n, CAST(sum(sale_id) AS BIGINT) AS ids, 0 AS failed FROM sales WHERE priority IS NOT NULL AND status <> 'held' GROUP BY priority
UNION ALL SELECT NULL, count(*), CAST(sum(sale_id) AS BIGINT), count(*) FROM sales WHERE status = 'held'""")
def fanned_out(spark, sf_dir):
    """Sales fanned out by priority: without failures all are published, with failures those alone are written."""
    rows = table(spark, sf_dir, "sales").select("sale_id", F.col("priority").alias("dpi"), "status", F.when(F.col("status") == "held", "held").alias("error"))
    good, bad = scratch(spark, "good"), scratch(spark, "bad")
    sinks.fan_out(rows.where("dpi IS NOT NULL AND status <> 'held'"), good)
    failed = sinks.fan_out(rows, bad)
    published = spark.read.json(f"{good}/all").groupBy("dpi").agg(F.count("*").alias("n"), F.sum("sale_id").alias("ids")).withColumn("failed", F.lit(0).cast("long"))
    aside = spark.read.json(f"{bad}/failed").agg(F.lit(None).cast("int").alias("dpi"), F.count("*").alias("n"), F.sum("sale_id").alias("ids")).withColumn("failed", F.lit(failed).cast("long"))
    return published.withColumn("dpi", F.col("dpi").cast("int")).unionByName(aside)


@query("SELECT source_row // 1000 AS block, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM (SELECT n_chars, row_number() OVER () - 1 AS source_row FROM documents) WHERE source_row % 4 = 1 GROUP BY 1")
def numbered_rows(spark, sf_dir):
    """Documents of a strided shard by their row numbers over all files of the table, reading one column."""
    rows = manifests.numbered_over(spark, f"{sf_dir}/documents.parquet", ["n_chars"]).where(F.col("source_row") % 4 == 1)
    return rows.groupBy(F.floor(F.col("source_row") / 1000).alias("block")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


# --- batches ---


@query("""
WITH o AS (SELECT o_orderkey AS key, o_custkey AS id, round(o_totalprice, 2) AS p, o_orderpriority AS q FROM orders)
SELECT count(*) AS n, CAST(sum(id) AS BIGINT) AS ids, round(sum(p), 2) AS price, count(DISTINCT q) AS kinds, 'key id price' AS kept, 'key priority' AS popped FROM o""")
def batch_columns(spark, sf_dir):
    """Orders as a batch: some columns chosen, renamed and popped, and those with a suffix pruned."""
    rows = table(spark, sf_dir, "orders").withColumns({"scan_legacy": F.lit(1), "note_dpi72": F.lit("x"), "note_dpi96": F.lit("y")})
    rows = batches.pruned(rows, r"_legacy|_dpi\d+")
    rows = batches.selected(rows, ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "missing"], strict=False)
    rows = batches.renamed(rows, ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"], ["key", "id", "price", "priority"])
    left, popped = batches.popped(rows, ["priority"], ["key"])
    found = left.join(popped, "key").agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.round(F.sum(F.round("price", 2)), 2).alias("price"), F.count_distinct("priority").alias("kinds"))
    return found.withColumn("kept", F.lit(" ".join(left.columns))).withColumn("popped", F.lit(" ".join(popped.columns)))


@query("""
WITH s AS (SELECT sale_id, coalesce(total, 0) AS total FROM sales WHERE sale_id < 960), f AS (SELECT sale_id // 80 AS fold, count(*) AS n, round(sum(total), 4) AS total, min(sale_id) AS first FROM s GROUP BY 1)
SELECT fold, n, first, total, total AS again FROM f""")
def folded_batches(spark, sf_dir):
    """A batch of 960 sales folded into twelve, turned to columns and back to rows, and unfolded again."""
    rows = table(spark, sf_dir, "sales").where("sale_id < 960").select("sale_id", F.coalesce("total", F.lit(0.0)).alias("total"))
    folds = batches.folded(rows, "sale_id", 12, 960)
    turned = folds.withColumn("items", batches.items_of(batches.columns_of(F.col("items"), ["sale_id", "total"]), ["sale_id", "total"]))
    again = batches.unfolded(turned).groupBy(F.floor(F.col("sale_id") / 80).alias("fold")).agg(F.round(F.sum("total"), 4).alias("again"))
    sums = turned.select("fold", F.size("items").cast("long").alias("n"), F.col("items")[0]["sale_id"].alias("first"), F.round(F.aggregate("items", F.lit(0.0), lambda a, x: a + x["total"]), 4).alias("total"))
    return sums.join(again, "fold")


@query("""
WITH t AS (SELECT sale_id AS p, status, total, client_id FROM sales), n AS (SELECT count(*) AS n FROM t)
SELECT 'chosen' AS what, count(*) AS n, CAST(sum(p) AS BIGINT) AS places FROM (SELECT p FROM t WHERE status IN ('open', 'held') ORDER BY p LIMIT 500 OFFSET 20)
UNION ALL SELECT 'sliced', count(*), CAST(sum((p - 10) // 7) AS BIGINT) FROM t, n WHERE p >= 10 AND p < n - 5 AND (p - 10) % 7 = 0
UNION ALL SELECT 'reordered', count(*), CAST(sum(n - 1 - p) AS BIGINT) FROM t, n WHERE client_id IS NOT NULL AND client_id < n
UNION ALL SELECT 'calibrated', count(*), CAST(sum(floor(1000 * least(total / 100, 1.0))) AS BIGINT) FROM t WHERE status <> 'held' AND total IS NOT NULL""")
def batch_rows(spark, sf_dir):
    """Sales chosen by status with a limit, sliced by place, reordered, and filtered as calibration points."""
    rows = table(spark, sf_dir, "sales").select(F.col("sale_id").alias("p"), F.col("status").alias("task"), "total", "client_id")
    total = rows.count()
    row = lambda name, df, place: df.agg(F.lit(name).alias("what"), F.count("*").alias("n"), F.sum(place).cast("long").alias("places"))
    order = rows.where(F.col("client_id").isNotNull() & (F.col("client_id") < total)).select("p", (total - 1 - F.col("p")).alias("new_p")).withColumnRenamed("new_p", "new_place").withColumnRenamed("p", "place")
    back = batches.reordered(rows.withColumnRenamed("p", "place"), order, "place")
    points = batches.calibrated(rows.select(F.coalesce(F.col("task") != "held", F.lit(False)).alias("ok"), (F.col("total") / 100).alias("cer")))
    parts = [
        row("chosen", batches.chosen(rows, "p", ["open", "held"], skip=20, limit=500), F.col("p")), row("sliced", batches.sliced(rows, "p", 10, -5, 7, total), F.col("p")),
        row("reordered", back, F.col("place")), row("calibrated", points, F.floor(1000 * F.col("cer"))),
    ]
    return manifests.concatenated(parts)


# --- prompts and texts ---

@query(r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents)
SELECT doc_id, md5(regexp_replace(lower(x), '[^a-z0-9]+', '', 'g')) AS alnum, md5(regexp_replace(regexp_replace(x, '[\x00-\x1f]', chr(10), 'g'), '^[\s\x{A0}\x{85}]+|[\s\x{A0}\x{85}]+$', '', 'g')) AS scrubbed, md5(string_split(ltrim(x, chr(10)), chr(10))[1]) AS first_line,
  md5(list_last(string_split(x, chr(10) || chr(10)))) AS last_paragraph, md5(replace(replace(replace(replace(replace(replace(replace(replace(x, chr(173), ''), chr(8203), ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '  ', ' &nbsp;'), chr(9), '&nbsp;&nbsp;&nbsp;&nbsp;'), chr(10), '<br/>')) AS layout,
  len(regexp_extract_all(lower(x), '[a-z0-9]+')) AS words FROM t WHERE x NOT LIKE '%   %'""")
def text_variants(spark, sf_dir):
    """Normal forms of whole documents: letters and digits, scrubbed, first line, last paragraph, layout markup."""
    x = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").where(~x.contains("   "))
    md = lambda c, name: F.md5(c).alias(name)
    words = F.size(F.regexp_extract_all(F.lower(x), F.lit("([a-z0-9]+)"), F.lit(1))).cast("long")
    return rows.select(
        "doc_id", md(text.alnum(x), "alnum"), md(text.scrubbed(x), "scrubbed"), md(text.first_line(x), "first_line"), md(text.last_paragraph(x), "last_paragraph"), md(text.layout_text(x), "layout"), words.alias("words")
    )


@query(r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS x FROM conversations), m AS (SELECT *, x || CASE turn % 3 WHEN 1 THEN '</think> ' || role WHEN 2 THEN '</think>a</think>b' ELSE '' END AS y FROM c)
SELECT conv_id, turn, md5(CASE WHEN strpos(y, '</think>') > 0 THEN left(y, strpos(y, '</think>') + 7) ELSE '' END) AS reasoning, md5(CASE WHEN strpos(y, '</think>') > 0 THEN substr(y, strpos(y, '</think>') + 8) ELSE y END) AS answer,
  md5(trim(list_last(string_split(y, '</think>')))) AS after, CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' ELSE role END AS role FROM m""")
def thought_and_answer(spark, sf_dir):
    """Turns of both dialects parted after the first end of thinking, and what follows the last."""
    c = table(spark, sf_dir, "conversations")
    x, t = F.coalesce("text", F.lit("")), F.col("turn") % 3
    y = F.concat(x, F.when(t == 1, F.concat(F.lit("</think> "), "role")).when(t == 2, "</think>a</think>b").otherwise(""))
    old = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    empty = F.lit("")
    dialect = F.when(F.col("conv_id") % 2 == 0, F.struct(old.alias("from"), y.alias("value"), empty.alias("role"), empty.alias("content"))).otherwise(F.struct(empty.alias("from"), empty.alias("value"), F.col("role").alias("role"), y.alias("content")))
    said = messages.unified_turns(F.array(dialect))[0]
    parts = text.reasoning_and_answer(F.coalesce(said["content"], F.lit("")))
    return c.select("conv_id", "turn", F.md5(parts["reasoning"]).alias("reasoning"), F.md5(parts["answer"]).alias("answer"), F.md5(text.after_thinking(F.coalesce(said["content"], F.lit("")))).alias("after"), said["role"].alias("role"))


@query("""
WITH p AS (SELECT page_id, url, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages WHERE url IS NOT NULL),
x AS (SELECT page_id, host, '/old/root' || path AS a, path, 'Read {context} of ' || host || ' now: {input}' AS t, 'results_' || host || '/' AS folder, 'Where is ' || host || '?  The special magic number for ' || page_id || ' mentioned in the provided text is ' AS q FROM p)
SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/new/' || ltrim(substr(a, 11), '') WHEN 1 THEN '/elsewhere' || path ELSE '/new/' || host END AS rooted, 'Read ' AS head, ' of ' || host || ' now: ' || path AS tail, CASE WHEN page_id % 5 = 0 THEN 'base' ELSE host END AS label,
  'Where is ' || host || '?' AS question, CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 4 = 0 THEN host ELSE 'default' END AS tools, 2 + 2 * (page_id % 4) + CASE WHEN path <> '' THEN 2 ELSE 1 END AS parts FROM x""")
def prompt_parts(spark, sf_dir):
    """Pages as prompts: paths put below another root, templates filled, stems cut, tools chosen, and a paged prompt built."""
    p = F.col("page_id")
    host, path = F.regexp_extract("url", r"://([^/?#]*)", 1), F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1)
    place = F.when(p % 3 == 0, F.concat(F.lit("/old/root"), path)).when(p % 3 == 1, F.concat(F.lit("/elsewhere"), path)).otherwise(host)
    filled = prompts.split_template(F.concat(F.lit("Read {context} of "), host, F.lit(" now: {input}")), path)
    asked = F.concat(F.lit("Where is "), host, F.lit("?  The special magic number for "), p.cast("string"), F.lit(" mentioned in the provided text is "))
    folder = F.when(p % 5 == 0, "runs/results/").otherwise(F.concat(F.lit("runs/results_"), host, F.lit("/")))
    own = F.when(p % 4 == 0, F.array(host)).otherwise(F.array().cast("array<string>"))
    tools = prompts.tools_of(own, F.when(p % 7 == 0, False), F.array(F.lit("default")))
    pages = F.transform(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda i: i <= p % 4), lambda i: i.cast("string"))
    paged = prompts.paged_prompt(pages, F.lit("Read"), path)
    rows = table(spark, sf_dir, "pages").where("url IS NOT NULL")
    return rows.select(
        "page_id", prompts.rooted(place, "/new", "/old/root").alias("rooted"), filled["head"].alias("head"), filled["tail"].alias("tail"), prompts.run_label(folder, "base").alias("label"),
        prompts.without_number_stem(asked).alias("question"), F.array_join(tools, ",").alias("tools"), F.size(paged).cast("long").alias("parts"),
    )


@query(r"""
WITH c AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS gold FROM conversations),
n AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(regexp_replace(translate(lower(text), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~‘’´', repeat(' ', 35)), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'), ' '), lambda x: x <> '') AS p,
  list_filter(string_split(regexp_replace(regexp_replace(translate(lower(gold), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~‘’´', repeat(' ', 35)), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'), ' '), lambda x: x <> '') AS g FROM c WHERE text IS NOT NULL AND gold IS NOT NULL AND length(text) + length(gold) < 1200 AND regexp_full_match(text || gold, '[\x00-\x7F]*')),
o AS (SELECT *, list_sum(list_transform(list_distinct(list_intersect(p, g)), lambda w: least(len(list_filter(p, lambda x: x = w)), len(list_filter(g, lambda x: x = w))))) AS n FROM n)
SELECT conv_id, turn, round(CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE 2.0 * n / (len(p) + len(g)) END, 9) AS f1, round(CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE n / len(p) END, 9) AS precision, round(CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE n / len(g) END, 9) AS recall,
  round(CASE WHEN len(g) = 0 THEN 0 ELSE len(list_intersect(list_distinct(p), list_distinct(g))) / len(list_distinct(g)) END, 9) AS overlap FROM o""")
def agent_scores(spark, sf_dir):
    """Each turn against the next by agent F1 and the overlap of their different words. Folds are for answers: pairs of
    up to 1200 characters, in ASCII, whose words SQL cuts alike."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("gold", F.lead("text").over(w))
    both = F.concat("text", "gold")
    c = c.where((F.length(both) < 1200) & both.rlike(r"\A[\x00-\x7F]*\z"))
    f = text.agent_f1(F.col("text"), F.col("gold"))
    words = lambda x: text.tokens(text.normalize_agent_answer(x))
    rows = c.select("conv_id", "turn", f.alias("f"), text.token_set_overlap(words(F.col("text")), words(F.col("gold"))).alias("o"))
    return rows.select("conv_id", "turn", *[F.round(f"f.{k}", 9).alias(k) for k in ("f1", "precision", "recall")], F.round("o", 9).alias("overlap"))


# --- places and arithmetic of training ---


@query("""
WITH d AS (SELECT doc_id, list_transform(string_split(left(coalesce(text, ''), 400), ' '), lambda w: length(w)) AS x FROM documents),
p AS (SELECT doc_id, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i, len(x) AS n FROM d),
m AS (SELECT *, CASE WHEN v % 3 > 0 THEN 1 ELSE 0 END AS m FROM p), c AS (SELECT *, sum(m) OVER (PARTITION BY doc_id ORDER BY i) AS run, min(CASE WHEN v = 4 THEN i END) OVER (PARTITION BY doc_id) AS stop FROM m)
SELECT doc_id, CAST(sum((i + 1) * greatest(run - 1, 0)) AS BIGINT) AS by_count, CAST(sum((i + 1) * i * m) AS BIGINT) AS by_index, CAST(sum(CASE WHEN i <= coalesce(stop, n) THEN 1 ELSE 0 END) AS BIGINT) AS valid, CAST(coalesce(sum(v) FILTER (m <> 0), 0) AS BIGINT) AS unpadded,
  CAST((n + 63) // 64 * 64 AS BIGINT) AS multiple, CAST(coalesce(sum(v) FILTER (i >= n - n // 2), 0) AS BIGINT) AS responded, CAST(sum(CASE WHEN i > 0 AND m = 1 THEN v ELSE -100 END) AS BIGINT) AS labels, CAST(sum(CASE WHEN v = 7 THEN 7 * 3 ELSE v END) AS BIGINT) AS expanded FROM c GROUP BY doc_id, n""")
def token_places(spark, sf_dir):
    """Lengths of the words that open a document as ids: positions by count and index, masks, labels and expansion.
    The arrays stand for a sample's window; the running count is quadratic in it."""
    x = F.transform(F.split(F.substring(F.coalesce("text", F.lit("")), 1, 400), " "), lambda w: F.length(w))
    rows = table(spark, sf_dir, "documents").select("doc_id", x.alias("x")).withColumn("m", F.transform("x", lambda v: (v % 3 > 0).cast("int")))
    at = lambda xs: F.aggregate(F.transform(xs, lambda v, i: (i + 1).cast("long") * v), F.lit(0).cast("long"), lambda a, v: a + v)
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, v: a + v)
    n = F.size("x")
    labels = messages.packed_labels(messages.labels_without(F.col("x"), F.transform("m", lambda v: v == 1)), F.array(F.lit(0)))
    media = F.transform(F.filter("x", lambda v: v == 7), lambda v: F.lit(3))
    return rows.select(
        "doc_id", at(messages.positions_by_count(F.col("m"))).alias("by_count"), at(messages.positions_by_index(F.col("m"))).alias("by_index"), total(messages.until_first(F.col("x"), 4)).alias("valid"),
        total(messages.unpadded(F.col("x"), F.col("m"))).alias("unpadded"), messages.multiple(n, 64).cast("long").alias("multiple"), total(messages.response_mask(F.lit(None).cast("array<int>"), F.col("x"), F.floor(n / 2).cast("int"))).alias("responded"),
        total(labels).alias("labels"), total(messages.expanded_media(F.col("x"), 7, media)).alias("expanded"),
    )


@query("""
WITH p AS (SELECT doc_id // 10 AS pack, doc_id % 10 AS i, coalesce(n_chars, 0) % 50 AS n FROM documents), o AS (SELECT *, sum(n) OVER (PARTITION BY pack ORDER BY i) AS e FROM p)
SELECT pack, '0,' || string_agg(CAST(e AS BIGINT), ',' ORDER BY i) AS offsets, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum((e * (e + 1) - (e - n) * (e - n + 1)) / 2 * (k - 1)) AS BIGINT) AS members FROM (SELECT *, row_number() OVER (PARTITION BY pack ORDER BY i) AS k FROM o) GROUP BY pack""")
def pack_places(spark, sf_dir):
    """Packs of ten documents: offsets of their samples and the sample of each token."""
    held = table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 10).alias("pack")).agg(F.array_sort(F.collect_list(F.struct((F.col("doc_id") % 10).alias("i"), (F.coalesce("n_chars", F.lit(0)) % 50).alias("n")))).alias("x"))
    rows = held.select("pack", F.transform("x", lambda v: v["n"].cast("long")).alias("n"))
    members = F.aggregate(F.transform(positions.pack_members(F.col("n")), lambda k, i: (i + 1).cast("long") * k), F.lit(0).cast("long"), lambda a, v: a + v)
    offsets = positions.pack_offsets(F.col("n"))
    return rows.select("pack", F.array_join(F.transform(offsets, lambda v: v.cast("string")), ",").alias("offsets"), F.element_at(offsets, -1).alias("tokens"), members.alias("members"))


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, label FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
s AS (SELECT *, list_max(v) AS top FROM e), t AS (SELECT *, list_sum(list_transform(v, lambda x: exp(x - top))) AS z FROM s)
SELECT vec_id, round(ln(z) + top - list_sum(list_transform(v, lambda x: x * exp(x - top))) / z, 6) AS entropy, round(0.5 * greatest(pow(v[1] - v[3], 2), pow(least(greatest(v[1], v[2] - 0.1), v[2] + 0.1) - v[3], 2)), 6) AS value_loss,
  round(least(-(length(CAST(vec_id AS VARCHAR)) * 10 - (30.0 - 12)) / 12 * 0.5, 0), 6) AS penalty FROM t""")
def policy_terms(spark, sf_dir):
    """Embeddings as logits: their entropy, a clipped value loss of three components, and a penalty on length."""
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v")).where((F.size("v") == 64) & F.coalesce(good, F.lit(False)))
    v = F.col("v")
    long = F.length(F.col("vec_id").cast("string")) * 10
    return rows.select(
        "vec_id", F.round(advantage.entropy_of(v), 6).alias("entropy"), F.round(advantage.clipped_value_loss(v[0], v[1], v[2], 0.1), 6).alias("value_loss"),
        F.round(advantage.overlong_penalty(long, F.lit(30.0), F.lit(12), 0.5), 6).alias("penalty"),
    )


@query("""
WITH RECURSIVE k AS (SELECT client_id, row_number() OVER (PARTITION BY client_id ORDER BY sale_id) AS i, coalesce(total, 0) / 100 AS kl FROM sales WHERE client_id IS NOT NULL AND client_id > 20),
r AS (SELECT client_id, 1 AS i, CAST(0.2 * (1 + greatest(-0.2, least(0.2, kl / 0.6 - 1)) * 64 / 1000) AS DOUBLE) AS c FROM k WHERE i = 1 UNION ALL
  SELECT k.client_id, k.i, r.c * (1 + greatest(-0.2, least(0.2, k.kl / 0.6 - 1)) * 64 / 1000) FROM r JOIN k ON k.client_id = r.client_id AND k.i = r.i + 1)
SELECT client_id, round(arg_max(c, i), 6) AS coefficient, count(*) AS steps FROM r GROUP BY client_id""")
def adaptive_kl(spark, sf_dir):
    """The adaptive coefficient after each client's sales in turn; clients with less than a controller's run of steps."""
    held = table(spark, sf_dir, "sales").where("client_id > 20").groupBy("client_id").agg(F.array_sort(F.collect_list(F.struct("sale_id", (F.coalesce("total", F.lit(0.0)) / 100).alias("kl")))).alias("x"))
    kls = F.transform("x", lambda v: v["kl"])
    return held.select("client_id", F.round(advantage.adaptive_coefficient(F.lit(0.2), kls, 0.6, 1000, 64), 6).alias("coefficient"), F.size("x").cast("long").alias("steps"))


@query("""
WITH l AS (SELECT vendor_id % 30 * 30 AS x, quantity * 15 AS y, 20 + line_no * 60 AS w, 30 + item_id % 400 AS h, sale_id, line_no, amount FROM sale_lines WHERE vendor_id IS NOT NULL AND quantity IS NOT NULL AND item_id IS NOT NULL AND sale_id IS NOT NULL AND line_no IS NOT NULL)
SELECT sale_id, line_no, CAST(greatest(0, floor(x - w * 0.05)) AS BIGINT) AS x0, CAST(greatest(0, floor(y - h * 0.05)) AS BIGINT) AS y0, CAST(least(1200, ceil(x + w + w * 0.05)) AS BIGINT) AS x1, CAST(least(900, ceil(y + h + h * 0.05)) AS BIGINT) AS y1,
  CAST(greatest(w, ceil(h * 30 / 199)) AS BIGINT) AS wide, CAST(greatest(h * 30, ceil(w / 199)) AS BIGINT) AS high FROM l""")
def padded_crops(spark, sf_dir):
    """Sale lines as boxes on a page: crops with a margin, and sides that keep the aspect ratio allowed."""
    rows = table(spark, sf_dir, "sale_lines").where("vendor_id IS NOT NULL AND quantity IS NOT NULL AND item_id IS NOT NULL AND sale_id IS NOT NULL AND line_no IS NOT NULL")
    x, y, w, h = F.col("vendor_id") % 30 * 30, F.col("quantity") * 15, 20 + F.col("line_no") * 60, 30 + F.col("item_id") % 400
    crop = geometry.padded_crop(F.array(*[c.cast("double") for c in (x, y, x + w, y + h)]), F.lit(1200), F.lit(900))
    wide = geometry.aspect_padded(w, h * 30)
    return rows.select("sale_id", "line_no", *[crop[i].cast("long").alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))], wide["width"].cast("long").alias("wide"), wide["height"].cast("long").alias("high"))


@query("""
WITH m AS (SELECT coalesce(kind, 'none') AS metric, value, length(props) AS n FROM clicks)
SELECT metric, round(avg(value), 6) AS value, round(avg(CASE WHEN isfinite(value) THEN value END), 6) AS finite, 2 AS of FROM m GROUP BY metric
UNION ALL SELECT 'all', round(avg(v), 6), round(avg(v), 6), count(*) FROM (SELECT avg(value) AS v FROM m GROUP BY metric)""")
def metric_means(spark, sf_dir):
    """Means by metric, of numbers alone, and over metrics with whether all are there."""
    rows = table(spark, sf_dir, "clicks").select(F.coalesce("kind", F.lit("none")).alias("metric"), "value")
    per = measures.mean_by_metric(rows)
    finite = rows.groupBy("metric").agg(F.round(scoring.finite_mean(F.col("value")), 6).alias("finite"))
    one = per.join(finite, "metric").select("metric", F.round("value", 6).alias("value"), "finite", F.lit(2).cast("long").alias("of"))
    whole = rollup.overall(per.withColumnRenamed("value", "score"), 6).select(F.lit("all").alias("metric"), F.round("score", 6).alias("value"), F.round("score", 6).alias("finite"), F.col("tasks").alias("of"))
    return one.unionByName(whole)


@query("""
WITH RECURSIVE n AS (SELECT source, doc_id, coalesce(n_chars, 0) AS n, row_number() OVER (PARTITION BY source, doc_id // 200 ORDER BY doc_id) AS i, doc_id // 200 AS b FROM documents WHERE source IS NOT NULL),
r AS (SELECT source, b, CAST(0 AS BIGINT) AS i, [0, 0, 0]::BIGINT[] AS s, CAST('' AS VARCHAR) AS out FROM n WHERE i = 1 UNION ALL
  SELECT n.source, n.b, n.i, [CASE WHEN list_position(s, list_min(s)) = 1 THEN s[1] + n.n ELSE s[1] END, CASE WHEN list_position(s, list_min(s)) = 2 THEN s[2] + n.n ELSE s[2] END, CASE WHEN list_position(s, list_min(s)) = 3 THEN s[3] + n.n ELSE s[3] END],
  out || (list_position(s, list_min(s)) - 1) FROM r JOIN n ON n.source = r.source AND n.b = r.b AND n.i = r.i + 1)
SELECT source, b AS batch, arg_max(out, i) AS parts FROM r GROUP BY ALL""")
def greedy_parts(spark, sf_dir):
    """Batches of a source's documents dealt in turn to the least loaded of three parts."""
    held = table(spark, sf_dir, "documents").where("source IS NOT NULL").groupBy("source", F.floor(F.col("doc_id") / 200).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("doc_id", F.coalesce("n_chars", F.lit(0)).cast("long").alias("n")))).alias("x"))
    parts = sequences.greedy_parts(F.transform("x", lambda v: v["n"]), 3)
    return held.select("source", "batch", F.array_join(F.transform(parts, lambda p: p.cast("string")), "").alias("parts"))
