"""Queries of the score layer: row metrics, rollups, reports, compaction and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import geometry, messages, text
from vellum.operators import rollup, tables
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


#: User turns and the assistant turns that follow them, as gold and prediction.
PAIRS = """
pairs AS (
  SELECT conv_id, turn, text AS pred, gold FROM (
    SELECT conv_id, turn, role, text, lag(text) OVER w AS gold, lag(role) OVER w AS before
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'assistant' AND before = 'user'
)"""
TOKENS = "list_filter(regexp_split_to_array(translate(lower({0}), '{1}', ''), '\\s+'), lambda t: t NOT IN ('', 'a', 'an', 'the'))".replace("{1}", text.PUNCTUATION.replace("'", "''"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumns({"gold": F.lag("text").over(w), "before": F.lag("role").over(w)})
    return rows.where("role = 'assistant' AND before = 'user'").select("conv_id", "turn", F.col("text").alias("pred"), "gold")


@query("SELECT count(*) AS duplicates FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)")
def manifest_unique_ids(spark, sf_dir):
    return tables.duplicate_keys(table(spark, sf_dir, "documents"), "doc_id").agg(F.count("*").alias("duplicates"))


@query("""
SELECT user_id, event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def compact_last_write(spark, sf_dir):
    return tables.last_per_key(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, sf_dir):
    return tables.unfinished(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id", "source", "n_chars")


@query(f"""
WITH {PAIRS}, t AS (
  SELECT conv_id, turn, {TOKENS.replace('{0}', 'pred')} AS p, {TOKENS.replace('{0}', 'gold')} AS g FROM pairs
), pc AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(p) AS w FROM t) GROUP BY ALL),
gc AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(g) AS w FROM t) GROUP BY ALL),
o AS (SELECT conv_id, turn, sum(least(pc.n, gc.n)) AS o FROM pc JOIN gc USING (conv_id, turn, w) GROUP BY ALL)
SELECT turn, count(*) AS n, round(avg(coalesce(2.0 * o / (len(p) + len(g)), 0)), 6) AS f1
FROM t LEFT JOIN o USING (conv_id, turn) GROUP BY turn""")
def token_f1_pairs(spark, sf_dir):
    """The flagship: prediction and gold tokens as counts, met by an equi-join, so that long texts cost no more than their length."""
    rows = pairs(spark, sf_dir)
    split = lambda c: text.tokens(text.normalize_answer(F.col(c)))
    scored = tables.overlap_f1(rows.select("conv_id", "turn", split("pred").alias("p"), split("gold").alias("g")), ["conv_id", "turn"])
    return scored.groupBy("turn").agg(F.count("*").alias("n"), F.round(F.avg("f1"), 6).alias("f1"))


@query("""
WITH b AS (SELECT list(w ORDER BY w) AS golds FROM (SELECT DISTINCT split_part(lower(text), ' ', 2) AS w FROM benchmark) WHERE w <> '')
SELECT doc_id, round(len(list_filter(golds, lambda g: contains(lower(text), g))) / len(golds), 6) AS recall,
  CAST(list_bool_or(list_transform(golds, lambda g: contains(lower(text), g))) AS DOUBLE) AS any_hit
FROM documents, b""")
def substring_recall(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.split_part(F.lower("text"), F.lit(" "), F.lit(2)).alias("w")).where("w <> ''")
    golds = words.agg(F.sort_array(F.collect_set("w")).alias("golds"))
    rows = table(spark, sf_dir, "documents").join(F.broadcast(golds))
    c = F.col("golds")
    # both measures of the same hits
    rows = rows.select("doc_id", text.let(text.substring_hits(F.col("text"), c), lambda hits: F.struct(F.try_divide(F.size(F.filter(hits, lambda h: h)), F.size(hits)).alias("recall"), F.exists(hits, lambda h: h).alias("any"))).alias("x"))
    return rows.select("doc_id", F.round("x.recall", 6).alias("recall"), F.col("x.any").cast("double").alias("any_hit"))


@query("""
WITH g AS (SELECT conv_id, list(text ORDER BY turn) AS golds FROM conversations WHERE role = 'user' GROUP BY conv_id),
p AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, CAST(len(golds) AS INT) AS n_golds,
  round(coalesce(list_max(list_transform(golds, lambda x: CASE WHEN contains(lower(text), lower(x)) THEN 1.0 ELSE round(1.0 / (1 + length(x)), 6) END)), 0), 6) AS best
FROM p JOIN g USING (conv_id)""")
def multi_gold_best(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    golds = turns.where("role = 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("g")))).alias("x"))
    golds = golds.select("conv_id", F.transform("x", lambda s: s["g"]).alias("golds"))
    metric = lambda p, g: F.when(F.contains(F.lower(p), F.lower(g)), F.lit(1.0)).otherwise(F.round(F.lit(1.0) / (F.length(g) + 1), 6))
    rows = turns.where("role = 'assistant'").join(golds, "conv_id")
    return rows.select("conv_id", "turn", F.size("golds").alias("n_golds"), F.round(text.best_of(F.col("text"), F.col("golds"), metric), 6).alias("best"))


@query("""
WITH RECURSIVE r AS (SELECT item_id, h, list_reverse(h) AS g FROM (SELECT item_id, string_split(lower(text), ' ') AS h FROM benchmark)),
d(item_id, g, h, i, row) AS (
  SELECT item_id, g, h, 0, list_transform(range(0, len(g) + 1), lambda x: CAST(x AS BIGINT)) FROM r
  UNION ALL
  SELECT item_id, g, h, i + 1, list_reduce(range(1, len(g) + 1), lambda acc, j: list_append(acc, least(acc[len(acc)] + 1, row[j + 1] + 1,
     row[j] + CASE WHEN g[j] = h[i + 1] THEN 0 ELSE 1 END)), [row[1] + 1])
  FROM d WHERE i < len(h))
SELECT item_id, CAST(row[len(row)] AS BIGINT) AS edits, round(row[len(row)] / len(g), 6) AS wer FROM d WHERE i = len(h)""")
def wer_hit(spark, sf_dir):
    """All words of each item against the same words in reverse."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.split(F.lower("text"), " ").alias("h"))
    rows = rows.withColumn("g", F.reverse("h"))
    edits = text.edit_distance(F.col("h"), F.col("g"))
    return rows.select("item_id", edits.cast("long").alias("edits"), F.round(text.word_error_rate(F.col("h"), F.col("g")), 6).alias("wer"))


@query()
def char_error_rate(spark, sf_dir):
    """Whole texts against the text without its first ten characters."""
    plain = text.squeeze(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", plain.alias("a"), F.substr(plain, F.lit(11)).alias("b"))
    return rows.select("doc_id", F.round(text.char_error_rate(F.col("a"), F.col("b")), 6).alias("cer"))


@query("""
SELECT doc_id, chr(CAST(65 + doc_id % 5 AS INT)) AS letter FROM documents""")
def mc_letter(spark, sf_dir):
    letter = F.char(65 + F.col("doc_id") % 5)
    said = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("So \\boxed{"), letter, F.lit("}."))).when(
        F.col("doc_id") % 3 == 1, F.concat(F.lit("**Answer**: "), letter, F.lit(" it is"))
    ).otherwise(F.concat(F.lit("i pick "), letter, F.lit(".")))
    return table(spark, sf_dir, "documents").select("doc_id", text.choice_letter(said).alias("letter"))


@query("""
WITH n AS (SELECT page_id, regexp_extract_all(url, '[0-9]+') AS xs FROM pages)
SELECT page_id, round(CASE WHEN len(xs) = 0 THEN 0 ELSE len(list_filter(xs, lambda x: x = CAST(page_id % 10 AS VARCHAR))) / len(xs) END, 6) AS hit_rate FROM n""")
def number_hit_rate(spark, sf_dir):
    rate = text.number_hit_rate(F.col("url"), (F.col("page_id") % 10).cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", F.round(rate, 6).alias("hit_rate"))


@query("""
WITH c AS (SELECT list(DISTINCT event_type) AS classes FROM events),
p AS (SELECT event_id, event_type, event_type || ' or ' || CASE WHEN event_id % 2 = 0 THEN 'click' ELSE 'view' END AS pred FROM events)
SELECT event_id, round(coalesce(CASE WHEN list_contains(m, event_type) THEN 1.0 / len(m) END, 0), 6) AS credit
FROM (SELECT event_id, event_type, list_filter(classes, lambda k: contains(pred, k) AND NOT (contains(event_type, k) AND k <> event_type)) AS m FROM p, c)""")
def classification_credit(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    classes = events.agg(F.collect_set("event_type").alias("classes"))
    rows = events.join(F.broadcast(classes))
    pred = F.concat(F.col("event_type"), F.lit(" or "), F.when(F.col("event_id") % 2 == 0, "click").otherwise("view"))
    return rows.select("event_id", F.round(text.classification_credit(pred, F.col("event_type"), F.col("classes")), 6).alias("credit"))


@query("""
SELECT l_orderkey, l_linenumber, l_linenumber AS page, l_partkey % 500 AS x0, l_suppkey % 400 AS y0,
  l_partkey % 500 + 100 AS x1, l_suppkey % 400 + 50 AS y1 FROM lineitem""")
def evidence_extract(spark, sf_dir):
    x, y = F.col("l_partkey") % 500, F.col("l_suppkey") % 400
    said = F.format_string("see Page %d <box>[%d, %d, %d, %d]</box>", "l_linenumber", x, y, x + 100, y + 50)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.inline(messages.evidence_boxes(said)))
    return rows.select("l_orderkey", "l_linenumber", F.col("page").cast("long").alias("page"), *[F.col(k).cast("long").alias(k) for k in ("x0", "y0", "x1", "y1")])


@query("""
WITH s AS (SELECT p_partkey, CAST(p_size * 37 AS DOUBLE) AS h, CAST(floor(p_retailprice) AS DOUBLE) AS w FROM part),
n AS (SELECT *, greatest(28, round_even(h / 28, 0) * 28) AS nh, greatest(28, round_even(w / 28, 0) * 28) AS nw FROM s),
f AS (SELECT *, CASE WHEN nh * nw > 602112 THEN greatest(28, floor(h / sqrt(h * w / 602112) / 28) * 28)
    WHEN nh * nw < 50176 THEN ceil(h * sqrt(50176 / (h * w)) / 28) * 28 ELSE nh END AS fh,
  CASE WHEN nh * nw > 602112 THEN greatest(28, floor(w / sqrt(h * w / 602112) / 28) * 28)
    WHEN nh * nw < 50176 THEN ceil(w * sqrt(50176 / (h * w)) / 28) * 28 ELSE nw END AS fw FROM n)
SELECT p_partkey, CAST(fh AS BIGINT) AS height, CAST(fw AS BIGINT) AS width, CAST(floor(fh * fw / 784) AS BIGINT) AS tokens,
  CAST(floor(h * w / 1024) AS BIGINT) AS area FROM f""")
def smart_resize_tokens(spark, sf_dir):
    h, w = (F.col("p_size") * 37).cast("double"), F.floor("p_retailprice").cast("double")
    size = geometry.smart_resize(F.col("h"), F.col("w"), 28, 50176, 602112)
    rows = table(spark, sf_dir, "part").select("p_partkey", h.alias("h"), w.alias("w")).withColumn("size", size)
    return rows.select("p_partkey", "size.height", "size.width", geometry.vision_tokens(F.col("size"), 28).alias("tokens"), geometry.area_tokens(F.col("h"), F.col("w"), 1024).alias("area"))


BOXES = """boxes AS (SELECT l_orderkey AS doc, l_linenumber AS k, l_orderkey % 7 AS page, CAST(l_partkey % 700 AS DOUBLE) AS x0, CAST(l_suppkey * 13 % 600 AS DOUBLE) AS y0,
  CAST(l_partkey % 700 + 50 + l_quantity AS DOUBLE) AS x1, CAST(l_suppkey * 13 % 600 + 90 AS DOUBLE) AS y1 FROM lineitem)"""


def boxes(spark, sf_dir):
    x, y = F.col("l_partkey") % 700, F.col("l_suppkey") * 13 % 600
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("k"), (F.col("l_orderkey") % 7).alias("page"),
        F.array(x.cast("double"), y.cast("double"), (x + 50 + F.col("l_quantity")).cast("double"), (y + 90).cast("double")).alias("box"),
    )


@query(f"""
WITH {BOXES}, m AS (
  SELECT a.doc, a.k, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i,
    (a.x1 - a.x0) * (a.y1 - a.y0) AS s, (b.x1 - b.x0) * (b.y1 - b.y0) AS t
  FROM boxes a JOIN boxes b ON a.doc = b.doc AND a.k <> b.k)
SELECT doc, k, round(max(i / (s + t - i)), 9) AS best_iou FROM m GROUP BY doc, k""")
def iou_best_per_page(spark, sf_dir):
    a = boxes(spark, sf_dir)
    b = a.select(F.col("doc"), F.col("k").alias("other"), F.col("box").alias("box_b"))
    met = a.join(b, "doc").where("k <> other")
    return met.groupBy("doc", "k").agg(F.round(F.max(geometry.iou(F.col("box"), F.col("box_b"))), 9).alias("best_iou"))


@query(f"""
WITH {BOXES}, g AS (SELECT l_orderkey AS doc, l_linenumber AS ch, CAST(l_partkey % 800 AS DOUBLE) AS cx, CAST(l_suppkey * 7 % 700 AS DOUBLE) AS cy FROM lineitem)
SELECT boxes.doc, k, count(*) AS glyphs, min(cx) - 2 AS x0, min(cy) - 2 AS y0, max(cx) + 2 AS x1, max(cy) + 2 AS y1
FROM boxes JOIN g ON boxes.doc = g.doc AND cx BETWEEN x0 AND x1 AND cy BETWEEN y0 AND y1 GROUP BY boxes.doc, k""")
def glyph_containment(spark, sf_dir):
    glyphs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_partkey") % 800).cast("double").alias("cx"), (F.col("l_suppkey") * 7 % 700).cast("double").alias("cy"))
    return tables.contained(boxes(spark, sf_dir), glyphs, ["doc"], ["doc", "k"], padding=2)


@query("""
WITH m AS (SELECT DISTINCT doc_id % 50 AS doc, doc_id // 50 % 6 + 1 AS old_page, n_chars % 9 + 1 AS new_page FROM documents)
SELECT doc, old_page, list_sort(list(new_page)) AS new_pages FROM m GROUP BY doc, old_page""")
def page_map(spark, sf_dir):
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select((d % 50).alias("doc"), (F.floor(d / 50) % 6 + 1).alias("old_page"), (F.col("n_chars") % 9 + 1).alias("new_page"))
    return tables.page_map(rows, ["doc"])


@query("""
WITH s AS (SELECT lang, source, doc_id, 100.0 * coalesce(quality, 0) AS score, n_chars FROM documents LEFT JOIN labels USING (doc_id)),
t AS (SELECT lang, source, count(*) AS n, round_even(avg(score), 2) AS score, round_even(avg(nullif(n_chars, 0)), 0) AS mean_chars, max(n_chars) AS max_chars FROM s GROUP BY ALL)
SELECT lang, count(*) AS tasks, sum(n) AS n, round_even(avg(score), 2) AS score, max(max_chars) AS max_chars FROM t GROUP BY lang""")
def score_rollup_two_level(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = rows.withColumn("score", F.coalesce("quality", F.lit(0)) * 100.0)
    tasks = rollup.per_task(rows, ["lang", "source"], "score", {"chars": "n_chars"})
    return rollup.macro(tasks, ["lang"]).withColumnRenamed("max_of_chars", "max_chars")


@query("""
SELECT lang, source, count(*) AS requested, count(*) FILTER (n_chars > 500) AS generated,
  round_even(100.0 * count(*) FILTER (n_chars > 500) / count(*), 2) AS coverage_pct
FROM documents GROUP BY GROUPING SETS ((), (lang, source))""")
def grouping_sets_report(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("generated", F.col("n_chars") > 500)
    return rollup.overall_and_by(rows, ["lang", "source"], {
        "requested": F.count("*"), "generated": F.count_if("generated"),
        "coverage_pct": F.bround(F.count_if("generated") * 100.0 / F.count("*"), 2)})


@query("""
SELECT source, round(avg(n_chars) FILTER (lang = 'de'), 4) AS de, round(avg(n_chars) FILTER (lang = 'en'), 4) AS en,
  round(avg(n_chars) FILTER (lang = 'es'), 4) AS es, round(avg(n_chars) FILTER (lang = 'fr'), 4) AS fr FROM documents GROUP BY source""")
def run_pivot(spark, sf_dir):
    return rollup.report(table(spark, sf_dir, "documents"), "source", "lang", ["de", "en", "es", "fr"], F.round(F.avg("n_chars"), 4))


@query("""
WITH b AS (SELECT source, doc_id // 100 AS block, median(n_chars) AS mid FROM documents GROUP BY ALL)
SELECT source, block, CAST(mid AS DOUBLE) AS mid, row_number() OVER (PARTITION BY source ORDER BY mid, block) AS bin FROM b""")
def block_median_bins(spark, sf_dir):
    return rollup.median_bins(table(spark, sf_dir, "documents"), ["source"], "doc_id", "n_chars", 100)


@query("""
WITH b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 1 - quality WHEN doc_id % 7 = 0 THEN NULL ELSE quality END AS quality FROM labels WHERE doc_id % 11 > 0
  UNION ALL SELECT doc_id, 1 FROM documents WHERE doc_id % 13 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels))
SELECT count(*) AS n, count(*) FILTER (a.quality IS DISTINCT FROM b.quality) AS conflicts FROM labels a FULL JOIN b ON a.doc_id = b.doc_id""")
def union_conflict_check(spark, sf_dir):
    d, labels = F.col("doc_id"), table(spark, sf_dir, "labels")
    changed = F.when(d % 5 == 0, 1 - F.col("quality")).when(d % 7 == 0, F.lit(None)).otherwise(F.col("quality"))
    more = table(spark, sf_dir, "documents").where(d % 13 == 0).join(labels, "doc_id", "left_anti").select("doc_id", F.lit(1).alias("quality"))
    other = labels.where(d % 11 > 0).select("doc_id", changed.alias("quality")).unionByName(more)
    return tables.union_conflicts(labels, other, "doc_id", ["quality"])


@query("""
WITH v AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_at FROM events GROUP BY ALL)
SELECT user_id, event_type AS winner, n AS votes FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_at) = 1""")
def maj_vote(spark, sf_dir):
    return rollup.majority(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query("""
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, round(sum(value * (pow(i / n, 4) - pow((i - 1) / n, 4))), 6) AS best_at_4,
  round(sum(value * (pow((n - i + 1) / n, 4) - pow((n - i) / n, 4))), 6) AS worst_at_4 FROM r GROUP BY user_id""")
def best_of_k_closed_form(spark, sf_dir):
    return rollup.best_of_k(table(spark, sf_dir, "events"), ["user_id"], "value", 4)


@query("""
SELECT source, round(avg(m), 6) AS score FROM (
  SELECT source, doc_id, avg(v) AS m FROM (SELECT source, doc_id, unnest([n_chars % 7, n_chars % 5, n_chars % 3]) AS v FROM documents) GROUP BY ALL) GROUP BY source""")
def mean_of_responses(spark, sf_dir):
    n = F.col("n_chars")
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.explode(F.array(n % 7, n % 5, n % 3)).alias("v"))
    return rows.groupBy("source", "doc_id").agg(F.avg("v").alias("m")).groupBy("source").agg(F.round(F.avg("m"), 6).alias("score"))


@query("""
SELECT e.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN l.quality = 0 THEN 'empty' END AS problem
FROM documents e LEFT JOIN labels l ON e.doc_id = l.doc_id WHERE l.doc_id IS NULL OR l.quality = 0""")
def completeness_problems(spark, sf_dir):
    found = table(spark, sf_dir, "labels").withColumn("there", F.lit(True))
    rows = table(spark, sf_dir, "documents").select("doc_id").join(found, "doc_id", "left")
    problem = F.when(F.col("there").isNull(), "missing").when(F.col("quality") == 0, "empty")
    return rows.select("doc_id", problem.alias("problem")).where("problem IS NOT NULL")


@query("""
WITH d AS (SELECT lang, idx, count(DISTINCT pt) AS pts FROM (SELECT lang, doc_id // 20 AS idx, doc_id % 4 AS pt FROM documents) GROUP BY ALL)
SELECT lang, count(*) AS common FROM d WHERE pts = 4 GROUP BY lang""")
def common_points(spark, sf_dir):
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("lang", F.floor(d / 20).alias("idx"), (d % 4).alias("pt"))
    whole = tables.keys_with_all(rows, ["lang", "idx"], "pt", 4)
    return rows.join(whole, ["lang", "idx"], "left_semi").select("lang", "idx").distinct().groupBy("lang").agg(F.count("*").alias("common"))


@query("""
WITH c AS (SELECT source, doc_id // 50 % 10 + 6 AS pt, avg(n_chars % 100 / 100.0) AS m FROM documents GROUP BY ALL),
n AS (SELECT *, lead(pt) OVER w AS pt2, lead(m) OVER w AS m2 FROM c WINDOW w AS (PARTITION BY source ORDER BY pt)),
x AS (SELECT source, exp(ln(pt) + (0.5 - m) / (m2 - m) * (ln(pt2) - ln(pt))) AS cross_at, pt FROM n WHERE (m - 0.5) * (m2 - 0.5) <= 0 AND m <> m2)
SELECT source, round(cross_at, 6) AS threshold FROM x QUALIFY row_number() OVER (PARTITION BY source ORDER BY pt) = 1""")
def threshold_crossing(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", (F.floor(F.col("doc_id") / 50) % 10 + 6).alias("pt"), (F.col("n_chars") % 100 / 100.0).alias("v"))
    curve = rows.groupBy("source", "pt").agg(F.avg("v").alias("m"))
    return rollup.first_crossing(curve, ["source"], "pt", "m", 0.5)
