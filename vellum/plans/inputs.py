"""Queries of what comes in: scans of mixed sources, rows dropped and counted, rows of unknown shape, places and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import geometry, positions, samples, text
from vellum.operators import drops, ranks, streams
from vellum.session import staged, table
from vellum.sources import datasets

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


@query("""
WITH r AS (SELECT 'clicks' AS file, client_id, NULL AS user_id, kind, props FROM clicks UNION ALL SELECT 'events', NULL, user_id, NULL, props FROM events)
SELECT file, count(*) AS n, count(DISTINCT coalesce(client_id, user_id)) AS who, CAST(sum(length(props)) AS BIGINT) AS chars FROM r
WHERE (kind IS NULL OR kind IN ('error', 'view')) AND (client_id >= 5 OR user_id > 40) GROUP BY file""")
def dataset_scan(spark, sf_dir):
    """Two tables as one mix, with the filters inside the scan."""
    sources = [{"path": f"{sf_dir}/{t}.parquet", "data_type": "parquet", "data_folder": t} for t in ("clicks", "events")]
    rows = datasets.mix(spark, sources, "client_id long, user_id long, kind string, props string", split=16 << 20).where(datasets.readable())
    kept = rows.where("(kind IS NULL OR kind IN ('error', 'view')) AND (client_id >= 5 OR user_id > 40)")
    return kept.groupBy(F.col("data_folder").alias("file")).agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("client_id", "user_id")).alias("who"), F.sum(F.length("props")).alias("chars"))


FIT = """CASE WHEN {h} * {w} > {most} THEN {down} WHEN {h} * {w} < {least} THEN {up} ELSE {plain} END"""


def refitted_sql(height: str, width: str, factor: int, least: int, most: int, fetched: bool) -> tuple[str, str]:
    """geometry.refitted in SQL."""
    rounded = lambda x: f"greatest({factor}, round_even({x} / {factor}, 0) * {factor})" if fetched else f"(round_even({x} / {factor}, 0) * {factor})"
    h, w = rounded(height), rounded(width)

    def side(x: str, plain: str) -> str:
        down = f"floor({x} / sqrt({height} * {width} / {most}) / {factor}) * {factor}"
        down = down if fetched else f"greatest({factor}, {down})"
        up = f"ceil({x} * sqrt({float(least)} / ({height} * {width})) / {factor}) * {factor}"
        return "CAST(" + FIT.format(h=h, w=w, most=most, least=least, down=down, up=up, plain=plain) + " AS BIGINT)"

    return side(height, h), side(width, w)


#: An image processor: patch, merge, least and most pixels.
PROCESSOR = (16, 2, 65_536, 16_777_216)
PAGES = "SELECT page_id, html, length(url) * length(url) % 5000 AS height, (length(html) * 7 + 13) % 9000 + 1 AS width FROM pages"
HEADERS = f"""p AS ({PAGES}), a AS (SELECT *, CASE WHEN height <= 0 THEN 'size' WHEN greatest(height, width) / least(height, width) > 200 THEN 'aspect' END AS bad FROM p),
b AS (SELECT *, {refitted_sql("height", "width", 28, 4 * 28**2, 16384 * 28**2, True)[0]} AS h, {refitted_sql("height", "width", 28, 4 * 28**2, 16384 * 28**2, True)[1]} AS w FROM a WHERE bad IS NULL),
c AS (SELECT *, {refitted_sql("h", "w", 32, 65_536, 16_777_216, False)[0]} AS h2, {refitted_sql("h", "w", 32, 65_536, 16_777_216, False)[1]} AS w2 FROM b),
t AS (SELECT page_id, html, CASE WHEN greatest(h, w) / least(h, w) > 200 THEN 'aspect' END AS bad, (h2 // 32) * (w2 // 32) AS tokens FROM c UNION ALL SELECT page_id, html, bad, NULL FROM a WHERE bad IS NOT NULL)"""


def page_images(spark, sf_dir):
    """Pages with the size of an image each, from the lengths of their url and html, and its tokens."""
    url, html = F.length("url").cast("long"), F.length("html").cast("long")
    rows = table(spark, sf_dir, "pages").select("page_id", "html", (url * url % 5000).alias("height"), ((html * 7 + 13) % 9000 + 1).alias("width"))
    return rows.withColumn("image", geometry.header_tokens(F.col("height"), F.col("width"), *PROCESSOR))


@query(f"WITH {HEADERS} SELECT page_id, bad AS problem, CASE WHEN bad IS NULL THEN tokens END AS tokens FROM t")
def image_header_tokens(spark, sf_dir):
    return page_images(spark, sf_dir).select("page_id", "image.problem", "image.tokens")


@query(f"""
WITH {HEADERS}, r AS (SELECT CASE WHEN coalesce(html, '') = '' THEN 'no_text' WHEN bad IS NOT NULL THEN 'odd_image' WHEN tokens + length(html) // 3 > 4000 THEN 'overlong' END AS reason FROM t)
SELECT 'prompts' AS stage, n.reason, CASE n.reason WHEN 'rows' THEN (SELECT count(*) FROM r) WHEN 'kept' THEN (SELECT count(*) FROM r WHERE reason IS NULL) ELSE (SELECT count(*) FROM r WHERE r.reason = n.reason) END AS n
FROM (VALUES ('rows'), ('no_text'), ('odd_image'), ('overlong'), ('kept')) n(reason)""")
def overlong_dropped(spark, sf_dir):
    """Prompts of a text and an image that are too long by estimate, dropped in one pass over the pages, and the counts of that pass."""
    rows = page_images(spark, sf_dir)
    length = F.col("image.tokens") + F.floor(F.length("html") / 3)
    stage = drops.Drops("prompts", no_text=F.coalesce("html", F.lit("")) == "", odd_image=F.col("image.problem").isNotNull(), overlong=length > 4000)
    stage.kept(rows).write.format("noop").mode("overwrite").save()
    return drops.report(spark, [stage])


#: What the properties of a click should be.
CLICK = {
    "required": ["k", "device"],
    "properties": {
        "k": {"type": "integer"}, "tags": {"type": "array"}, "items": {"type": "array"},
        "device": {"type": "object", "required": ["os", "ver"], "properties": {"os": {"type": "string", "enum": ["android", "ios", "web"]}, "ver": {"type": "string"}}},
    },
}


@query("""
WITH j AS (SELECT click_id, CASE WHEN json_valid(props) THEN CAST(props AS JSON) END AS v FROM clicks),
t AS (SELECT click_id, json_type(v) AS o, json_type(v, '$.k') AS k, json_type(v, '$.device') AS d, json_type(v, '$.tags') AS g, json_type(v, '$.items') AS i, json_type(v, '$.device.os') AS os, json_type(v, '$.device.ver') AS ver,
  json_extract_string(v, '$.device.os') AS name FROM j),
p AS (SELECT click_id, CASE WHEN o IS DISTINCT FROM 'OBJECT' THEN [':not_object'] ELSE list_filter([
    CASE WHEN k IS NULL THEN 'k:missing' END, CASE WHEN d IS NULL THEN 'device:missing' END, CASE WHEN k NOT IN ('UBIGINT', 'BIGINT', 'BOOLEAN') THEN 'k:type' END,
    CASE WHEN g <> 'ARRAY' THEN 'tags:type' END, CASE WHEN i <> 'ARRAY' THEN 'items:type' END, CASE WHEN d <> 'OBJECT' THEN 'device:type' END,
    CASE WHEN d = 'OBJECT' AND os IS NULL THEN 'device.os:missing' END, CASE WHEN d = 'OBJECT' AND ver IS NULL THEN 'device.ver:missing' END,
    CASE WHEN os <> 'VARCHAR' THEN 'device.os:type' WHEN name NOT IN ('android', 'ios', 'web') THEN 'device.os:enum' END, CASE WHEN ver <> 'VARCHAR' THEN 'device.ver:type' END], lambda x: x IS NOT NULL) END AS p FROM t)
SELECT click_id, array_to_string(p, ' ') AS problems, len(p) = 0 AS valid FROM p""")
def argument_problems(spark, sf_dir):
    """Arguments of unknown shape against a schema with required, typed, enumerated and nested fields."""
    # parsed once, in a projection of its own
    parsed = table(spark, sf_dir, "clicks").select("click_id", F.try_parse_json("props").alias("v"))
    found = parsed.select("click_id", samples.problems(F.col("v"), CLICK).alias("p"))
    return found.select("click_id", F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["parameter"], x["problem"])), " ").alias("problems"), (F.size("p") == 0).alias("valid"))


@query(rf"""
WITH s AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, conv_id % 6 AS shape, conv_id % 5 AS n FROM conversations),
x AS (SELECT *, unnest(string_split(replace(text, '. ', '<image>'), '<image>')) AS piece, unnest(range(0, len(string_split(replace(text, '. ', '<image>'), '<image>')))) AS k FROM s WHERE shape IN (0, 1, 2)),
t AS (SELECT *, regexp_replace(piece, '{samples.EDGES}', '', 'g') AS said, sum(CASE WHEN k > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS tag FROM x),
parts AS (
  SELECT conv_id, turn, 2 * k AS k, CASE shape WHEN 2 THEN 'video' ELSE 'image' END AS type, 'm' || tag || '.png' AS v FROM t WHERE k > 0 AND tag < n
  UNION ALL SELECT conv_id, turn, 2 * k + 1, 'text', said FROM t WHERE said <> ''
  UNION ALL SELECT conv_id, 0, 0, 'image', 'c.png' FROM s WHERE shape = 3 AND turn = 0 UNION ALL SELECT conv_id, 1, 0, 'text', text FROM s WHERE shape = 3 AND turn = 0
  UNION ALL SELECT conv_id, turn, 0, 'text', text FROM s WHERE shape = 4 UNION ALL SELECT conv_id, turn, 1, 'audio', 'a' || turn FROM s WHERE shape = 4 AND turn % 2 = 0),
roles AS (SELECT conv_id, turn, CASE WHEN shape IN (0, 2) THEN CASE role WHEN 'user' THEN 'user' ELSE 'assistant' END ELSE role END AS role FROM s WHERE shape IN (0, 1, 2, 4)
  UNION ALL SELECT conv_id, u.turn, CASE u.turn WHEN 0 THEN 'user' ELSE 'assistant' END FROM s, (VALUES (0), (1)) u(turn) WHERE shape = 3 AND s.turn = 0),
r AS (SELECT conv_id, string_agg(role, ' ' ORDER BY turn) AS roles FROM roles GROUP BY conv_id),
p AS (SELECT conv_id, count(*) FILTER (type = 'text') AS texts, count(*) FILTER (type <> 'text') AS media, md5(string_agg(type || '=' || v, '|' ORDER BY turn, k)) AS digest FROM parts GROUP BY conv_id)
SELECT c.conv_id, CASE WHEN c.conv_id % 6 < 3 THEN 'conversations' WHEN c.conv_id % 6 = 3 THEN 'caption' WHEN c.conv_id % 6 = 4 THEN 'messages' END AS kind, r.roles, coalesce(texts, 0) AS texts, coalesce(media, 0) AS media, coalesce(digest, md5('')) AS digest
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN r USING (conv_id) LEFT JOIN p USING (conv_id)""")
def sample_shapes(spark, sf_dir):
    """Conversations as samples of six shapes in one VARIANT column, and what becomes of them."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    held = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    marked = lambda t: F.replace(t["text"], F.lit(". "), F.lit("<image>"))
    old = F.create_map(*[F.lit(x) for x in ("user", "human", "assistant", "gpt", "system", "system")])
    by_from = F.transform("t", lambda t: F.struct(F.element_at(old, t["role"]).alias("from"), marked(t).alias("value")))
    by_role = F.transform("t", lambda t: F.struct(t["role"].alias("role"), marked(t).alias("content")))
    n = F.col("conv_id") % 5
    urls = F.transform(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda i: i < n), lambda i: F.concat(F.lit("m"), i.cast("string"), F.lit(".png")))
    spoken = lambda t: F.struct(F.lit("text").alias("type"), t["text"].alias("text"), F.lit(None).cast("struct<url:string>").alias("audio_url"))
    heard = lambda t: F.struct(F.lit("audio_url").alias("type"), F.lit(None).cast("string").alias("text"), F.struct(F.concat(F.lit("a"), t["turn"].cast("string")).alias("url")).alias("audio_url"))
    typed = F.transform("t", lambda t: F.struct(t["role"].alias("role"), F.when(t["turn"] % 2 == 0, F.array(spoken(t), heard(t))).otherwise(F.array(spoken(t))).alias("content")))
    shapes = [
        F.struct(by_from.alias("conversations"), urls.alias("image")), F.struct(by_role.alias("conversations"), urls.alias("image")), F.struct(by_from.alias("conversations"), urls.alias("video")),
        F.struct(F.col("t")[0]["text"].alias("caption"), F.lit("c.png").alias("image")), F.struct(typed.alias("messages")), F.struct(F.lit(1).alias("other")),
    ]
    raw = F.coalesce(*[F.when(F.col("conv_id") % 6 == i, F.to_json(s)) for i, s in enumerate(shapes)])
    rows = held.select("conv_id", F.parse_json(raw).alias("v"))
    found = rows.select("conv_id", samples.sample_kind(F.col("v")).alias("kind"), samples.sample_messages(F.col("v")).alias("m"))
    parts = F.coalesce(F.flatten(F.transform("m", lambda m: m["content"])), F.array().cast(samples.TAKEN))
    found = found.select("conv_id", "kind", F.transform("m", lambda m: m["role"]).alias("roles"), parts.alias("p"))
    count = lambda is_text: F.size(F.filter("p", lambda p: (p["type"] == "text") == F.lit(is_text))).cast("long")
    said = F.array_join(F.transform("p", lambda p: F.concat(p["type"], F.lit("="), F.coalesce(p["url"], p["text"]))), "|")
    return found.select("conv_id", "kind", F.array_join("roles", " ").alias("roles"), count(True).alias("texts"), count(False).alias("media"), F.md5(said).alias("digest"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
s AS (SELECT doc_id, i, len(list_filter(string_split(line, ' '), lambda w: w <> '')) AS words, length(line) % 3 AS kind, 1 + length(line) % 4 AS h, 1 + length(line) % 5 AS w FROM l),
g AS (SELECT doc_id, i, unnest(CASE kind WHEN 0 THEN [0] WHEN 1 THEN [0, 1] ELSE [0, 2, 3, 4] END) AS part, words, h, w FROM s WHERE words > 0),
r AS (SELECT doc_id, i, part, CASE part WHEN 0 THEN words WHEN 3 THEN 1 ELSE h * w END AS n, part IN (0, 3) AS is_text, h, w, CASE part WHEN 0 THEN words WHEN 3 THEN 1 ELSE greatest(h, w) END AS adv FROM g),
a AS (SELECT *, sum(adv) OVER o - adv AS pos, sum(n) OVER o - n AS first FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY i, part)),
t AS (SELECT doc_id, first + j AS p, CASE WHEN is_text THEN pos + j ELSE pos END AS t, CASE WHEN is_text THEN pos + j ELSE pos + j // w END AS h, CASE WHEN is_text THEN pos + j ELSE pos + j % w END AS w FROM (SELECT *, unnest(range(0, n)) AS j FROM a))
SELECT d.doc_id, count(p) AS n, CAST(coalesce(sum((p + 1) * t), 0) AS BIGINT) AS t, CAST(coalesce(sum((p + 1) * h), 0) AS BIGINT) AS h, CAST(coalesce(sum((p + 1) * w), 0) AS BIGINT) AS w FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN t USING (doc_id) GROUP BY d.doc_id""")
def media_positions(spark, sf_dir):
    """Three-axis positions of the words of all documents, with an image, two frames of a video or nothing behind each line."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    words = lambda x: F.size(F.filter(F.split(x, " "), lambda w: w != ""))
    seen = F.filter(F.transform(lines, lambda x: F.struct(words(x).alias("n"), (F.length(x) % 3).alias("kind"), (1 + F.length(x) % 4).alias("h"), (1 + F.length(x) % 5).alias("w"))), lambda x: x["n"] > 0)
    rows = table(spark, sf_dir, "documents").select("doc_id", seen.alias("s"))
    many = lambda kind, n: F.array_repeat(F.lit(kind), n)
    frame = lambda x: many(positions.VIDEO, x["h"] * x["w"])
    media = lambda x: F.when(x["kind"] == 1, many(positions.IMAGE, x["h"] * x["w"])).when(x["kind"] == 2, F.concat(frame(x), many(positions.TEXT, F.lit(1)), frame(x))).otherwise(F.array().cast("array<int>"))
    kinds = F.flatten(F.transform("s", lambda x: F.concat(many(positions.TEXT, x["n"]), media(x))))
    grids = lambda kind, t: F.transform(F.filter("s", lambda x: x["kind"] == kind), lambda x: F.struct(F.lit(t).alias("t"), (2 * x["h"]).alias("h"), (2 * x["w"]).alias("w")))
    placed = rows.select("doc_id", positions.media_positions(kinds, grids(1, 1), grids(2, 2)).alias("p"))
    total = lambda axis: F.aggregate(F.transform("p", lambda x, i: (i + 1).cast("long") * x[axis]), F.lit(0).cast("long"), lambda a, x: a + x).alias(axis)
    return placed.select("doc_id", F.size("p").cast("long").alias("n"), total("t"), total("h"), total("w"))


@query("""
WITH d AS (SELECT doc_id, coalesce(n_chars, 0) AS n, row_number() OVER (ORDER BY coalesce(n_chars, 0) DESC, doc_id) - 1 AS pos FROM documents)
SELECT CAST(CASE WHEN pos // 7 % 2 = 0 THEN pos % 7 ELSE 6 - pos % 7 END AS INTEGER) AS rank, count(*) AS n, CAST(sum(n) AS BIGINT) AS total, min(doc_id) AS first, CAST(sum(doc_id) AS BIGINT) AS ids FROM d GROUP BY 1""")
def rebalanced_ranks(spark, sf_dir):
    """Documents dealt to seven ranks by equal work, each rank's in a partition of its own."""
    dealt = ranks.sent(ranks.rebalanced(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 7), 7)
    sums = dealt.groupBy(F.spark_partition_id().alias("rank")).agg(F.count("*").alias("n"), F.sum(F.coalesce("n_chars", F.lit(0))).alias("total"), F.min("doc_id").alias("first"), F.sum("doc_id").alias("ids"))
    return sums


@query("""
WITH d AS (SELECT doc_id, coalesce(n_chars, 0) AS n, row_number() OVER (ORDER BY md5('3:1:' || doc_id), doc_id) - 1 AS pos, count(*) OVER () AS total FROM documents),
s AS (SELECT *, greatest(least(total // 32, 50), 1) * 8 AS size FROM d),
g AS (SELECT *, pos // size AS g, pos // size * size + row_number() OVER (PARTITION BY pos // size ORDER BY n DESC, doc_id) - 1 AS p FROM s),
f AS (SELECT arg_min(p, struct_pack(n := -n, p := p)) AS far FROM g WHERE p = g * size),
x AS (SELECT doc_id, n, total, CASE WHEN p = 0 THEN far WHEN p = far THEN 0 ELSE p END AS p FROM g, f),
y AS (SELECT doc_id, p, total FROM x UNION ALL SELECT doc_id, p + total, total FROM x WHERE p < (3 - total % 3) % 3)
SELECT doc_id, CAST(p % 3 AS INTEGER) AS rank, p // 3 AS step FROM y""")
def length_grouped_steps(spark, sf_dir):
    """Documents dealt to three ranks in shuffled groups of like length."""
    found = ranks.length_grouped(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 8, 3, seed=3, epoch=1)
    return found.select("doc_id", "rank", "step")


@query("""
WITH c AS (SELECT conv_id * 1000 + turn AS k, replace(replace(coalesce(text, ''), chr(10), ''), ' ', '') AS s, turn % 5 AS odd FROM conversations),
t AS (SELECT k, s, CASE WHEN length(s) < 3 THEN s WHEN odd = 1 THEN left(s, length(s) // 2) || '#' || substr(s, length(s) // 2 + 2) WHEN odd = 2 THEN left(s, length(s) - 2) ELSE s END AS u FROM c)
SELECT k, length(s) AS n_source, length(u) AS n_target, s = u AS identical, CASE WHEN s <> u THEN CASE WHEN length(u) < length(s) THEN length(u) ELSE length(s) // 2 END END AS first_difference,
  CASE WHEN s = u THEN length(s) ELSE 0 END AS pairs, CASE WHEN s = u THEN len(list_distinct(list_transform(range(0, length(s)), lambda i: i // 70 * 1000 + i // 50))) ELSE 0 END AS page_pairs
FROM t WHERE length(s) > 0""")
def stream_pairs(spark, sf_dir):
    """Turns laid out on pages of two sizes, some with a character changed or missing: whether the streams of characters
    are the same, where they first differ, and the pairs of those that are."""
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("")), F.lit(" "), F.lit(""))
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), text.alias("s"), (F.col("turn") % 5).alias("odd")).where("s <> ''")
    n = F.length("s")
    half = F.floor(n / 2).cast("int")
    changed = F.when(n < 3, F.col("s")).when(F.col("odd") == 1, F.concat(F.substring("s", F.lit(1), half), F.lit("#"), F.substring("s", half + 2, n))).when(F.col("odd") == 2, F.substring("s", F.lit(1), n - 2)).otherwise(F.col("s"))
    glyphs = lambda s, per_page: rows.select("k", F.posexplode(F.split(s, "")).alias("i", "text")).select("k", F.floor(F.col("i") / per_page).alias("page"), (F.col("i") % per_page).alias("order"), "text")
    source, target = (staged(streams.letters(glyphs(s, per_page), "k", "page", "order", "text"), "letters") for s, per_page in ((F.col("s"), 70), (changed, 50)))
    found = streams.differences(source, target, "k", block=64)
    pairs = streams.paired(source, target, "k", found).groupBy("k").agg(F.count("*").alias("pairs"), F.count_distinct("source.page", "target.page").alias("page_pairs"))
    return found.join(pairs, "k", "left").select("k", "n_source", "n_target", "identical", "first_difference", F.coalesce("pairs", F.lit(0)).alias("pairs"), F.coalesce("page_pairs", F.lit(0)).alias("page_pairs"))


@query()
def masked_corruption(spark, sf_dir):
    """Documents' word lengths as ids, masked with a rate of each document's own; no SQL, as it has no such hash."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), " "), lambda w: F.length(w)).alias("ids"))
    special = F.transform("ids", lambda x: x == 0)
    found = rows.select("doc_id", "ids", positions.corrupted(F.col("ids"), F.col("doc_id"), 9999, special, 0.1, 0.9, seed=5).alias("c"))
    return found.select("doc_id", F.size("ids").alias("n"), F.size(F.filter("c.labels", lambda x: x != -100)).alias("masked"), F.round("c.rate", 6).alias("rate"))


@query("""
WITH s AS (SELECT sale_id, line_no, item_id, quantity, amount, row_number() OVER () AS r FROM sale_lines WHERE sale_id IS NOT NULL AND item_id IS NOT NULL AND quantity IS NOT NULL),
p AS (SELECT *, item_id % 5 AS shape, 1 + item_id % 7 AS page, quantity AS x, quantity * 2 AS y, quantity + 50 AS x2, quantity * 2 + 60 AS y2 FROM s)
SELECT sale_id, count(*) AS n, CAST(sum(CASE shape WHEN 4 THEN 0 WHEN 3 THEN 2 ELSE 1 END) AS BIGINT) AS places, CAST(sum(CASE WHEN shape = 4 THEN 0 WHEN shape = 3 THEN 2 * page + 1 ELSE page END) AS BIGINT) AS pages,
  CAST(sum(CASE shape WHEN 4 THEN 0 WHEN 3 THEN 2 * (x + y + x2 + y2) ELSE x + y + x2 + y2 END) AS DOUBLE) AS boxes FROM p GROUP BY sale_id""")
def evidence_layouts(spark, sf_dir):
    """Sale lines as evidence of five shapes in one VARIANT column: an object with a page, pages by name, arrays of five
    numbers, several resolutions with the highest empty, and nothing; the places that are found in each."""
    rows = table(spark, sf_dir, "sale_lines").where("sale_id IS NOT NULL AND item_id IS NOT NULL AND quantity IS NOT NULL")
    q, page = F.col("quantity"), (1 + F.col("item_id") % 7).cast("string")
    box = F.concat(F.lit("["), F.concat_ws(", ", *[c.cast("string") for c in (q, q * 2, q + 50, q * 2 + 60)]), F.lit("]"))
    more = (2 + F.col("item_id") % 7).cast("string")
    one = F.concat(F.lit('{"evidence_locations": [{"page_id": '), page, F.lit(', "bboxes": ['), box, F.lit(', [1, 2], "x"]}, 7]}'))
    named = F.concat(F.lit('{"evidence_bboxes_by_dpi": {"dpi_96": {"'), page, F.lit('": '), box, F.lit(', "x": [[1, 2, 3, 4]]}}}'))
    five = F.concat(F.lit('{"evidence_bboxes_by_dpi": {"72": [['), page, F.lit(", "), F.substring(box, F.lit(2), F.length(box)), F.lit("]}}"))
    several = F.concat(F.lit('{"evidence_bboxes_by_dpi": {"dpi144": {}, "dpi72": [], "dpi96": {"'), page, F.lit('": ['), box, F.lit('], "'), more, F.lit('": '), box, F.lit("}}}"))
    raw = F.element_at(F.array(one, named, five, several, F.lit('{"evidence_locations": {"page": null, "bbox": [1, 2, 3]}}')), (F.col("item_id") % 5 + 1).cast("int"))
    places = lambda v: samples.evidence_places(samples.field(v, "$.evidence_bboxes_by_dpi"), samples.field(v, "$.evidence_locations"))
    found = rows.select("sale_id", text.let(F.parse_json(raw), places).alias("p"))
    total = lambda f: F.aggregate("p", F.lit(0.0), lambda a, x: a + f(x))
    boxes = total(lambda x: F.aggregate(x["box"], F.lit(0.0), lambda a, b: a + b))
    return found.groupBy("sale_id").agg(F.count("*").alias("n"), F.sum(F.size("p")).alias("places"), F.sum(total(lambda x: x["page"].cast("double"))).cast("long").alias("pages"), F.sum(boxes).alias("boxes"))


@query("""
WITH p AS (SELECT page_id, url, length(html) % 4 AS mode, coalesce(html, '') AS html FROM pages WHERE url IS NOT NULL)
SELECT page_id, CAST(CASE mode WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 3 END AS INTEGER) AS mode, CASE mode WHEN 1 THEN url || ' data:image/png;base64,<omitted>' WHEN 3 THEN 'data:image/png;base64,<omitted>' ELSE '' END AS sources,
  list_extract(['one', 'two', 'three'], CAST(('0x' || substr(md5('5:' || page_id), 1, 8))::BIGINT % 3 + 1 AS INTEGER)) AS hint FROM p WHERE mode IS NOT NULL""")
def media_of_messages(spark, sf_dir):
    """Pages as messages with text, images by url and inside it, and audio: their mode, their sources as traces show them,
    and a hint drawn for each."""
    n = F.length("html") % 4
    inside = F.concat(F.lit("data:image/png;base64,"), F.base64(F.encode(F.substring("html", 1, 30), "UTF-8")))
    parts = F.filter(
        F.array(samples.part("text", F.col("html")), F.when(n == 1, samples.part("image", url=F.col("url"))), F.when(n.isin(1, 3), samples.part("image", url=inside)), F.when(n.isin(2, 3), samples.part("audio", url=F.lit("a.wav")))),
        lambda p: p.isNotNull(),
    )
    rows = table(spark, sf_dir, "pages").where("url IS NOT NULL AND html IS NOT NULL").select("page_id", F.array(F.struct(F.lit("user").alias("role"), parts.alias("content"))).alias("m"))
    sources = F.array_join(F.transform(samples.media_sources(F.col("m")), samples.traced), " ")
    return rows.select("page_id", samples.input_mode(F.col("m")).alias("mode"), sources.alias("sources"), samples.chosen_hint(["one", "two", "three"], 5, F.col("page_id")).alias("hint"))
