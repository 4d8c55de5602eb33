"""Rows of unknown shape as VARIANT columns: training samples by their shape, and arguments checked against a schema.

Shapes and schemas are compiled to Column expressions over typed paths, so rows of all shapes go through one plan without
Python, and a table's columns needn't name the fields that only some rows have.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.text import let

TURNS = "array<struct<from:string,value:string,role:string,content:string>>"
URL = "struct<url:string>"
PARTS = f"array<struct<type:string,text:string,audio_text:string,image_url:{URL},audio_url:{URL},video_url:{URL}>>"
MESSAGES = f"array<struct<role:string,content:{PARTS}>>"
#: The parts of messages as models take them: one of the urls, or text.
TAKEN = "array<struct<type:string,text:string,audio_text:string,url:string>>"
MEDIA = "<image>"
EDGES = r"^[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$"


def stripped(text: Column) -> Column:
    """text without white space at its ends, that of Unicode too."""
    return F.regexp_replace(text, EDGES, "")


def field(row: Column, path: str, kind: str = "variant") -> Column:
    """What is at a path of a VARIANT; null if nothing is, or if it can't be read as that kind."""
    return F.try_variant_get(row, path, kind)


def present(row: Column, name: str) -> Column:
    """Whether an object has a field, be it a JSON null."""
    return field(row, key(name)).isNotNull()


def key(name: str) -> str:
    """The path of a field by its name, which can hold one kind of quotes but not both."""
    quote = '"' if "'" in name else "'"
    if quote in name:
        raise ValueError(f"a path can't name {name!r}")
    return f"$[{quote}{name}{quote}]"


def kind_of(value: Column) -> Column:
    """string, integer, number, boolean, array, object or null of a VARIANT; null of none. Whole numbers beyond 64 bits are integers."""
    name = F.schema_of_variant(value)
    digits = F.regexp_extract(name, r"^DECIMAL\((\d+),0\)$", 1)
    return (
        F.when(name == "STRING", "string").when(name == "BIGINT", "integer").when(F.try_to_number(digits, F.lit("99")) > 18, "integer")
        .when(name.startswith("DECIMAL") | name.isin("DOUBLE", "FLOAT"), "number").when(name == "BOOLEAN", "boolean")
        .when(name.startswith("ARRAY"), "array").when(name.startswith("OBJECT"), "object").when(name == "VOID", "null")
    )


#: What a value of each kind passes for. Truth values pass for numbers, unknown types take all. Fixed values.
PASSES = {
    "string": ("string",), "integer": ("integer", "boolean"), "number": ("integer", "number", "boolean"),
    "boolean": ("boolean",), "array": ("array",), "object": ("object",),
}


def is_one_of(value: Column, kind: Column, options: list) -> Column:
    """Whether a value equals one of the options: texts as texts, numbers and truth values as numbers, null as null."""
    texts = [x for x in options if isinstance(x, str)]
    numbers = [float(x) for x in options if isinstance(x, (bool, int, float))]
    number = F.when(kind == "boolean", field(value, "$", "boolean").cast("int").cast("double")).otherwise(field(value, "$", "double"))
    return (
        F.when(kind == "string", field(value, "$", "string").isin(*texts) if texts else F.lit(False))
        .when(kind.isin("integer", "number", "boolean"), number.isin(*numbers) if numbers else F.lit(False))
        .when(kind == "null", F.lit(None in options)).otherwise(False)
    )


def problems(value: Column, schema: dict, where: str = "") -> Column:
    """array<struct<parameter, problem>> of what a VARIANT has against a schema of an object: problem is not_object,
    missing, type or enum. The required ones come first, then properties in the order of the schema; properties of
    objects are looked into, and named by their path. Null, as no value, is no object."""
    problem = lambda name, what: F.struct(F.lit(where + name).alias("parameter"), F.lit(what).alias("problem"))
    none = F.array().cast("array<struct<parameter:string,problem:string>>")
    found = [F.when(~present(value, name), problem(name, "missing")) for name in schema.get("required", ())]
    inner = []
    for name, rule in schema.get("properties", {}).items():
        own = field(value, key(name))
        kind = kind_of(own)
        wrong = ~kind.isin(*PASSES[rule["type"]]) if rule.get("type") in PASSES else F.lit(False)
        odd = ~is_one_of(own, kind, rule["enum"]) if "enum" in rule else F.lit(False)
        found.append(F.when(own.isNotNull() & wrong, problem(name, "type")).when(own.isNotNull() & odd, problem(name, "enum")))
        if rule.get("type") == "object" and ("properties" in rule or "required" in rule):
            inner.append(F.when(kind == "object", problems(own, rule, f"{where}{name}.")))
    here = F.filter(F.array(*found), lambda p: p.isNotNull()) if found else none
    all_ = F.concat(here, *[F.coalesce(i, none) for i in inner])
    return F.when(F.coalesce(kind_of(value) == "object", F.lit(False)), all_).otherwise(F.array(problem("", "not_object")))


def valid(value: Column, schema: dict) -> Column:
    """Whether arguments keep a schema."""
    return F.size(problems(value, schema)) == 0


def sample_kind(row: Column) -> Column:
    """conversations, conversations_file (their path instead), caption, messages or video (video and prompt); null for none of these."""
    return (
        F.when(kind_of(field(row, "$.conversations")) == "string", "conversations_file").when(present(row, "conversations"), "conversations")
        .when(present(row, "caption"), "caption").when(present(row, "messages"), "messages")
        .when(present(row, "video") & present(row, "prompt"), "video")
    )


def urls(row: Column, name: str) -> Column:
    """A field that is one text, or an array of texts, as an array; null if it is neither, or a JSON null."""
    own = field(row, key(name))
    kind = kind_of(own)
    return F.when(kind == "array", field(own, "$", "array<string>")).when(kind == "string", F.array(field(own, "$", "string")))


def part(kind: str | Column, text: Column | None = None, url: Column | None = None, audio_text: Column | None = None) -> Column:
    """One part of a message as models take it."""
    none = F.lit(None).cast("string")
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("type"), (none if text is None else text).alias("text"), (none if audio_text is None else audio_text).alias("audio_text"), (none if url is None else url).alias("url"))


def turn_parts(turns: Column, media: Column, kind: Column) -> Column:
    """array<struct<role, content>> of turns of either dialect: texts between tags, stripped, without empty ones, and the
    next url for each tag as long as there are any, counted over all turns. A turn of neither dialect raises."""
    old, new = ("human", "gpt", "system"), ("user", "assistant", "system")
    role = lambda t: F.when(t["from"].isin(*old), F.when(t["from"] == "human", "user").otherwise("assistant")).when(t["role"].isin(*new), t["role"])
    text = lambda t: F.coalesce(F.when(t["from"].isin(*old), t["value"]).otherwise(t["content"]), F.lit(""))
    named = F.transform(turns, lambda t: F.struct(F.coalesce(role(t), F.raise_error(F.lit("a turn needs role or from")).cast("string")).alias("role"), F.split(text(t), MEDIA).alias("texts")))
    before = lambda i: F.aggregate(F.slice(named, 1, i), F.lit(0), lambda n, t: n + F.size(t["texts"]) - 1)

    def parts(t: Column, i: Column) -> Column:
        first = before(i)
        one = lambda x, k: F.array(F.when(k > 0, part(kind, url=F.get(media, first + k - 1))), F.when(stripped(x) != "", part("text", stripped(x))))
        return F.filter(F.flatten(F.transform(t["texts"], one)), lambda p: p.isNotNull() & ((p["type"] == "text") | p["url"].isNotNull()))

    return F.transform(named, lambda t, i: F.struct(t["role"].alias("role"), parts(t, i).alias("content")))


def taken_parts(messages: Column) -> Column:
    """Messages with typed parts as models take them; parts of unknown types are text."""
    def taken(p: Column) -> Column:
        of = lambda name: part(name, url=p[f"{name}_url"]["url"])
        return F.when(p["type"] == "image_url", of("image")).when(p["type"] == "audio_url", of("audio")).when(p["type"] == "video_url", of("video")).otherwise(part("text", p["text"], audio_text=p["audio_text"]))

    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), F.transform(m["content"], taken).alias("content")))


def with_user_suffix(messages: Column, suffix: str) -> Column:
    """A stripped suffix on each user turn: on a line of its own after the text that ends the turn, or as a part of its own."""
    suffix = suffix.strip()
    if not suffix:
        return messages

    def put(content: Column) -> Column:
        last = F.try_element_at(content, F.lit(-1))
        text = F.regexp_replace(F.coalesce(last["text"], F.lit("")), EDGES.split("|")[1], "")
        longer = part("text", F.concat(text, F.when(text != "", "\n").otherwise(""), F.lit(suffix)), audio_text=last["audio_text"])
        return F.when(last["type"] == "text", F.concat(F.slice(content, 1, F.size(content) - 1), F.array(longer))).otherwise(F.concat(content, F.array(part("text", F.lit(suffix)))))

    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), F.when(m["role"] == "user", put(m["content"])).otherwise(m["content"]).alias("content")))


def sample_messages(row: Column, file: Column | None = None) -> Column:
    """array<struct<role, content: TAKEN>> of a sample of any shape; file: the VARIANT that a path of conversations leads to.
    Null for a sample of no known shape, and for a path without its file."""
    image, video = urls(row, "image"), urls(row, "video")
    media, kind = F.coalesce(image, video), F.when(image.isNotNull(), "image").otherwise("video")
    of_turns = lambda v: turn_parts(field(v, "$", TURNS), media, kind)
    known = sample_kind(row)
    caption = F.array(
        F.struct(F.lit("user").alias("role"), F.array(part("image", url=F.coalesce(F.when(kind_of(field(row, "$.image")) == "string", field(row, "$.image", "string")), F.lit("")))).alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.array(part("text", field(row, "$.caption", "string"))).alias("content")),
    )
    clip = F.array(F.struct(F.lit("user").alias("role"), F.array(part("video", url=field(row, "$.video", "string")), part("text", field(row, "$.prompt", "string"))).alias("content")))
    out = F.when(known == "conversations", of_turns(field(row, "$.conversations")))
    if file is not None:
        out = out.when(known == "conversations_file", of_turns(file))
    return out.when(known == "caption", caption).when(known == "messages", taken_parts(field(row, "$.messages", MESSAGES))).when(known == "video", clip)


def media_sources(messages: Column, kind: str = "image") -> Column:
    """The urls of a kind of media in messages of taken parts, in order; none for null."""
    parts = F.flatten(F.transform(F.coalesce(messages, F.array().cast(f"array<struct<role:string,content:{TAKEN}>>")), lambda m: m["content"]))
    return F.transform(F.filter(parts, lambda p: (p["type"] == kind) & p["url"].isNotNull()), lambda p: p["url"])


def traced(source: Column) -> Column:
    """A source as traces show it: of data inside the url only what it is."""
    return F.when(source.startswith("data:"), F.concat(F.substring_index(source, ",", 1), F.lit(",<omitted>"))).otherwise(source)


def input_mode(messages: Column) -> Column:
    """0 for text alone, 1 with audio, 2 with images or videos, 3 with both."""
    has = lambda kind: (F.size(media_sources(messages, kind)) > 0).cast("int")
    return has("audio") + 2 * F.greatest(has("image"), has("video"))


def chosen_hint(hints: list[str], seed: int, row: Column) -> Column:
    """One of the hints, the same whenever seed and row are."""
    return F.element_at(F.array(*[F.lit(h) for h in hints]), (F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), row.cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(len(hints))) + 1).cast("int"))


#: A place that evidence names: a page and a box.
PLACES = "array<struct<page:int,box:array<double>>>"


def boxes_in(value: Column) -> Column:
    """The boxes of a VARIANT: one of four numbers, or those of an array of such; what isn't a box is left out."""
    inside = field(value, "$", "array<variant>")
    one = (F.size(inside) == 4) & F.forall(inside, lambda x: kind_of(x).isin("integer", "number"))
    found = F.transform(F.when(one, F.array(value)).otherwise(inside), lambda b: field(b, "$", "array<double>"))
    return F.filter(F.coalesce(found, F.array().cast("array<array<double>>")), lambda b: (F.size(b) == 4) & F.forall(b, lambda x: x.isNotNull()))


def places_of_object(value: Column) -> Column:
    """Of an object either page (or page_id) with bbox_2d, bbox or bboxes, or pages as names with their boxes."""
    page = F.coalesce(field(value, "$.page"), field(value, "$.page_id"))
    boxes = F.coalesce(field(value, "$.bbox_2d"), field(value, "$.bbox"), field(value, "$.bboxes"))
    at = lambda number, xs: F.transform(boxes_in(xs), lambda b: F.struct(number.alias("page"), b.alias("box")))
    named = F.flatten(F.transform(F.map_entries(field(value, "$", "map<string,variant>")), lambda e: at(e["key"].try_cast("int"), e["value"])))
    return F.when(page.isNotNull(), at(field(page, "$", "int"), boxes)).otherwise(named).cast(PLACES)


def places_in(layout: Column) -> Column:
    """Pages and boxes of an evidence layout of any shape: an object of either kind, an array of these, or arrays of a page
    and four numbers. Places without a page number are left out; null has none."""
    def flat_of(x: Column, five: Column) -> Column:
        flat = F.array(F.struct(five[0].cast("int").alias("page"), F.slice(five, 2, 4).alias("box"))).cast(PLACES)
        return F.when(kind_of(x) == "object", places_of_object(x)).when((kind_of(x) == "array") & (F.size(five) == 5), flat)

    item = lambda x: let(field(x, "$", "array<double>"), lambda five: flat_of(x, five))
    # taken once: a layout is often parsed on the way, and stands in many places here
    return let(layout, lambda own: places_of_layout(own, item))


def places_of_layout(layout: Column, item) -> Column:
    """places_in of a layout, with the places of an array's items by item."""
    found = F.when(kind_of(layout) == "object", places_of_object(layout)).when(kind_of(layout) == "array", F.flatten(F.filter(F.transform(field(layout, "$", "array<variant>"), item), lambda x: x.isNotNull())))
    return F.filter(F.coalesce(found, F.array().cast(PLACES)), lambda p: p["page"].isNotNull())


def evidence_places(by_dpi: Column, locations: Column) -> Column:
    """The places of the layout with the highest resolution that has any, by the digits in its name, else those of locations."""
    digits = lambda name: F.coalesce(F.regexp_replace(name, "[^0-9]+", "").try_cast("long"), F.lit(0).cast("long"))
    layouts = F.transform(F.map_entries(field(by_dpi, "$", "map<string,variant>")), lambda e: F.struct((-digits(e["key"])).alias("down"), e["key"].alias("name"), F.to_json(e["value"]).alias("layout")))
    full = F.filter(F.transform(F.array_sort(layouts), lambda x: places_in(F.try_parse_json(x["layout"]))), lambda p: F.size(p) > 0)
    return F.coalesce(F.get(full, F.lit(0)), places_in(locations))
