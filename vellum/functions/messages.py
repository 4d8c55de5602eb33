"""Conversations, citations and label masks as Column builders over arrays of structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CITATION = r"Page (\d+) <box>\[\s*(\d+(?:\.\d+)?),\s*(\d+(?:\.\d+)?),\s*(\d+(?:\.\d+)?),\s*(\d+(?:\.\d+)?)\s*\]"


def unified_turns(turns: Column) -> Column:
    """array of struct(role, content) from turns with from/value or role/content."""
    known = F.create_map(*[F.lit(x) for pair in (("human", "user"), ("gpt", "assistant")) for x in pair])
    role = lambda t: F.coalesce(F.nullif(t["from"], F.lit("")), F.nullif(t["role"], F.lit("")))
    return F.transform(
        turns,
        lambda t: F.struct(
            F.coalesce(F.try_element_at(known, role(t)), role(t)).alias("role"),
            F.coalesce(F.nullif(t["value"], F.lit("")), F.nullif(t["content"], F.lit(""))).alias("content"),
        ),
    )


def without_last_assistant(messages: Column) -> Column:
    """Messages without the last one of the assistant; all if it never speaks."""
    last = F.array_max(F.transform(messages, lambda m, i: F.when(m["role"] == "assistant", i)))
    return F.filter(messages, lambda m, i: last.isNull() | (i != last))


def with_prompt(messages: Column, system: Column, suffix: Column, gap: str = "\n") -> Column:
    """Messages with system text before those of the first system turn (or as a new one), and suffix on the last user turn."""
    last = F.array_max(F.transform(messages, lambda m, i: F.when(m["role"] == "user", i)))
    has = F.exists(messages, lambda m: m["role"] == "system")
    first = F.array_min(F.transform(messages, lambda m, i: F.when(m["role"] == "system", i)))
    merged = F.transform(
        messages,
        lambda m, i: F.struct(
            m["role"].alias("role"),
            F.when(i == first, F.concat(system, F.lit(gap), m["content"])).when(i == last, F.concat(m["content"], suffix)).otherwise(m["content"]).alias("content"),
        ),
    )
    return F.when(has, merged).otherwise(F.concat(F.array(F.struct(F.lit("system").alias("role"), system.alias("content"))), merged))


def interleaved(content: Column, images: Column, tag: str = "<image>") -> Column:
    """array of struct(type, value): the text between tags, and an image for each tag."""
    text = lambda x: F.struct(F.lit("text").alias("type"), x.alias("value"))
    parts = F.split(content, tag)
    both = F.transform(
        parts,
        lambda x, i: F.when(i == 0, F.array(text(x))).otherwise(F.array(F.struct(F.lit("image").alias("type"), F.get(images, i - 1).alias("value")), text(x))),
    )
    return F.filter(F.flatten(both), lambda p: (p["type"] == "image") | (F.coalesce(p["value"], F.lit("")) != ""))


def tags_match(messages: Column, pages: Column, tag: str = "<image>") -> Column:
    """The contract of a document conversation: turns, as many tags in user turns as pages, an assistant turn that isn't empty."""
    count = F.aggregate(messages, F.lit(0), lambda n, m: n + F.when(m["role"] == "user", F.regexp_count(m["content"], F.lit(tag))).otherwise(0))
    spoken = F.exists(messages, lambda m: (m["role"] == "assistant") & (F.trim(m["content"]) != ""))
    return F.coalesce((F.size(messages) >= 1) & (count == pages) & spoken, F.lit(False))


def evidence_boxes(text: Column) -> Column:
    """array of struct(page, x0, y0, x1, y1) of the citations in a text."""
    group = lambda k: F.regexp_extract_all(text, F.lit(CITATION), F.lit(k))
    zipped = F.arrays_zip(*[group(k).alias(n) for k, n in enumerate(("page", "x0", "y0", "x1", "y1"), 1)])
    return F.transform(zipped, lambda z: F.struct(z["page"].cast("int").alias("page"), *[z[n].cast("double").alias(n) for n in ("x0", "y0", "x1", "y1")]))


def tool_calls(text: Column) -> Column:
    """struct(calls: JSON bodies, invalid: opening tags without a body that is an object)."""
    bodies = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"), F.lit(1))
    good = F.filter(bodies, lambda b: F.try_parse_json(b).isNotNull() & b.startswith("{"))
    return F.struct(good.alias("calls"), (F.regexp_count(text, F.lit("<tool_call>")) - F.size(good)).alias("invalid"))


def positions_by_count(mask: Column) -> Column:
    """max(running count of the mask - 1, 0) at each place."""
    return F.transform(mask, lambda m, i: F.greatest(F.aggregate(F.slice(mask, 1, i + 1), F.lit(0), lambda a, x: a + x.cast("int")) - 1, F.lit(0)))


def positions_by_index(mask: Column) -> Column:
    return F.transform(mask, lambda m, i: m.cast("int") * i)


def until_first(ids: Column, end: int) -> Column:
    """1 up to and including the first end id, then 0."""
    at = F.array_position(ids, end)
    return F.transform(ids, lambda x, i: F.when((at == 0) | (i < at), 1).otherwise(0))


def expanded_media(ids: Column, media: int, counts: Column) -> Column:
    """Each media id as many times as the count at its ordinal says."""
    at = F.transform(ids, lambda x, i: F.when(x == media, F.size(F.filter(F.slice(ids, 1, i + 1), lambda y: y == media))).otherwise(0))
    return F.flatten(F.zip_with(ids, at, lambda x, k: F.when(k > 0, F.array_repeat(F.lit(media).cast("long"), F.get(counts, k - 1).cast("int"))).otherwise(F.array(x.cast("long")))))


def labels_without(ids: Column, keep: Column, ignore: int = -100) -> Column:
    """ids where keep is true, else ignore."""
    return F.zip_with(ids, keep, lambda x, k: F.when(k, x).otherwise(F.lit(ignore)))


def padded(ids: Column, length: Column, pad: int, side: str = "right", truncate: str = "right") -> Column:
    """ids with exactly so many entries; truncate: right or left drops there, error raises."""
    n = F.size(ids)
    if truncate == "error":
        cut = F.when(n > length, F.raise_error(F.lit("a sequence is too long"))).otherwise(ids)
    else:
        cut = F.when(n <= length, ids).when(F.lit(truncate == "right"), F.slice(ids, F.lit(1), length)).otherwise(F.slice(ids, n - length + 1, length))
    fill = F.array_repeat(F.lit(pad).cast("long"), F.greatest(length - n, F.lit(0)).cast("int"))
    own = F.transform(cut, lambda x: x.cast("long"))
    return F.concat(own, fill) if side == "right" else F.concat(fill, own)


def supervised_mask(attention: Column, n_prompt: Column, n_response: Column) -> Column:
    """The attention mask without the prompt but its last place, and without the response's last place."""
    n = F.size(attention)
    last = F.least(n_prompt + n_response, n) - 1
    return F.transform(attention, lambda m, i: F.when((i == last) | ((n_prompt > 1) & (i < F.least(n_prompt, n) - 1)), F.lit(0)).otherwise(m))


def packed_labels(ids: Column, starts: Column, ignore: int = -100) -> Column:
    """Labels of a pack: ids, but for the first of each sequence, which nothing before it predicts."""
    return F.transform(ids, lambda x, i: F.when(F.array_contains(starts, i), F.lit(ignore)).otherwise(x))


def response_mask(action: Column, attention: Column, n: Column) -> Column:
    """The last n places of the action mask, or of the attention mask where there is none."""
    mask = F.coalesce(action, attention)
    return F.slice(mask, F.size(mask) - n + 1, n)


def multiple(length: Column, of: int) -> Column:
    """The least multiple that isn't below a length."""
    return F.ceil(length / of) * of


def unpadded(ids: Column, mask: Column) -> Column:
    """The entries that a mask keeps."""
    return F.transform(F.filter(F.arrays_zip(ids.alias("x"), mask.alias("m")), lambda z: z["m"] != 0), lambda z: z["x"])


def unpadded_left(ids: Column, mask: Column) -> Column:
    """The last so many ids as the mask has ones: those of a sequence that is padded on the left."""
    n = F.aggregate(mask, F.lit(0), lambda a, m: a + m.cast("int"))
    return F.slice(ids, F.size(ids) - n + 1, n)


def mask_of_all_turns(ids: Column, pads: list[int]) -> Column:
    """1 for each id that isn't a pad, whatever comes before it."""
    return F.transform(ids, lambda x: (~x.isin(*pads)).cast("int"))


def gathered(values: Column, places: Column) -> Column:
    """The values at places from 0; null for one beyond."""
    return F.transform(places, lambda i: F.get(values, i.cast("int")))
