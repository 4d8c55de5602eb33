"""Prompts taken apart and put together, and paths and schemas that go with them, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How retrieval prompts begin, by task, and a pattern for where what follows the haystack begins. Fixed values.
NUMBER = "A special magic number is hidden within the following text. Make sure to memorize it. I will quiz you about the number afterwards.\n"
NUMBERS = "Some special magic numbers are hidden within the following text. Make sure to memorize them. I will quiz you about the numbers afterwards.\n"
COPY_ONE = "Below are some questions. I will ask you to copy one of them. Please copy and paste the question you find.\n\n"
COPY_SOME = "Below are some questions. I will ask you to copy some of them. Please copy and paste the questions you find.\n\n"
SOLVE = (
    "Below are some questions. I will ask you to solve one of them. Please solve the question you find and make sure to put the answer "
    "(and only answer) inside \\boxed\\{\\}.\n\n"
)
FIND_TEXT = (
    "Below are some documents. I will give you a text at the end. Please find the document index of the text. "
    "Only give me the index without any document contents.\n\n"
)
FIND_HELP = (
    "Below are some documents. I will give you a question at the end. Please find the index of the most relevant document that can help answer the question. "
    "Only give me the index without any document contents.\n\n"
)
ANSWER = "Below are some documents. I will ask you to answer a question based on the documents. Please answer the question.\n\n"
EXAMPLES = r"\n\nHere are some examples to help you understand the task:\n\n"
RETRIEVAL = {
    "mk_niah_basic": (NUMBER, r"\nWhat is the special magic number for "),
    "mv_niah_basic": (NUMBERS, r"\nWhat are all the special magic numbers for "),
    "mk_niah_easy": (COPY_ONE, r"\n\nPlease copy the Question \d+ from the context\."),
    "mk_niah_medium": (SOLVE, EXAMPLES),
    "mk_niah_hard": (SOLVE, EXAMPLES),
    "mv_niah_easy": (COPY_SOME, r"\n\nPlease find and copy all the Question \d+ from the context\."),
    "mv_niah_medium": (COPY_ONE, r"\n\nPlease first copy all the Question \d+ from the context"),
    "mv_niah_hard": (COPY_ONE, r"\n\nPlease copy the \d+\w+ \(1 indexed\) Question \d+ from the context\."),
    "qa_basic": (FIND_TEXT, r"\n\nText: "),
    "qa_easy": (FIND_HELP, r"\n\nQuestion: "),
    "qa_medium": (ANSWER, r"\n\nPlease first find and copy paste the documents relevant"),
    "qa_hard": (ANSWER, r"\n\nPlease answer the following question based on the documents\."),
}
#: The end of a prompt that already begins the answer about magic numbers. Fixed value.
NUMBER_STEM = r"(?i)\s+The special magic numbers? for [^\n?]+ mentioned in the provided text (?:is|are)\s*$"


def by_task(task: Column, values: dict) -> Column:
    return F.coalesce(F.lit(None).cast("string"), *[F.when(task == k, F.lit(v)) for k, v in values.items()])


def split_retrieval(task: Column, prompt: Column) -> Column:
    """struct(header, haystack, tail, problem) of a prompt; the three make up the prompt. problem is one of no_tail,
    many_tails, other_header, nothing_between and other_task, in that order, and null where the prompt was split."""
    header = by_task(task, {k: h for k, (h, _) in RETRIEVAL.items()})
    ends = F.coalesce(F.lit(None).cast("array<string>"), *[F.when(task == k, F.split(prompt, t)) for k, (_, t) in RETRIEVAL.items()])

    def parted(x: Column) -> Column:
        n, cut = F.length(x["header"]), F.length(F.get(x["ends"], 0))
        problem = (
            F.when(F.size(x["ends"]) == 1, "no_tail").when(F.size(x["ends"]) > 2, "many_tails").when(~prompt.startswith(x["header"]), "other_header")
            .when(cut <= n, "nothing_between").when(x["header"].isNull(), "other_task")
        )
        part = lambda start, size: F.when(problem.isNull(), F.substring(prompt, start, size))
        return F.struct(part(F.lit(1), n).alias("header"), part(n + 1, cut - n).alias("haystack"), part(cut + 1, F.length(prompt)).alias("tail"), problem.alias("problem"))

    return F.transform(F.array(F.struct(header.alias("header"), ends.alias("ends"))), parted)[0]


def split_template(template: Column, question: Column, slot: str = "{context}") -> Column:
    """struct(head, tail): a template around its context slot, with the question put in; one without a slot raises."""
    at = F.locate(slot, template)
    checked = F.when(at > 0, template).otherwise(F.raise_error(F.concat(F.lit("no slot in "), template)).cast("string"))
    filled = lambda x: F.replace(x, F.lit("{input}"), question)
    head, tail = F.substring(checked, F.lit(1), at - 1), F.substring(checked, at + len(slot), F.length(checked))
    return F.struct(filled(head).alias("head"), filled(tail).alias("tail"))


def without_number_stem(text: Column) -> Column:
    """A user's text without the beginning of an answer about magic numbers at its end, and without blanks there."""
    return F.regexp_replace(F.regexp_replace(text, NUMBER_STEM, ""), r"\s+$", "")


def paged_prompt(pages: Column, head: Column, tail: Column, marker: bool = True) -> Column:
    """array of struct(type, value): the head, each page's image (behind a line that numbers it), and the tail; empty texts are left out."""
    text = lambda x: F.struct(F.lit("text").alias("type"), x.alias("value"))
    image = lambda x: F.struct(F.lit("image").alias("type"), x.alias("value"))
    each = F.transform(pages, lambda p, i: F.array(text(F.concat(F.lit("Page "), (i + 1).cast("string"), F.lit("\n"))), image(p)) if marker else F.array(image(p)))
    return F.filter(F.concat(F.array(text(head)), F.flatten(each), F.array(text(tail))), lambda x: (x["type"] == "image") | (x["value"] != ""))


def rooted(path: Column, root: str, prefix: str) -> Column:
    """A path below a root: relative ones there, absolute ones with their published prefix replaced, others as they are."""
    below = F.lit(prefix.rstrip("/") + "/")
    return F.when(~path.startswith("/"), F.concat_ws("/", F.lit(root), path)).when(path.startswith(below), F.concat_ws("/", F.lit(root), F.substring(path, F.length(below) + 1, F.length(path)))).otherwise(path)


def tools_of(own: Column, enabled: Column, default: Column) -> Column:
    """A row's tools before the default ones; none where they are disabled."""
    return F.when(F.coalesce(enabled, F.lit(True)), F.coalesce(F.when(F.size(own) > 0, own), default))


def run_label(folder: Column, plain: str) -> Column:
    """The model's name in a results folder, results_NAME; ``plain`` for results."""
    name = F.element_at(F.split(F.regexp_replace(folder, "/+$", ""), "/"), -1)
    return F.when(name == "results", F.lit(plain)).otherwise(F.regexp_replace(name, "^results_", ""))


def frames(total: Column, video_fps: Column, fps: float, least: int, most: int, factor: int) -> Column:
    """How many frames of a video are taken: so many a second, within bounds, as a multiple of factor; fewer than one factor raise."""
    low, high = -(-least // factor) * factor, F.floor(F.least(F.lit(most), total) / factor) * factor
    n = F.floor(F.least(F.least(F.greatest(total / video_fps * fps, F.lit(float(low))), high), total) / factor) * factor
    return F.when(n >= factor, n).otherwise(F.raise_error(F.lit("too few frames")).cast("long"))
