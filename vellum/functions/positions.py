"""Places of tokens in packs and in mixed media, and random masks that any partitioning repeats, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT, IMAGE, VIDEO = 0, 1, 2


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def runs(kinds: Column) -> Column:
    """array<struct<kind, n>> of the runs of equal neighbours of an array; empty for an empty array."""

    def of(x: Column) -> Column:
        starts = F.filter(F.transform(x, lambda v, i: F.when((i == 0) | (F.get(x, i - 1) != v), i)), lambda i: i.isNotNull())
        return let(starts, lambda s: F.transform(s, lambda a, k: F.struct(F.get(x, a).alias("kind"), (F.coalesce(F.get(s, k + 1), F.size(x)) - a).alias("n"))))

    return let(kinds, of)


GRID = "struct<t:int,h:int,w:int>"
PLACED_RUN = f"struct<kind:int,n:int,at:int,grid:{GRID}>"


def by_frame(grids: Column) -> Column:
    """A grid of one step for each frame of each video."""
    one = lambda g: F.array_repeat(F.struct(F.lit(1).alias("t"), g["h"].alias("h"), g["w"].alias("w")), g["t"].cast("int"))
    return F.flatten(F.transform(grids, one))


def placed_runs(kinds: Column, images: Column, videos: Column, merge: int) -> Column:
    """Runs with the position that each begins at, and the merged grid of those of images and video frames: text moves on
    by its length, media by the longer side of its grid. The carry from run to run is one number and a count a kind."""
    grid = lambda g: F.struct(g["t"].cast("int").alias("t"), F.floor(g["h"] / merge).cast("int").alias("h"), F.floor(g["w"] / merge).cast("int").alias("w"))
    none = F.array().cast(f"array<{GRID}>")
    both = F.struct(F.coalesce(F.transform(images, grid), none).alias("images"), F.coalesce(F.transform(by_frame(videos), grid), none).alias("frames"))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("image"), F.lit(0).alias("frame"), F.array().cast(f"array<{PLACED_RUN}>").alias("out"))

    def placed(media: Column) -> Column:
        def step(s: Column, r: Column) -> Column:
            own = F.when(r["kind"] == IMAGE, F.get(media["images"], s["image"])).when(r["kind"] == VIDEO, F.get(media["frames"], s["frame"]))
            on = F.when(r["kind"] == TEXT, r["n"]).otherwise(F.coalesce(F.greatest(own["h"], own["w"]), F.lit(0)))
            run = F.struct(r["kind"].cast("int").alias("kind"), r["n"].alias("n"), s["at"].alias("at"), own.alias("grid")).cast(PLACED_RUN)
            return F.struct((s["at"] + on).alias("at"), (s["image"] + (r["kind"] == IMAGE).cast("int")).alias("image"), (s["frame"] + (r["kind"] == VIDEO).cast("int")).alias("frame"), F.concat(s["out"], F.array(run)).alias("out"))

        return F.aggregate(runs(kinds), start, step)["out"]

    return let(both, placed)


def problem_of_run(r: Column) -> Column:
    """Why a placed run can't be laid out, or null."""
    g = r["grid"]
    return (
        F.when(~r["kind"].isin(TEXT, IMAGE, VIDEO), "a kind that isn't text, image or video").when((r["kind"] != TEXT) & g.isNull(), "media without a grid")
        .when((r["kind"] != TEXT) & (g["t"] * g["h"] * g["w"] != r["n"]), "a grid that doesn't fit its tokens")
    )


def media_positions(kinds: Column, images: Column, videos: Column, merge: int = 2) -> Column:
    """array<struct<t, h, w>>: the three-axis position of each token of a sample.

    kinds: array of TEXT, IMAGE or VIDEO, a token each. images, videos: array<struct<t, h, w>> of grids before merging,
    in the order of their runs; each frame of a video is a run of its own. Null grids are none, grids left over are
    ignored. An unknown kind, a run without its grid, and a grid that doesn't fit its run raise. Null kinds give null,
    an empty sample no positions. Ties don't arise: the order of tokens is that of the array.
    """
    def laid(r: Column) -> Column:
        g, at = r["grid"], r["at"]
        text = lambda j: F.struct((at + j).alias("t"), (at + j).alias("h"), (at + j).alias("w"))
        area = g["h"] * g["w"]
        media = lambda j: F.struct((at + F.floor(j / area)).cast("int").alias("t"), (at + F.floor(j / g["w"]) % g["h"]).cast("int").alias("h"), (at + j % g["w"]).alias("w"))
        bad = problem_of_run(r)
        return F.when(bad.isNotNull(), F.raise_error(bad).cast("array<struct<t:int,h:int,w:int>>")).otherwise(
            F.transform(F.sequence(F.lit(0), r["n"] - 1), lambda j: F.when(r["kind"] == TEXT, text(j)).otherwise(media(j)))
        )

    return F.flatten(F.transform(placed_runs(kinds, images, videos, merge), laid))


def pack_offsets(lengths: Column) -> Column:
    """0 and the running sums of the lengths of a pack's samples."""
    start = F.array(F.lit(0).cast("long"))
    return F.aggregate(lengths, start, lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))


def pack_members(lengths: Column) -> Column:
    """The number of its sample, from 0, for each token of a pack."""
    return F.flatten(F.transform(lengths, lambda n, i: F.array_repeat(i, n.cast("int"))))


def expanded_frames(ids: Column, media: int, frames: Column) -> Column:
    """ids with each media id replaced by its frames: for each the ids of its time stamp, then so many media ids.

    frames: array<array<struct<stamp: array<int>, n: int>>>, one entry for each media id in turn; one without an entry, or
    with no frames, goes. Entries left over are ignored.
    """
    def of(x: Column) -> Column:
        turn = lambda i: F.size(F.filter(F.slice(x, 1, i), lambda y: y == media))
        own = lambda i: F.flatten(F.transform(F.coalesce(F.get(frames, turn(i)), F.array().cast("array<struct<stamp:array<int>,n:int>>")), lambda f: F.concat(f["stamp"], F.array_repeat(F.lit(media), f["n"]))))
        return F.flatten(F.transform(x, lambda v, i: F.when(v == media, own(i)).otherwise(F.array(v))))

    return let(ids, of)


def dialogue_labels(turns: Column, media: list[int], head: int = 3, ignore: int = -100) -> Column:
    """Labels of a dialogue: array<struct<role, ids>> as one array, where only what the assistant says counts: not user
    and system turns, nor the first ``head`` ids of an assistant turn, which name its role, nor media ids."""
    def of(t: Column) -> Column:
        keep = lambda i, x: (t["role"] == "assistant") & (i >= head) & (~x.isin(*media) if media else F.lit(True))
        return F.transform(t["ids"], lambda x, i: F.when(keep(i, x), x).otherwise(F.lit(ignore)))

    return F.flatten(F.transform(turns, of))


def uniform(seed: int, *place: Column) -> Column:
    """A number from 0 up to 1 that is the same for the same seed and place, wherever and whenever it is drawn."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *place), 11) * F.lit(2.0**-53)


def corrupted(ids: Column, row: Column, mask_id: int, special: Column, least: float, most: float, seed: int, ignore: int = -100) -> Column:
    """struct(ids, labels, rate) of a masked sample: each id is masked with the row's own rate, which is uniform between
    least and most, and only masked ids have labels. special: array<boolean> of ids never masked, or null for none.

    Draws depend on seed, row and place alone, so a row is masked alike under any partitioning and when a task runs again;
    rows that share their key are masked at the same places."""
    if not 0 <= least <= most <= 1:
        raise ValueError("rates go from least to most, within 0 and 1")
    rate = uniform(seed, row, F.lit(-1)) * (most - least) + least

    def of(x: Column) -> Column:
        hit = F.transform(ids, lambda v, i: (uniform(seed, row, i) < x["p"]) & ~F.coalesce(F.get(x["special"], i), F.lit(False)))
        masked = lambda h: F.zip_with(ids, h, lambda v, on: F.when(on, F.lit(mask_id)).otherwise(v))
        labels = lambda h: F.zip_with(ids, h, lambda v, on: F.when(on, v).otherwise(F.lit(ignore)))
        return let(hit, lambda h: F.struct(masked(h).alias("ids"), labels(h).alias("labels"), x["p"].alias("rate")))

    return let(F.struct(rate.alias("p"), special.alias("special")), of)


def random_mask(length: Column, row: Column, most_valid: float, most_left: float, seed: int, least_valid: float = 0) -> Column:
    """A mask of 0 and 1 of that length: padding on the left, then ones, then padding. The ones are at least one and
    that share of the length, and at most another share; the left padding is at most a share too, and both fit."""
    if not (0 < most_valid <= 1 and 0 <= most_left < 1 and 0 <= least_valid <= most_valid and most_valid + most_left <= 1):
        raise ValueError("the shares of padding and of ones must leave room for each other")
    least, most = F.greatest(F.lit(1), F.floor(length * least_valid)), F.floor(length * most_valid)
    between = lambda place, low, high: low + F.floor(uniform(seed, row, F.lit(place)) * (high - low + 1))
    left = between(0, F.lit(0), F.floor(length * most_left))
    ones = between(1, least, F.greatest(most, least))
    of = lambda x: F.transform(F.sequence(F.lit(0).cast("long"), length.cast("long") - 1), lambda i: ((i >= x["left"]) & (i < x["left"] + x["ones"])).cast("int"))
    return let(F.struct(left.alias("left"), ones.alias("ones")), of)
