"""From the sizes of media to the tokens that each plugin puts in their place.

Everything is an expression over an item's (width, height, frames, seconds, samples), so a
stage needs no image processor and no pixels. Sizes are first brought into a plugin's bounds,
as its pictures would be; then follow the rules of the model's processor: a fixed square, the
best tiling of a list, a grid of patches, rows of patches, or slices of like aspect.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions.text import bound
from loomspark.operators import multimodal

#: Tilings (height, width) that the tiling models choose from.
TILINGS = ((336, 672), (672, 336), (672, 672), (1008, 336), (336, 1008))
#: Marks of the slicing models.
UNKNOWN_TOKEN = "<unk>"


@dataclass(frozen=True)
class Processor:
    """Settings of a model's processor, as far as the number of tokens depends on them."""

    side: int = 336
    patch: int = 14
    extra_tokens: int = 1
    default_strategy: bool = True
    tilings: tuple[tuple[int, int], ...] = TILINGS
    merge: int = 2
    grid_pixels: tuple[int, int] = (56 * 56, 28 * 28 * 1280)
    longest_edge: int = 1024
    break_token: str = "[IMG_BREAK]"
    end_token: str = "[IMG_END]"
    slice_side: int = 448
    slice_tokens: int = 64
    most_slices: int = 9
    video_slices: int = 2
    use_image_id: bool = True
    image_pixels: tuple[int, int] = multimodal.IMAGE_PIXELS
    video_pixels: tuple[int, int] = multimodal.VIDEO_PIXELS
    video_fps: float = multimodal.VIDEO_FPS
    video_frames: int = multimodal.VIDEO_FRAMES
    sampling_rate: int = 16_000
    hop: int = 160
    most_features: int = 3000


PROCESSORS: dict[str, Processor] = {
    "llava": Processor(),
    "llava_next": Processor(),
    "llava_next_video": Processor(),
    "minicpm_v": Processor(),
    "mllama": Processor(),
    "paligemma": Processor(side=224),
    "pixtral": Processor(patch=16),
    "qwen2_audio": Processor(),
    "qwen2_vl": Processor(),
    "video_llava": Processor(side=224),
}


def best_tiling(width: Column, height: Column, tilings: tuple[tuple[int, int], ...] = TILINGS) -> Column:
    """The tiling (height, width) that keeps most of the picture's pixels, then wastes least, then
    comes first."""

    def judged(i: int, high: int, wide: int) -> Column:
        scale = F.least(F.lit(float(wide)) / width, F.lit(float(high)) / height)
        kept = F.least(F.floor(width * scale) * F.floor(height * scale), width.cast("long") * height)
        return F.struct(kept.alias("kept"), (kept - high * wide).alias("spare"), F.lit(-i).alias("place"), F.lit(high).alias("height"), F.lit(wide).alias("width"))

    best = F.array_max(F.array(*(judged(i, *t) for i, t in enumerate(tilings))))
    return F.struct(best["height"].alias("height"), best["width"].alias("width"))


def tiled_tokens(width: Column, height: Column, p: Processor) -> Column:
    """Features of the whole picture, and of its tiles without their padding, with one more a row."""
    a_side = p.side // p.patch

    def counted(best: Column) -> Column:
        high, wide = F.floor(best["height"] / p.side) * a_side, F.floor(best["width"] / p.side) * a_side
        wider = width / height > wide / high
        # What is left after padding, rounded so that whole numbers stay whole.
        held_height = F.round(height * (wide / width), 7).cast("int")
        held_width = F.round(width * (high / height), 7).cast("int")
        rows = F.when(wider, high - F.floor((high - held_height) / 2) * 2).otherwise(high)
        columns = F.when(wider, wide).otherwise(wide - F.floor((wide - held_width) / 2) * 2)
        return rows * columns + rows

    extra = p.extra_tokens - int(p.default_strategy)
    return (bound(best_tiling(width, height, p.tilings), counted) + a_side * a_side + extra).cast("int")


def grid_sides(width: Column, height: Column, p: Processor) -> tuple[Column, Column]:
    """Sides in whole merged patches, within the bounds of the grid models."""
    unit = p.patch * p.merge
    least, most = p.grid_pixels
    whole = lambda x: F.bround(x / unit, 0).cast("long") * unit
    area = whole(width) * whole(height)
    down, up = F.sqrt(width.cast("double") * height / most), F.sqrt(F.lit(float(least)) / (width.cast("double") * height))
    fit = lambda x: F.when(area > most, F.greatest(F.floor(x / down / unit), F.lit(1)) * unit).when(area < least, F.ceil(x * up / unit) * unit).otherwise(whole(x))
    return fit(width), fit(height)


def row_sides(width: Column, height: Column, p: Processor) -> tuple[Column, Column]:
    """Sides in whole patches, no longer than the longest edge."""
    ratio = F.greatest(width, height) / F.lit(float(p.longest_edge))
    cut = lambda x: F.when(ratio > 1, F.floor(x / ratio)).otherwise(x)
    return tuple((F.floor((cut(x) - 1) / p.patch) + 1) * p.patch for x in (width, height))


def slice_grid(width: Column, height: Column, p: Processor, most: int) -> Column:
    """(columns, rows) of the slices, the closest in aspect to the picture; null for none."""
    ratio = F.log(width / height)
    multiple = F.least(F.ceil(width.cast("long") * height / (p.slice_side * p.slice_side)), F.lit(most))
    grids = [(n, m, n // m) for n in range(2, most + 1) for m in range(1, n + 1) if n % m == 0]

    def judged(i: int, n: int, columns: int, rows: int) -> Column:
        error = F.abs(ratio - math.log(columns / rows))
        # Fewer slices come first: one less than the multiple, then it, then one more.
        return F.when(F.abs(n - multiple) <= 1, F.struct(error.alias("error"), F.lit(i).alias("place"), F.lit(columns).alias("columns"), F.lit(rows).alias("rows")))

    best = F.array_min(F.array(*(judged(i, *g) for i, g in enumerate(grids))))
    return F.when(multiple > 1, F.struct(best["columns"].alias("columns"), best["rows"].alias("rows")))


def sliced_text(width: Column, height: Column, number: Column, p: Processor, most: int, use_image_id: bool) -> Column:
    """The picture as a whole, then its slices row by row."""
    features = UNKNOWN_TOKEN * p.slice_tokens
    whole = F.concat(F.lit("<image_id>"), number.cast("string"), F.lit("</image_id>")) if use_image_id else F.lit("")
    part = f"<slice>{features}</slice>"

    def rows(grid: Column) -> Column:
        line = F.repeat(F.lit(part), grid["columns"])
        return F.when(grid.isNull(), F.lit("")).otherwise(F.concat(F.repeat(F.concat(line, F.lit("\n")), grid["rows"] - 1), line))

    return F.concat(whole, F.lit(f"<image>{features}</image>"), bound(slice_grid(width, height, p, most), rows))


def sampled_frames(item: Column, p: Processor) -> Column:
    """How many frames of a video are taken."""
    wanted = F.least(item["frames"], F.lit(p.video_frames), F.floor(item["seconds"] * p.video_fps)).cast("int")
    return F.when(item["frames"] == 0, F.lit(p.video_frames)).otherwise(wanted)


def within(item: Column, pixels: tuple[int, int], plugin: str) -> Column:
    """The item's sides as a struct, scaled into the bounds in pixels."""
    width, height = multimodal.resized(item["width"], item["height"], *pixels)
    first = F.struct(width.alias("width"), height.alias("height"))
    if plugin != "qwen2_vl":
        return first

    def long_enough(s: Column) -> Column:
        wide, high = multimodal.vision_sides(s["width"], s["height"])
        return F.struct(wide.cast("int").alias("width"), high.cast("int").alias("height"))

    return bound(first, long_enough)


def image_item(plugin: str, token: str, p: Processor, s: Column, number: Column) -> Column:
    """Tokens (or the text) of one image with the sides ``s``."""
    if plugin in ("llava_next", "llava_next_video"):
        return tiled_tokens(s["width"], s["height"], p)
    if plugin == "qwen2_vl":
        wide, high = grid_sides(s["width"], s["height"], p)
        return multimodal.grid_tokens(F.lit(1), high / p.patch, wide / p.patch, p.merge)
    if plugin == "pixtral":
        wide, high = row_sides(s["width"], s["height"], p)
        return multimodal.row_tokens(wide, high, p.patch, token, p.break_token, p.end_token)
    if plugin == "minicpm_v":
        return sliced_text(s["width"], s["height"], number, p, p.most_slices, p.use_image_id)
    # A fixed square, whatever the size.
    square = (p.side // p.patch) ** 2
    extra = 0 if plugin == "paligemma" else p.extra_tokens - int(p.default_strategy)
    return F.lit(square + extra)


def video_item(plugin: str, p: Processor, s: Column, frames: Column) -> Column:
    """Tokens (or the text) of one video of so many frames."""
    if plugin == "qwen2_vl":
        wide, high = grid_sides(s["width"], s["height"], p)
        pairs = F.ceil(frames / 2)
        return multimodal.grid_tokens(pairs, high / p.patch, wide / p.patch, p.merge)
    if plugin == "minicpm_v":
        return F.repeat(sliced_text(s["width"], s["height"], F.lit(0), p, p.video_slices, False), frames)
    square = (p.side // p.patch) ** 2
    if plugin == "llava_next_video":
        return F.lit(square // 4) * frames
    # One more token a frame, which only images drop.
    return F.lit(square + p.extra_tokens) * frames


def audio_item(item: Column, p: Processor) -> Column:
    """Tokens of a recording: features a hop apart, up to the longest one, halved twice."""
    samples = F.when(item["samples"].isNotNull() & (item["rate"] > 0), F.ceil(item["samples"] * F.lit(float(p.sampling_rate)) / item["rate"])).otherwise(F.ceil(item["seconds"] * p.sampling_rate))
    return multimodal.audio_tokens(F.least(F.ceil(samples / p.hop), F.lit(p.most_features)))


def item_tokens(plugin: str, kind: str, token: str, sizes: Column, processor: Processor | None = None) -> Column:
    """What ``multimodal.process_messages`` takes for one kind of media, from the items' sizes: an
    array of counts, or of texts. An item whose size isn't known is an error."""
    p = processor or PROCESSORS[plugin]
    known = (lambda x: x["samples"].isNotNull() | x["seconds"].isNotNull()) if kind == "audio" else (lambda x: (x["width"] > 0) & (x["height"] > 0))

    def made(item: Column, i: Column) -> Column:
        if kind == "audio":
            return audio_item(item, p)
        if kind == "image":
            return bound(within(item, p.image_pixels, plugin), lambda s: image_item(plugin, token, p, s, i))
        return bound(within(item, p.video_pixels, plugin), lambda s: video_item(plugin, p, s, sampled_frames(item, p)))

    text = plugin in ("pixtral", "minicpm_v")
    lost = F.raise_error(F.lit(f"The size of an {kind} input is not known."))
    one = lambda x, i: F.when(F.coalesce(known(x), F.lit(False)), made(x, i)).otherwise(lost.cast("string" if text else "int"))
    return F.transform(sizes, lambda x, i: one(x, i).cast("string" if text else "int"))
