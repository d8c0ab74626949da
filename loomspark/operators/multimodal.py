"""Media placeholders in chat text and the sizes behind them.

Pixels are not touched: what a model sees of an image follows from its width and height.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions.text import IGNORE, count_of

IMAGE, VIDEO, AUDIO = "<image>", "<video>", "<audio>"
#: Bounds of images and of video frames in pixels, frames a second, most frames.
IMAGE_PIXELS = (32 * 32, 768 * 768)
VIDEO_PIXELS = (16 * 16, 256 * 256)
VIDEO_FPS, VIDEO_FRAMES = 2.0, 128

#: Built-in plugins, and how registered ones expand messages: (tokens, messages, sizes) -> messages.
Expand = Callable[[dict[str, str], Column, dict[str, Column]], Column]
PLUGINS = {"base", "llava", "llava_next", "llava_next_video", "minicpm_v", "mllama", "paligemma", "pixtral", "qwen2_audio", "qwen2_vl", "video_llava"}


REGISTERED: dict[str, Expand] = {}


def register_plugin(name: str, expand: Expand) -> None:
    """Add a plugin by what it makes of the messages of a template that names it."""
    if name in PLUGINS or name in REGISTERED:
        raise ValueError(f"A media plugin named {name} exists already.")
    REGISTERED[name] = expand


def placeholders(messages: Column, mark: str) -> Column:
    """Occurrences of a placeholder in all messages."""
    return F.aggregate(messages, F.lit(0), lambda n, m: n + count_of(m["content"], mark))


def checked(messages: Column, media: Column, mark: str, supported: bool = True) -> Column:
    """The messages, or an error if there are other numbers of placeholders and media."""
    n = F.coalesce(F.size(media), F.lit(0))
    n = F.greatest(n, F.lit(0))
    if not supported:
        return F.when(n > 0, F.raise_error(F.lit(f"This model takes no {mark} input."))).otherwise(messages)
    return F.when(placeholders(messages, mark) != n, F.raise_error(F.lit(f"The number of {mark} inputs is not that of its placeholders."))).otherwise(messages)


def prepended(messages: Column, media: Column, mark: str) -> Column:
    """Media without any placeholder: placeholders go in front of the first message."""
    needed = (F.coalesce(F.size(media), F.lit(0)) > 0) & (placeholders(messages, mark) == 0)
    put = F.transform(messages, lambda m, i: F.when(i == 0, F.struct(m["role"].alias("role"), F.concat(F.repeat(F.lit(mark), F.size(media)), m["content"]).alias("content"))).otherwise(m))
    return F.when(needed, put).otherwise(messages)


def resized(width: Column, height: Column, least: int = IMAGE_PIXELS[0], most: int = IMAGE_PIXELS[1]) -> tuple[Column, Column]:
    """Sides scaled into the bounds, cut to whole pixels at each of the two steps."""
    for over, limit in ((lambda a: a > most, most), (lambda a: a < least, least)):
        area = width.cast("double") * height
        factor = F.sqrt(F.lit(float(limit)) / area)
        width, height = (F.when(over(area), F.floor(x * factor)).otherwise(x).cast("int") for x in (width, height))
    return width, height


def vision_sides(width: Column, height: Column) -> tuple[Column, Column]:
    """Sides with at least 28 pixels and at most 200 times as long as wide (then 180 times)."""
    short = F.least(width, height) < 28
    width, height = F.when(short, F.greatest(width, F.lit(28))).otherwise(width), F.when(short, F.greatest(height, F.lit(28))).otherwise(height)
    wide = width / height > 200
    width = F.when(wide, height * 180).otherwise(width)
    return width, F.when(height / width > 200, width * 180).otherwise(height)


def even_frames(frames: Column) -> Column:
    """Frames of a model that takes them in twos: the last of an odd number comes again."""
    return F.when(F.size(frames) % 2 == 1, F.concat(frames, F.slice(frames, F.lit(-1), F.lit(1)))).otherwise(frames)


def frame_indices(total: Column, seconds: Column, fps: float = VIDEO_FPS, most: int = VIDEO_FRAMES) -> Column:
    """Evenly spaced frames; of a stream without a known number the first ``most``."""
    n = F.least(total, F.lit(most), F.floor(seconds * fps).cast("int"))
    spaced = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.when(n == 1, F.lit(0)).otherwise(F.floor(i * ((total - 1) / F.greatest(n - 1, F.lit(1))))).cast("int"))
    known = F.when(n > 0, spaced).otherwise(F.array().cast("array<int>"))
    return F.when(total == 0, F.sequence(F.lit(0), F.lit(most - 1))).otherwise(known)


def patches(width: Column, height: Column, patch: int) -> Column:
    return (F.floor(height / patch) * F.floor(width / patch)).cast("int")


# Token counts of one medium.
def video_average_tokens(width: Column, height: Column, patch: int, frames: Column) -> Column:
    """Frames whose patches are averaged by four."""
    return (F.floor(patches(width, height, patch) / 4) * frames).cast("int")


def frame_tokens(width: Column, height: Column, patch: int, frames: Column, default_strategy: bool = True) -> tuple[Column, Column]:
    """Image and video tokens with one extra token a frame, which images drop by default."""
    each = patches(width, height, patch) + 1
    return each - 1 if default_strategy else each, each * frames


def grid_tokens(time: Column, height: Column, width: Column, merge: int = 2) -> Column:
    return F.floor(time * height * width / (merge * merge)).cast("int")


def audio_tokens(frames: Column) -> Column:
    """Two halvings of the feature length."""
    half = F.floor((frames - 1) / 2) + 1
    return (F.floor((half - 2) / 2) + 1).cast("int")


def row_tokens(width: Column, height: Column, patch: int, token: str, stop: str, end: str) -> Column:
    """Rows of tokens, each closed by a break and the last by an end."""
    rows, columns = F.floor(height / patch).cast("int"), F.floor(width / patch).cast("int")
    row = F.concat(F.repeat(F.lit(token), columns), F.lit(stop))
    return F.concat(F.repeat(row, rows - 1), F.repeat(F.lit(token), columns), F.lit(end))


def expand(messages: Column, mark: str, replacement: Callable[[Column], Column]) -> Column:
    """Each placeholder replaced by what ``replacement`` makes of its number over all messages."""

    def put(state: Column, m: Column) -> Column:
        parts = F.split(m["content"], f"\\Q{mark}\\E", -1)
        filled = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(replacement(state["n"] + i - 1), p))), "")
        done = F.struct(m["role"].alias("role"), filled.alias("content"))
        return F.struct((state["n"] + F.size(parts) - 1).alias("n"), F.concat(state["out"], F.array(done)).alias("out"))

    none = F.array().cast("array<struct<role:string,content:string>>")
    return F.aggregate(messages, F.struct(F.lit(0).alias("n"), none.alias("out")), put, lambda s: s["out"])


def expand_uniform(messages: Column, mark: str, token: str, count: int = 1) -> Column:
    """Every placeholder replaced by the same number of tokens."""
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), F.replace(m["content"], F.lit(mark), F.lit(token * count)).alias("content")))


def expand_counted(messages: Column, mark: str, token: str, counts: Column, before: str = "", after: str = "") -> Column:
    """The n-th placeholder replaced by as many tokens as the n-th count."""
    return expand(messages, mark, lambda n: F.concat(F.lit(before), F.repeat(F.lit(token), F.element_at(counts, n + 1)), F.lit(after)))


def slice_bounds(ids: Column, start_ids: list[int], end_ids: list[int]) -> Column:
    """(start, end) of the media slices in token ids: after each start token up to its end."""

    def places(wanted: list[int], shift: int) -> Column:
        return F.filter(F.transform(ids, lambda x, i: F.when(x.isin(wanted), i + shift)), lambda i: i.isNotNull())

    starts, ends = places(start_ids, 1), places(end_ids, 0)
    return F.slice(F.arrays_zip(starts.alias("start"), ends.alias("end")), F.lit(1), F.least(F.size(starts), F.size(ends)))


def prefixed(ids: Column, labels: Column, token: int, count: Column) -> tuple[Column, Column, Column]:
    """Image tokens in front of a row: ids, labels that leave them out, and type ids 0 and 1."""
    n = count.cast("int")
    types = F.concat(F.array_repeat(F.lit(0), n), F.array_repeat(F.lit(1), F.size(ids)))
    return F.concat(F.array_repeat(F.lit(token), n), ids), F.concat(F.array_repeat(F.lit(IGNORE), n), labels), types


def expand_texts(messages: Column, mark: str, texts: Column) -> Column:
    """The n-th placeholder replaced by the n-th text, for processors that write their own."""
    return expand(messages, mark, lambda n: F.element_at(texts, n + 1))


def process_messages(plugin: str, tokens: dict[str, str], messages: Column, sizes: dict[str, Column]) -> Column:
    """Messages with their placeholders expanded as a plugin does.

    ``tokens`` names the media tokens; ``sizes`` holds, by medium, arrays with the number of
    tokens of each item (or, for the plugins that write rows or slices, its text).
    """
    if plugin in REGISTERED:
        return REGISTERED[plugin](tokens, messages, sizes)
    if plugin not in PLUGINS:
        raise ValueError(f"There is no media plugin named {plugin}.")
    wraps = {"qwen2_vl": ("<|vision_start|>", "<|vision_end|>"), "qwen2_audio": ("<|audio_bos|>", "<|audio_eos|>")}
    before, after = wraps.get(plugin, ("", ""))
    for kind, mark in (("image", IMAGE), ("video", VIDEO), ("audio", AUDIO)):
        if kind not in tokens:
            continue
        if plugin == "paligemma":
            # Its image tokens go in front of the ids instead (``prefixed``).
            messages = expand_uniform(messages, mark, "")
        elif plugin == "mllama":
            messages = expand_uniform(messages, mark, tokens[kind])
        elif kind not in sizes:
            continue
        elif plugin in ("pixtral", "minicpm_v"):
            messages = expand_texts(messages, mark, sizes[kind])
        else:
            messages = expand_counted(messages, mark, tokens[kind], sizes[kind], before, after)
    return messages
