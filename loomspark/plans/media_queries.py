"""Queries over media: headers, tokens by size, and stages that take their tokens from sizes."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.lineage import cut_lineage
from loomspark.operators import stages, vision
from loomspark.operators.templates import TEMPLATES
from loomspark.plans.chat_queries import NO_TOOLS, QWEN_SYSTEM, sft_digests
from loomspark.plans.tables import canonical, sft_digest_sql, table
from loomspark.sources import media

#: Budget of the stages below: pictures take up to a few thousand tokens.
BUDGET = 6144
#: Turns that a task takes through the stage of one plugin, some seconds of work.
TURNS_A_TASK = 8000


def long(c: Column, name: str) -> Column:
    return c.cast("long").alias(name)


# Headers.
def number(value: Column, size: int, little: bool = False) -> Column:
    """A whole number as hex of so many bytes."""
    text = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.concat(*(F.substring(text, 2 * i - 1, 2) for i in range(size, 0, -1))) if little else text


def box(name: str, *parts: Column) -> Column:
    body = F.concat(*parts)
    return F.concat(number(F.length(body) / 2 + 8, 4), F.lit(name.encode().hex()), body)


def containers(w: Column, h: Column, n: Column) -> list[Column]:
    """Files of sides ``w`` and ``h`` and ``n`` frames (or samples), as hex, with their headers alone."""
    zero = lambda k: F.lit("00" * k)
    png = F.concat(F.lit("89504e470d0a1a0a0000000d49484452"), number(w, 4), number(h, 4), F.lit("0802000000" + "00" * 4), F.lit("000000086163544c"), number(n, 4), zero(8), F.lit("0000000049454e44ae426082"))
    jpeg = F.concat(F.lit("ffd8ffe000104a46494600010100000100010000fffe0006aabbccddffc0001108"), number(h, 2), number(w, 2), F.lit("03012200021101031101ffd9"))
    picture = F.concat(F.lit("21f904000a000000" + "2c" + "00" * 9 + "02024c0100"))
    gif = F.concat(F.lit("474946383961"), number(w, 2, True), number(h, 2, True), F.lit("800000" + "00" * 6), F.repeat(picture, n.cast("int")), F.lit("3b"))
    webp = F.concat(F.lit("52494646000000005745425056503858" + "0a000000" + "00000000"), number(w - 1, 3, True), number(h - 1, 3, True))
    wav = F.concat(F.lit("524946460000000057415645666d742010000000" + "01000100"), number(w + 8000, 4, True), number((w + 8000) * 2, 4, True), F.lit("02001000" + "64617461"), number(n * 2, 4, True), F.repeat(F.lit("0000"), n.cast("int")))
    track = box(
        "trak",
        box("tkhd", zero(76), number(w * 65536, 4), number(h * 65536, 4)),
        box("mdia", box("mdhd", zero(12), F.lit("000003e8"), number(n * 40, 4), zero(4)), box("hdlr", zero(8), F.lit(b"vide".hex()), zero(12)), box("minf", box("stbl", box("stsz", zero(8), number(n, 4))))),
    )
    mp4 = F.concat(box("ftyp", F.lit(b"isom".hex()), zero(4)), box("free", zero(5)), box("moov", box("mvhd", zero(12), F.lit("000003e8"), number(n * 50, 4)), track))
    return [png, jpeg, gif, webp, wav, mp4]


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides and numbers of frames made of document ids."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", (d * 37 % 2500 + 10).alias("w"), (d * 53 % 1900 + 10).alias("h"), (d % 90 + 1).alias("n"))


def src_media_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headers of a file for each document, of six formats in turn; some end within their header."""
    rows = sized(spark, sf_dir)
    which = (F.col("doc_id") % 6).cast("int") + 1
    whole = F.unhex(F.element_at(F.array(*containers(F.col("w"), F.col("h"), F.col("n"))), which))
    content = F.when(F.col("doc_id") % 11 == 0, F.substring(whole, 1, 14)).otherwise(whole)
    info = media.with_info(rows.select("doc_id", content.alias("content"))).select("doc_id", "info.*")
    seconds = F.round("seconds", 6).alias("seconds")
    return info.select("doc_id", "kind", long(F.col("width"), "width"), long(F.col("height"), "height"), "frames", seconds, "samples", long(F.col("rate"), "rate"))


SIZED = "(SELECT doc_id, CAST(doc_id * 37 % 2500 + 10 AS BIGINT) AS w, CAST(doc_id * 53 % 1900 + 10 AS BIGINT) AS h, CAST(doc_id % 90 + 1 AS BIGINT) AS n, doc_id % 6 AS k, doc_id % 11 <> 0 AS ok FROM documents)"
SRC_MEDIA_INFO = f"""SELECT doc_id, ['png', 'jpeg', 'gif', 'webp', 'wav', 'mp4'][k + 1] AS kind,
  CASE WHEN (ok AND k <> 4) OR k = 2 THEN w END AS width, CASE WHEN (ok AND k <> 4) OR k = 2 THEN h END AS height,
  CASE WHEN k = 1 AND ok THEN 1 WHEN k = 2 AND NOT ok OR k = 3 THEN 0 WHEN k <> 4 AND ok THEN n END AS frames,
  CASE WHEN k = 2 AND NOT ok OR k = 3 THEN 0 WHEN k = 2 THEN round(n * 0.1, 6) WHEN NOT ok THEN NULL WHEN k = 4 THEN round(n / (w + 8000.0), 6) WHEN k = 5 THEN round(n * 0.04, 6) END AS seconds,
  CASE WHEN k = 4 AND ok THEN n END AS samples, CASE WHEN k = 4 AND ok THEN w + 8000 END AS rate FROM {SIZED}"""


# Tokens by size.
def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's picture, video or recording as one item."""
    w, h, n = F.col("w").cast("int"), F.col("h").cast("int"), F.col("n").cast("long")
    item = F.struct(w.alias("width"), h.alias("height"), n.alias("frames"), (n / 7.0).alias("seconds"), (n * 4000).alias("samples"), (w + 8000).alias("rate"))
    return sized(spark, sf_dir).select("doc_id", F.array(item).alias("items"))


def mm_size_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that each plugin gives an item of the size."""
    one = lambda plugin, kind: vision.item_tokens(plugin, kind, "#", F.col("items"))[0]
    rows = one("pixtral", "image")
    return items(spark, sf_dir).select(
        "doc_id",
        *(long(one(plugin, "image"), f"{plugin}_image") for plugin in ("llava", "llava_next", "paligemma", "video_llava", "qwen2_vl")),
        *(long(one(plugin, "video"), f"{plugin}_video") for plugin in ("llava_next_video", "video_llava", "qwen2_vl")),
        long(one("qwen2_audio", "audio"), "qwen2_audio"),
        F.md5(rows).alias("pixtral_md5"),
        F.md5(one("minicpm_v", "image")).alias("minicpm_v_md5"),
        F.md5(one("minicpm_v", "video")).alias("minicpm_v_video_md5"),
    )


def resized_sql(source: str, least: int, most: int, name: str) -> str:
    """CTEs that scale (id, w, h) of a source into bounds: ``name`` holds id, w and h."""
    return f"""{name}_0 AS (SELECT id, CASE WHEN w * h > {most} THEN floor(w * sqrt({most}.0::DOUBLE / (w::DOUBLE * h))) ELSE w END AS w, CASE WHEN w * h > {most} THEN floor(h * sqrt({most}.0::DOUBLE / (w::DOUBLE * h))) ELSE h END AS h FROM {source}),
{name} AS (SELECT id, CAST(CASE WHEN w * h < {least} THEN floor(w * sqrt({least}.0::DOUBLE / (w::DOUBLE * h))) ELSE w END AS BIGINT) AS w, CAST(CASE WHEN w * h < {least} THEN floor(h * sqrt({least}.0::DOUBLE / (w::DOUBLE * h))) ELSE h END AS BIGINT) AS h FROM {name}_0)"""


def tiles_sql(source: str, name: str) -> str:
    """The tokens of the tiling plugins: ``name`` holds id and tokens."""
    listed = ", ".join(f"{{'i': {i}, 'h': {h}, 'w': {w}}}" for i, (h, w) in enumerate(vision.TILINGS))
    return f"""{name}_0 AS (SELECT id, w, h, unnest([{listed}]) AS g FROM {source}),
{name}_1 AS (SELECT *, least(CAST(floor(w * least(g.w::DOUBLE / w, g.h::DOUBLE / h)) * floor(h * least(g.w::DOUBLE / w, g.h::DOUBLE / h)) AS BIGINT), w * h) AS kept FROM {name}_0),
{name}_2 AS (SELECT *, g.h // 336 * 24 AS high, g.w // 336 * 24 AS wide FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY kept DESC, g.h * g.w - kept, g.i) AS r FROM {name}_1) WHERE r = 1),
{name}_3 AS (SELECT id, CASE WHEN w::DOUBLE / h > wide::DOUBLE / high THEN high - (high - CAST(trunc(round(h * (wide::DOUBLE / w), 7)) AS BIGINT)) // 2 * 2 ELSE high END AS rows,
  CASE WHEN w::DOUBLE / h > wide::DOUBLE / high THEN wide ELSE wide - (wide - CAST(trunc(round(w * (high::DOUBLE / h), 7)) AS BIGINT)) // 2 * 2 END AS cols FROM {name}_2),
{name} AS (SELECT id, CAST(rows * cols + rows + 576 AS BIGINT) AS tokens FROM {name}_3)"""


def grid_sql(source: str, name: str) -> str:
    """Sides in units of 28 pixels within the bounds of the grid plugin: ``name`` holds id, w and h."""
    side = lambda x: f"CASE WHEN a > 1003520 THEN greatest(floor({x} / sqrt(w::DOUBLE * h / 1003520) / 28), 1) WHEN a < 3136 THEN ceil({x} * sqrt(3136.0::DOUBLE / (w::DOUBLE * h)) / 28) ELSE round_even({x} / 28.0::DOUBLE, 0) END"
    bounded = f"(SELECT id, CASE WHEN w0 > 200 * h0 THEN h0 * 180 ELSE w0 END AS w, CASE WHEN h0 > 200 * w0 THEN w0 * 180 ELSE h0 END AS h FROM (SELECT id, greatest(w, 28) AS w0, greatest(h, 28) AS h0 FROM {source}))"
    return f"""{name}_0 AS (SELECT *, round_even(w / 28.0::DOUBLE, 0) * 28 * round_even(h / 28.0::DOUBLE, 0) * 28 AS a FROM {bounded}),
{name} AS (SELECT id, CAST({side('w')} AS BIGINT) AS w, CAST({side('h')} AS BIGINT) AS h FROM {name}_0)"""


def slices_sql(source: str, name: str, most: int, use_id: bool) -> str:
    """The texts of the slicing plugin: ``name`` holds id and text."""
    grids = [(n, m, n // m) for n in range(2, most + 1) for m in range(1, n + 1) if n % m == 0]
    listed = ", ".join(f"{{'i': {i}, 'n': {n}, 'c': {c}, 'r': {r}}}" for i, (n, c, r) in enumerate(grids))
    part = "'<slice>' || repeat('<unk>', 64) || '</slice>'"
    head = "'<image_id>0</image_id>' || " if use_id else ""
    return f"""{name}_0 AS (SELECT id, w, h, CAST(least(ceil(w * h / 200704.0::DOUBLE), {most}) AS BIGINT) AS multiple FROM {source}),
{name}_1 AS (SELECT *, unnest([{listed}]) AS g FROM {name}_0 WHERE multiple > 1),
{name}_2 AS (SELECT id, arg_min(g, {{'e': abs(ln(w::DOUBLE / h) - ln(g.c::DOUBLE / g.r)), 'i': g.i}}) AS g FROM {name}_1 WHERE abs(g.n - multiple) <= 1 GROUP BY id),
{name} AS (SELECT a.id, {head}'<image>' || repeat('<unk>', 64) || '</image>' || CASE WHEN b.id IS NULL THEN '' ELSE repeat(repeat({part}, CAST(b.g.c AS BIGINT)) || chr(10), CAST(b.g.r AS BIGINT) - 1) || repeat({part}, CAST(b.g.c AS BIGINT)) END AS text
  FROM {name}_0 a LEFT JOIN {name}_2 b ON a.id = b.id)"""


def row_text_sql(w: str, h: str) -> str:
    """The text of the row plugin for sides of at most 1024."""
    columns, rows = f"CAST(({w} - 1) // 16 + 1 AS BIGINT)", f"CAST(({h} - 1) // 16 + 1 AS BIGINT)"
    return f"repeat(repeat('{{token}}', {columns}) || '[IMG_BREAK]', {rows} - 1) || repeat('{{token}}', {columns}) || '[IMG_END]'"


IMAGES, VIDEOS = (1024, 589824), (256, 65536)
#: Sides of a picture within 1024, as the row plugin cuts them.
EDGE = "(SELECT id, CASE WHEN greatest(w, h) > 1024 THEN CAST(floor(w / (greatest(w, h) / 1024.0::DOUBLE)) AS BIGINT) ELSE w END AS w, CASE WHEN greatest(w, h) > 1024 THEN CAST(floor(h / (greatest(w, h) / 1024.0::DOUBLE)) AS BIGINT) ELSE h END AS h FROM {})"
MM_SIZE_TOKENS = f"""WITH p AS (SELECT doc_id AS id, w, h, n FROM {SIZED}),
{resized_sql('p', *IMAGES, 'i')}, {resized_sql('p', *VIDEOS, 'v')}, {tiles_sql('i', 't')}, {grid_sql('i', 'g')}, {grid_sql('v', 'q')},
{slices_sql('i', 's', 9, True)}, {slices_sql('v', 'u', 2, False)},
f AS (SELECT id, CAST(least(n, 128, floor(n / 7.0::DOUBLE * 2.0)) AS BIGINT) AS frames, w + 8000 AS rate, n * 4000 AS samples FROM p),
a AS (SELECT id, CAST(least(ceil(ceil(samples * 16000.0::DOUBLE / rate) / 160), 3000) AS BIGINT) AS l FROM f)
SELECT p.id AS doc_id, CAST(576 AS BIGINT) AS llava_image, t.tokens AS llava_next_image, CAST(256 AS BIGINT) AS paligemma_image, CAST(256 AS BIGINT) AS video_llava_image, g.w * g.h AS qwen2_vl_image,
  CAST(144 * f.frames AS BIGINT) AS llava_next_video_video, CAST(257 * f.frames AS BIGINT) AS video_llava_video, CAST((f.frames + 1) // 2 * q.w * q.h AS BIGINT) AS qwen2_vl_video,
  CAST(((a.l - 1) // 2 + 1 - 2) // 2 + 1 AS BIGINT) AS qwen2_audio, md5({row_text_sql('e.w', 'e.h').format(token='#')}) AS pixtral_md5,
  md5(s.text) AS minicpm_v_md5, md5(repeat(u.text, f.frames)) AS minicpm_v_video_md5
FROM p JOIN t ON t.id = p.id JOIN g ON g.id = p.id JOIN q ON q.id = p.id JOIN s ON s.id = p.id JOIN u ON u.id = p.id JOIN f ON f.id = p.id JOIN a ON a.id = p.id JOIN {EDGE.format('i')} e ON e.id = p.id"""


# Stages.
PLUGINS = ("llava_next", "qwen2_vl", "pixtral", "minicpm_v")


def prc_mm_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture in front of every first question, whose tokens follow from the header of its file."""
    chats = canonical(spark, sf_dir)
    w, h = F.col("conv_id") * 37 % 2500 + 10, F.col("conv_id") * 53 % 1900 + 10
    pictures = chats.select(F.concat(F.lit("p"), F.col("conv_id")).alias("name"), F.concat(F.lit("/m/p"), F.col("conv_id")).alias("path"), F.unhex(containers(w, h, F.lit(1))[0]).alias("content"))
    listing = media.with_info(pictures).select("name", "path", "info.*").dropDuplicates(["path"])
    marked = F.transform("_prompt", lambda m, i: F.when(i == 0, F.struct(m["role"].alias("role"), F.concat(F.lit("<image>"), m["content"]).alias("content"))).otherwise(m))
    rows = chats.withColumns({"_prompt": marked, "_images": F.array(F.concat(F.lit("p"), F.col("conv_id")))})
    # Every plugin starts from these rows. Stages cost far more than the rows' bytes say, so tasks
    # follow from the turns; put together by bytes they would be too few.
    tasks = table(spark, sf_dir, "conversations").count() // TURNS_A_TASK + 1
    rows = cut_lineage(media.with_sizes(rows, listing, "conv_id").repartition(tasks, "conv_id"))
    made = []
    for plugin in PLUGINS:
        token = "[IMG]" if plugin == "pixtral" else "#"
        template = replace(TEMPLATES["qwen2_vl"], mm_plugin=plugin, mm_tokens=(("image", token),))
        out = stages.process_sft(rows, template, BUDGET, keep=["conv_id"], **NO_TOOLS)
        made.append(sft_digests(out).withColumn("plugin", F.lit(plugin)))
    return reduce(DataFrame.unionByName, made)


def _prc_mm_sizes_sql() -> str:
    pictures = "(SELECT DISTINCT conv_id AS id, CAST(conv_id * 37 % 2500 + 10 AS BIGINT) AS w, CAST(conv_id * 53 % 1900 + 10 AS BIGINT) AS h FROM conversations)"
    i = resized_sql(pictures, *IMAGES, "i")
    texts = {
        "llava_next": f"WITH {i}, {tiles_sql('i', 't')} SELECT repeat('#', tokens) FROM t WHERE t.id = conv_id",
        "qwen2_vl": f"WITH {i}, {grid_sql('i', 'g')} SELECT '<|vision_start|>' || repeat('#', g.w * g.h) || '<|vision_end|>' FROM g WHERE g.id = conv_id",
        "pixtral": f"WITH {i} SELECT {row_text_sql('e.w', 'e.h').format(token='[IMG]')} FROM {EDGE.format('i')} e WHERE e.id = conv_id",
        "minicpm_v": f"WITH {i}, {slices_sql('i', 's', 9, True)} SELECT s.text FROM s WHERE s.id = conv_id",
    }
    parts = []
    for plugin, text in texts.items():
        sql = sft_digest_sql(system=QWEN_SYSTEM.format(more="''"), asked=f"(CASE WHEN i = 1 THEN ({text}) ELSE '' END || m[2*i-1].text)", cutoff=BUDGET)
        parts.append(f"SELECT *, '{plugin}' AS plugin FROM ({sql})")
    return " UNION ALL ".join(parts)


PRC_MM_SIZES = _prc_mm_sizes_sql()
QUERIES = "src_media_info mm_size_tokens prc_mm_sizes".split()


def queries() -> dict:
    return {name: globals()[name] for name in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
