"""Reading datasets of a spec, benchmark suites, logs and tokenized folders."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.sources import hubs
from loomspark.sources.catalog import DatasetSpec

#: The format of each file name extension.
FORMATS = {"arrow": "arrow", "csv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet", "txt": "text"}


def hadoop_path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def list_files(spark: SparkSession, path: str) -> list[str]:
    """A file, or the files of a folder in the order of their names, on any file system."""
    place, system = hadoop_path(spark, path)
    if not system.exists(place):
        raise ValueError(f"There is no file at {path}.")
    if system.getFileStatus(place).isFile():
        return [path]
    listed = [s.getPath() for s in system.listStatus(place) if s.isFile()]
    return sorted(str(p) for p in listed if not p.getName().startswith(("_", ".")))


def format_of(files: list[str]) -> str:
    kinds = {FORMATS.get(os.path.splitext(f)[1].lstrip(".").lower()) for f in files}
    if not files or None in kinds:
        raise ValueError("The file type is not known.")
    if len(kinds) > 1:
        raise ValueError("File types should be identical.")
    return kinds.pop()


def is_json_list(spark: SparkSession, file: str) -> bool:
    """Whether a JSON file holds one list rather than a row a line."""
    place, system = hadoop_path(spark, file)
    stream = system.open(place)
    try:
        while (byte := stream.read()) >= 0:
            if not chr(byte).isspace() and byte not in (0xEF, 0xBB, 0xBF):
                return byte == ord("[")
        return False
    finally:
        stream.close()


def read_files(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A dataset of one file, or of a folder of files of one type; text has one row a line."""
    files = list_files(spark, path)
    kind = format_of(files)
    return read_as(spark, files, kind, schema)


def read_as(spark: SparkSession, files: list[str], kind: str, schema: str | None = None) -> DataFrame:
    """Files of one of FORMATS."""
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "json":
        return reader.option("multiLine", is_json_list(spark, files[0])).json(files)
    if kind == "csv":
        return reader.option("header", True).option("multiLine", True).option("escape", '"').csv(files)
    if kind == "text":
        return spark.read.text(files).withColumnRenamed("value", "text")
    if kind == "arrow":
        return hubs.read_arrow(spark, files)
    return reader.parquet(*files)


def stream_dataset(spark: SparkSession, spec: DatasetSpec, folder: str = "", files_per_batch: int = 1) -> DataFrame:
    """The raw rows of a file spec as a stream, file by file, in the schema its files have now."""
    if spec.load_from in hubs.HUBS:
        return hubs.stream_hub(spark, spec, files_per_batch)
    if spec.load_from != "file":
        raise ValueError("Only datasets of files and hubs can be streamed.")
    path = os.path.join(folder, spec.name) if folder else spec.name
    files = list_files(spark, path)
    kind = format_of(files)
    if kind == "arrow":
        raise ValueError("Arrow files can't be streamed.")
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    # A stream reads folders or patterns; a pattern that fits one file stands for it.
    place = re.sub(r"([^/])([^/]*)$", r"[\1]\2", path) if files == [path] else path
    if kind == "text":
        return reader.text(place).withColumnRenamed("value", "text")
    reader = reader.schema(read_files(spark, path).schema)
    if kind == "json":
        return reader.option("multiLine", is_json_list(spark, files[0])).json(place)
    if kind == "csv":
        return reader.option("header", True).option("multiLine", True).option("escape", '"').csv(place)
    return reader.parquet(place)


def input_state(spark: SparkSession, spec: DatasetSpec, folder: str = "") -> list[tuple[str, int, int]]:
    """Path, size and time of change of the files of a spec; none for other sources."""
    if spec.load_from != "file":
        return []
    out = []
    for file in list_files(spark, os.path.join(folder, spec.name) if folder else spec.name):
        place, system = hadoop_path(spark, file)
        found = system.getFileStatus(place)
        out.append((file, found.getLen(), found.getModificationTime()))
    return out


def read_dataset(spark: SparkSession, spec: DatasetSpec, folder: str = "") -> DataFrame:
    """The raw rows of a dataset spec."""
    if spec.load_from == "file":
        return read_files(spark, os.path.join(folder, spec.name) if folder else spec.name)
    if spec.load_from == "script":
        return hubs.read_script(spark, spec, folder)
    return hubs.read_hub(spark, spec)


QUESTION = "question string, A string, B string, C string, D string, answer string"


def with_subject(df: DataFrame, pattern: str) -> DataFrame:
    return df.withColumn("subject", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def read_mmlu(spark: SparkSession, path: str) -> DataFrame:
    """Headerless files ``<subject>_<split>.csv`` of all subjects in one scan."""
    return with_subject(spark.read.schema(QUESTION).option("header", False).option("multiLine", True).option("escape", '"').csv(path), r"([^/]+)_[a-z]+\.csv$")


def read_ceval(spark: SparkSession, path: str) -> DataFrame:
    """Files with a header; a missing answer or explanation is empty."""
    df = with_subject(spark.read.schema(f"id int, {QUESTION}, explanation string").option("header", True).option("enforceSchema", False).option("multiLine", True).option("escape", '"').csv(path), r"([^/]+)_[a-z]+\.csv$")
    return df.withColumns({c: F.coalesce(c, F.lit("")) for c in ("answer", "explanation")})


def read_cmmlu(spark: SparkSession, path: str) -> DataFrame:
    """Files with an index column and capitalised names."""
    df = with_subject(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path), r"([^/]+)\.csv$")
    df = df.withColumnsRenamed({"Question": "question", "Answer": "answer"})
    return df.select("question", "A", "B", "C", "D", "answer", "subject")


SUITES = {"mmlu": read_mmlu, "ceval": read_ceval, "cmmlu": read_cmmlu}


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """subject, name and category of a suite's mapping file, which is small by nature."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,struct<name:string,category:string>>").alias("m"))
    return text.select(F.explode("m").alias("subject", "v")).select("subject", "v.name", "v.category")


def with_category(items: DataFrame, mapping: DataFrame) -> DataFrame:
    """Items with their subject's category; the optimizer broadcasts a mapping that is small."""
    return items.join(mapping.select("subject", "category"), "subject")


LOG = "current_steps int, total_steps int, loss double, eval_loss double, predict_loss double, reward double, accuracy double, lr double, epoch double, percentage double, elapsed_time string, remaining_time string, throughput double, total_tokens long"


def read_trainer_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).json(path)


def log_tail(text: DataFrame, column: str = "value", length: int = 20_000) -> DataFrame:
    return text.select(F.right(F.col(column), F.lit(length)).alias("tail"))


def latest_record(log: DataFrame, order: tuple[str, ...] = ("current_steps",), by: tuple[str, ...] = ()) -> DataFrame:
    """The record of the last step, of the whole log or of each run."""
    return log.groupBy(*by).agg(F.max_by(F.struct(*log.columns), F.struct(*order)).alias("r")).select("r.*")


def read_trainer_state(spark: SparkSession, path: str) -> DataFrame:
    """The log history of a trainer state, one row a record."""
    return spark.read.option("multiLine", True).json(path).select(F.inline("log_history"))


def with_loss(log: DataFrame, key: str = "loss") -> DataFrame:
    """Records that have a loss; a loss of exactly 0 doesn't count."""
    return log.where(F.col(key).isNotNull() & (F.col(key) != 0))


def loss_series(log: DataFrame, key: str = "loss", order: str = "current_steps") -> DataFrame:
    """A run's losses in order beside their moving average: what a loss plot shows."""
    from loomspark.operators.metrics import smoothed_rows

    # Several records of one step are in the order of their losses.
    rows = with_loss(log, key).select(F.col(order).alias("step"), F.col(key).alias("loss"))
    return smoothed_rows(rows, "loss", ["step", "loss"])


def has_tokenized(spark: SparkSession, path: str) -> bool:
    place, system = hadoop_path(spark, path)
    return system.exists(place) and system.getFileStatus(place).isDirectory() and len(system.listStatus(place)) > 0


def read_tokenized(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The splits of a tokenized folder; a folder of one table is the training set."""
    place, system = hadoop_path(spark, path)
    names = [s.getPath().getName() for s in system.listStatus(place) if s.isDirectory()]
    splits = [n.partition("=")[2] for n in names if n.startswith("split=")]
    if not splits:
        return {"train": spark.read.parquet(path)}
    return {s: spark.read.parquet(f"{path.rstrip('/')}/split={s}") for s in sorted(splits)}


def preview(df: DataFrame, order: str, index: int, size: int = 2) -> tuple[int, DataFrame]:
    """The number of rows and one page of them."""
    from loomspark.operators.mixing import page

    return df.count(), page(df, index, order, size)


def can_preview(spark: SparkSession, registry: dict[str, dict], name: str, folder: str) -> bool:
    entry = registry.get(name, {})
    if "file_name" not in entry:
        return False
    try:
        return len(list_files(spark, os.path.join(folder, entry["file_name"]))) > 0
    except ValueError:
        return False


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """Media files as path, length and bytes; decoding belongs to the model's own code."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def media_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Names and paths of the files of a media folder, listed by the tasks."""
    found = spark.read.format("binaryFile").load(folder).select("path")
    return found.select(F.substring_index("path", "/", -1).alias("name"), "path")


def list_folders(spark: SparkSession, path: str, marker: str | None = None) -> list[str]:
    """Names of sub-folders (checkpoints, outputs), optionally only those holding a file."""
    place, system = hadoop_path(spark, path)
    if not system.exists(place):
        return []
    names = [s.getPath().getName() for s in system.listStatus(place) if s.isDirectory()]
    return sorted(n for n in names if marker is None or system.exists(hadoop_path(spark, f"{path}/{n}/{marker}")[0]))
