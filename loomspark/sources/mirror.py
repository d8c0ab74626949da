"""Dataset repositories of hubs, read from a mirror: a folder on any file system that Spark reads.

A repository is a folder of shards. Which of them a dataset takes follows from names, as hubs
lay them out: a subset is a folder or the beginning of a file's name, a split is a word of a
file's path below it (``train-00000-of-00008.parquet``, ``test/part-0.jsonl``), and a repository
without such words is all training set. Only names reach the driver; shards are read by Spark's
own readers, split by split, so that they are tasks like those of any other files, and
streams see each shard once.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from loomspark.sources import hubs, readers
from loomspark.sources.catalog import DatasetSpec

#: Words for each split.
SPLITS = {"train": ("train", "training"), "validation": ("validation", "valid", "val", "dev"), "test": ("test", "testing", "eval", "evaluation")}


def has_word(path: str, words: tuple[str, ...]) -> bool:
    return re.search(rf"(^|[^a-z])({'|'.join(map(re.escape, words))})([^a-z]|$)", path.lower()) is not None


def all_files(spark: SparkSession, folder: str) -> list[str]:
    """The data files of a folder and its folders, in order, without hidden ones."""
    place, system = readers.hadoop_path(spark, folder)
    if not system.exists(place):
        raise ValueError(f"There is no repository at {folder}.")
    out, open_ = [], [place]
    while open_:
        for status in system.listStatus(open_.pop()):
            name = status.getPath().getName()
            if name.startswith(("_", ".")):
                continue
            if status.isDirectory():
                open_.append(status.getPath())
            elif readers.FORMATS.get(name.rpartition(".")[2].lower()):
                out.append(str(status.getPath()))
    return sorted(out)


def shards(files: list[str], root: str, spec: DatasetSpec) -> list[str]:
    """The files that hold a spec's folder, subset and split."""
    inside = {f: f[f.index(root.rstrip("/")) + len(root.rstrip("/")) + 1 :] for f in files}
    if spec.folder:
        kept = spec.folder.strip("/") + "/"
        inside = {f: n.removeprefix(kept) for f, n in inside.items() if n.startswith(kept)}
    if spec.subset:
        under = {f: n.removeprefix(f"{spec.subset}/") for f, n in inside.items() if n.startswith(f"{spec.subset}/")}
        inside = under or {f: n for f, n in inside.items() if re.match(rf"{re.escape(spec.subset)}([^A-Za-z0-9]|$)", n.rpartition("/")[2])}
    named = {s: [f for f, n in inside.items() if has_word(n, words)] for s, words in SPLITS.items()}
    if not any(named.values()):
        named["train"] = list(inside)
    wanted = [s.strip() for s in (spec.split or "train").split("+")]
    found = [f for s in wanted for f in (named[s] if s in named else [f for f, n in inside.items() if has_word(n, (s.lower(),))])]
    if not found:
        raise ValueError(f"{spec.name} has no files for split {spec.split} of subset {spec.subset}.")
    return found


def located(spark: SparkSession, root: str, spec: DatasetSpec) -> tuple[list[str], str]:
    """The shards of a spec and their format."""
    folder = f"{root.rstrip('/')}/{spec.name}"
    place, system = readers.hadoop_path(spark, folder)
    if not system.exists(place):
        raise ValueError(f"There is no repository at {folder}.")
    found = shards(all_files(spark, folder), str(system.getFileStatus(place).getPath()), spec)
    return found, readers.format_of(found)


def read_mirror(spark: SparkSession, root: str, spec: DatasetSpec) -> DataFrame:
    found, kind = located(spark, root, spec)
    if kind == "json":
        # A shard that holds one list is read as such, the others line by line.
        lists = [f for f in found if readers.is_json_list(spark, f)]
        lines = [f for f in found if f not in lists]
        parts = [spark.read.option("multiLine", many).json(files) for many, files in ((True, lists), (False, lines)) if files]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return readers.read_as(spark, found, kind)


def stream_mirror(spark: SparkSession, root: str, spec: DatasetSpec, files_per_batch: int = 1) -> DataFrame:
    """The shards of a spec as a stream, one after the other; only line formats and Parquet."""
    found, kind = located(spark, root, spec)
    if kind not in ("json", "parquet", "csv", "text") or (kind == "json" and readers.is_json_list(spark, found[0])):
        raise ValueError("Shards of this format can't be streamed.")
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    # One pattern for all shards; what comes before the braces has to be a place.
    base = found[0][: found[0].index(spec.name) + len(spec.name)]
    pattern = base + "/{" + ",".join(re.sub(r"([\\{}\[\]*?,])", r"\\\1", f[len(base) + 1 :]) for f in found) + "}"
    if kind == "text":
        return reader.text(pattern).withColumnRenamed("value", "text")
    reader = reader.schema(read_mirror(spark, root, spec).schema)
    if kind == "csv":
        return reader.option("header", True).option("multiLine", True).option("escape", '"').csv(pattern)
    return getattr(reader, kind)(pattern)


def register_mirror(hub: str, root: str) -> None:
    """Serve a hub (see ``hubs.HUBS``) from the repositories under a folder: ``<root>/<repository>/...``."""
    if hub not in hubs.HUBS:
        raise ValueError(f"There is no hub named {hub}.")
    hubs.register_hub(hub, lambda spark, spec: read_mirror(spark, root, spec), lambda spark, spec, n: stream_mirror(spark, root, spec, n))
    hubs.register_files(hub, lambda repository, file: SparkSession.active().read.text(f"{root.rstrip('/')}/{repository}/{file}", wholetext=True).first()[0])
