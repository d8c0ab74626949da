"""Sources beyond plain files: Arrow files, dataset hubs and registered scripts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspark.sources.catalog import DatasetSpec

HUBS = ("huggingface", "modelscope", "openmind")
_READERS: dict[str, Callable[[SparkSession, DatasetSpec], DataFrame]] = {}
_SCRIPTS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


_STREAMS: dict[str, Callable[[SparkSession, DatasetSpec, int], DataFrame]] = {}


def register_hub(name: str, reader: Callable[[SparkSession, DatasetSpec], DataFrame], stream: Callable[[SparkSession, DatasetSpec, int], DataFrame] | None = None) -> None:
    """Install what reads a hub's datasets, and what streams them (with so many files a batch).

    ``mirror.register_mirror`` does so for a folder of repositories; clients that go to the network
    take their own libraries.
    """
    _READERS[name] = reader
    if stream is not None:
        _STREAMS[name] = stream


def stream_hub(spark: SparkSession, spec: DatasetSpec, files_per_batch: int = 1) -> DataFrame:
    if spec.load_from not in _STREAMS:
        raise ValueError(f"No stream is registered for the {spec.load_from} hub, which {spec.name} needs.")
    return _STREAMS[spec.load_from](spark, spec, files_per_batch)


def read_hub(spark: SparkSession, spec: DatasetSpec) -> DataFrame:
    if spec.load_from not in HUBS:
        raise NotImplementedError(f"Unknown source: {spec.load_from}.")
    if spec.load_from not in _READERS:
        raise RuntimeError(f"No reader is registered for the {spec.load_from} hub, which {spec.name} needs.")
    return _READERS[spec.load_from](spark, spec)


_FILES: dict[str, Callable[[str, str], str]] = {}


def register_files(name: str, fetch: Callable[[str, str], str]) -> None:
    """Install what fetches the text of a file (repository, file) from a hub."""
    _FILES[name] = fetch


def fetch_file(hub: str, repository: str, file: str) -> str:
    if hub not in _FILES:
        raise OSError(f"Nothing is registered to fetch {file} of {repository} from the {hub} hub.")
    return _FILES[hub](repository, file)


def register_script(name: str, builder: Callable[[SparkSession, str], DataFrame]) -> None:
    """Register a dataset builder under the name that a registry's ``script_url`` has."""
    if name in _SCRIPTS:
        raise ValueError(f"A dataset script named {name} exists already.")
    _SCRIPTS[name] = builder


def read_script(spark: SparkSession, spec: DatasetSpec, folder: str) -> DataFrame:
    if spec.name not in _SCRIPTS:
        raise ValueError(f"There is no dataset script named {spec.name}.")
    return _SCRIPTS[spec.name](spark, folder)


def read_arrow(spark: SparkSession, files: list[str]) -> DataFrame:
    """Arrow IPC files or streams, one task a file: bytes are fetched by Spark, so any file
    system works, and batches become rows in the executors."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    def opened(content: bytes) -> pa.RecordBatchReader | pa.RecordBatchFileReader:
        buffer = pa.BufferReader(content)
        return pa.ipc.open_file(buffer) if content[:6] == b"ARROW1" else pa.ipc.open_stream(buffer)

    raw = spark.read.format("binaryFile").load(files).select("content")
    first = opened(bytes(spark.read.format("binaryFile").load(files[0]).select("content").first()[0]))
    schema = first.schema

    def rows(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                reader = opened(content)
                for part in pa.Table.from_batches(list(reader) if not hasattr(reader, "num_record_batches") else [reader.get_batch(i) for i in range(reader.num_record_batches)], schema).to_batches():
                    yield part

    return raw.mapInArrow(rows, from_arrow_schema(schema))
