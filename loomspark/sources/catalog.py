"""The dataset registry: which source, format and columns a named dataset has."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

COLUMNS = ("prompt", "query", "response", "history", "messages", "system", "tools", "images", "videos", "audios", "chosen", "rejected", "kto_tag")
TAGS = ("role_tag", "content_tag", "user_tag", "assistant_tag", "observation_tag", "function_tag", "system_tag")


@dataclass(frozen=True)
class DatasetSpec:
    """One dataset: where it is loaded from, its format, its columns and its role tags."""

    name: str
    load_from: str = "file"
    formatting: str = "alpaca"
    ranking: bool = False
    subset: str | None = None
    split: str = "train"
    folder: str | None = None
    num_samples: int | None = None
    prompt: str | None = "instruction"
    query: str | None = "input"
    response: str | None = "output"
    history: str | None = None
    messages: str | None = "conversations"
    system: str | None = None
    tools: str | None = None
    images: str | None = None
    videos: str | None = None
    audios: str | None = None
    chosen: str | None = None
    rejected: str | None = None
    kto_tag: str | None = None
    role_tag: str | None = "from"
    content_tag: str | None = "value"
    user_tag: str | None = "human"
    assistant_tag: str | None = "gpt"
    observation_tag: str | None = "observation"
    function_tag: str | None = "function_call"
    system_tag: str | None = "system"

    def merged(self, entry: dict) -> DatasetSpec:
        """With a registry entry's settings.

        An entry that names any column names all of them: those it leaves out become unset,
        not their default. The same holds for tags.
        """
        given = {k: entry[k] for k in ("formatting", "ranking", "subset", "split", "folder", "num_samples") if k in entry}
        for group, names in (("columns", COLUMNS), ("tags", TAGS)):
            if group in entry:
                given |= {n: entry[group].get(n) for n in names}
        return replace(self, **given)


#: Which key of an entry names its source, by precedence, and what it is loaded from.
HUBS = (("ms_hub_url", "modelscope"), ("om_hub_url", "openmind"), ("hf_hub_url", "huggingface"))


def spec_of(name: str, entry: dict, preferred_hub: str = "huggingface") -> DatasetSpec:
    urls = {kind: entry[key] for key, kind in HUBS if key in entry}
    if urls:
        kind = preferred_hub if preferred_hub in urls else "huggingface" if "huggingface" in urls else next(iter(urls))
        base = DatasetSpec(urls[kind], kind)
    elif "script_url" in entry:
        base = DatasetSpec(entry["script_url"], "script")
    else:
        base = DatasetSpec(entry["file_name"], "file")
    return base.merged(entry)


def load_registry(folder: str) -> dict[str, dict]:
    return json.loads(Path(folder, "dataset_info.json").read_text(encoding="utf-8"))


def remote_registry(repository: str, hub: str) -> dict[str, dict]:
    """The registry of a repository on a hub."""
    from loomspark.sources.hubs import fetch_file

    return json.loads(fetch_file(hub, repository, "dataset_info.json"))


def dataset_specs(names: list[str], registry: dict[str, dict] | str | None, preferred_hub: str = "huggingface") -> list[DatasetSpec]:
    """The specs of named datasets; without a registry ("ONLINE") names are hub datasets. A
    registry is a folder, a table of entries, or ``REMOTE:<repository>`` on a hub."""
    if registry == "ONLINE":
        return [DatasetSpec(n, preferred_hub) for n in names]
    if isinstance(registry, str):
        try:
            registry = remote_registry(registry.removeprefix("REMOTE:"), preferred_hub) if registry.startswith("REMOTE:") else load_registry(registry)
        except (OSError, ValueError) as e:
            if names:
                raise ValueError(f"The dataset registry in {registry} can't be read: {e}") from e
            registry = {}
    unknown = [n for n in names if n not in (registry or {})]
    if unknown:
        raise ValueError(f"Undefined dataset {unknown[0]} in the registry.")
    return [spec_of(n, registry[n], preferred_hub) for n in names]


def catalog_table(spark: SparkSession, registry: dict[str, dict]) -> DataFrame:
    """The registry as a table: name, formatting, ranking, source."""
    rows = []
    for name, entry in sorted(registry.items()):
        spec = spec_of(name, entry)
        rows.append((name, spec.formatting, bool(spec.ranking), spec.load_from, spec.name))
    return spark.createDataFrame(rows, "dataset string, formatting string, ranking boolean, load_from string, location string")


def usable_datasets(catalog: DataFrame, stage: str) -> DataFrame:
    """Datasets whose ranking flag is what the stage needs."""
    return catalog.where(catalog["ranking"] == (stage in ("rm", "dpo")))


def check_stage(spec: DatasetSpec, stage: str) -> None:
    if spec.ranking != (stage in ("rm", "dpo")):
        raise ValueError("The dataset is not applicable in the current training stage.")


def column_names(spec: DatasetSpec) -> list[str]:
    """Columns of the source that the spec refers to."""
    return [getattr(spec, f.name) for f in fields(spec) if f.name in COLUMNS and getattr(spec, f.name)]
