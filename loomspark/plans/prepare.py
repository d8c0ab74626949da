"""From dataset names to tokenized train and validation tables, as one lazy plan."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, replace
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.lineage import cut_lineage, shared_folder
from loomspark.functions.text import EOS_ID, TEXT_END_ID, char_ids
from loomspark.operators import collate, mixing, stages
from loomspark.operators.align import align
from loomspark.operators.selection import number_in_place
from loomspark.operators.templates import resolve_template
from loomspark.operators.tools import TOOLS_DATE
from loomspark.sources.catalog import DatasetSpec, check_stage, column_names, dataset_specs
from loomspark.sources.readers import has_tokenized, input_state, read_dataset, read_tokenized, stream_dataset
from loomspark.sources.sinks import write_tokenized
from loomspark.streaming import streams
from loomspark.streaming.streams import mix_streams


#: Formats whose plain texts end with a token of their own.
OWN_TEXT_END = ("llama3",)


@dataclass(frozen=True)
class DataOptions:
    """Settings of data preparation; see ``validate`` for what excludes what."""

    template: str | None = None
    dataset: tuple[str, ...] = ()
    eval_dataset: tuple[str, ...] = ()
    dataset_dir: str = "data"
    cutoff_len: int = 2048
    train_on_prompt: bool = False
    mask_history: bool = False
    streaming: bool = False
    mix_strategy: str = "concat"
    interleave_probs: tuple[float, ...] | None = None
    batch_size: int = 1000
    max_samples: int | None = None
    val_size: float = 0.0
    packing: bool | None = None
    neat_packing: bool = False
    tool_format: str | None = None
    tools_date: str | None = TOOLS_DATE
    tokenized_path: str | None = None
    cache_path: str | None = None
    overwrite_cache: bool = False
    seed: int = 42
    add_bos: bool = False
    predict_with_generate: bool = False

    def validate(self, stage: str) -> None:
        if self.val_size > 1e-6 and not self.dataset:
            raise ValueError("A validation size needs a dataset.")
        if self.val_size > 1e-6 and self.eval_dataset:
            raise ValueError("A validation size and an evaluation dataset exclude each other.")
        if self.interleave_probs:
            mixing.check_mix(self.mix_strategy, len(self.dataset), list(self.interleave_probs))
        if self.streaming and (1e-6 < self.val_size < 1 or self.max_samples is not None):
            raise ValueError("A streamed dataset needs a whole validation size and no max_samples.")
        if self.mask_history and self.train_on_prompt:
            raise ValueError("Training on the prompt and masking the history exclude each other.")
        if (self.train_on_prompt or self.neat_packing) and stage != "sft":
            raise ValueError("Training on the prompt and neat packing are for supervised tuning.")

    def packs(self, stage: str) -> bool:
        return stage == "pt" if self.packing is None else self.packing or self.neat_packing


def load_one(spark: SparkSession, spec: DatasetSpec, options: DataOptions) -> DataFrame:
    """Raw rows, sampled and limited, aligned, with ``rid`` from 0 in file order."""
    raw = read_dataset(spark, spec, options.dataset_dir if spec.load_from != "script" else "")
    raw = raw.select(*dict.fromkeys(c for c in column_names(spec) if c in raw.columns))
    if spec.load_from == "file":
        numbered = number_in_place(raw, touched=None if spec.name.endswith(".parquet") else raw.columns)
    else:
        # A script may give other partitions when it runs again, so its rows are written down.
        numbered = number_in_place(cut_lineage(raw))
    if spec.num_samples and not options.streaming:
        sampled = mixing.sample_rows(numbered, spec.num_samples, "rid", options.seed)
        numbered = mixing.number_rows(sampled, [F.col("draw"), mixing.hash_order(options.seed, F.col("rid")), F.col("rid")], "__rid").drop("rid", "draw").withColumnRenamed("__rid", "rid")
    if options.max_samples is not None:
        numbered = numbered.where(F.col("rid") < options.max_samples)
    return align(numbered, spec, keep=["rid"])


def merged(spark: SparkSession, specs: list[DatasetSpec], options: DataOptions, stage: str) -> DataFrame:
    for spec in specs:
        check_stage(spec, stage)
    parts = [load_one(spark, s, options) for s in specs]
    mixed = mixing.mix(parts, options.mix_strategy, list(options.interleave_probs) if options.interleave_probs else None, options.seed)
    # Every strategy gives positions from 0 without gaps.
    return mixed.withColumn("rid", F.col("mix_pos")).drop("mix_pos", "ds_idx")


def tokenize(rows: DataFrame, stage: str, options: DataOptions, encode: Callable[[Column], Column] = char_ids, is_eval: bool = False) -> DataFrame:
    """Token rows of a stage; batches are consecutive rows of ``batch_size``."""
    template = resolve_template(options.template, options.tool_format, options.train_on_prompt)
    rows = rows.withColumn("batch_id", F.floor(F.col("rid") / options.batch_size))
    keep, generate = ["rid", "batch_id"], options.predict_with_generate and is_eval
    if stage == "pt":
        end = TEXT_END_ID if options.template in OWN_TEXT_END else EOS_ID
        made = stages.process_pretrain(rows, 2**31 - 1 if options.packs(stage) else options.cutoff_len, keep, encode, options.add_bos, end)
        return stages.pack_pretrain(made, options.cutoff_len, "batch_id", "rid", add_bos=options.add_bos) if options.packs(stage) else made
    if stage == "sft" and not generate:
        made = stages.process_sft(rows, template, options.cutoff_len, keep, encode, options.train_on_prompt, options.mask_history, options.tools_date)
        return collate.pack_sft(made, options.cutoff_len, "batch_id", "rid", options.neat_packing) if options.packs(stage) else made
    if stage in ("rm", "dpo"):
        return stages.process_pairwise(rows, template, options.cutoff_len, keep, encode, options.tools_date)
    if stage == "kto":
        return stages.process_kto(rows, template, options.cutoff_len, "rid", keep, encode, options.batch_size, options.tools_date)
    return stages.process_unsupervised(rows, template, options.cutoff_len, keep, encode, options.tools_date)


def get_stream(spark: SparkSession, options: DataOptions, stage: str, registry: dict[str, dict] | str, encode: Callable[[Column], Column] = char_ids) -> dict[str, DataFrame]:
    """Token rows of streamed datasets, ``train`` (a stream) and, if asked, ``validation`` (a table).

    Datasets that are joined as they come need nothing but the stream itself. Interleaving and a
    validation set depend on counts: what the sources hold now is mixed, and its first shuffled
    rows are set apart, micro-batch by micro-batch into a folder beside the checkpoints, and the
    training stream reads from there. Packing, and the partners of rated answers, need batches:
    use the stage functions on the micro-batches of a ``foreachBatch`` for these.
    """
    if options.packs(stage) or stage == "kto":
        raise ValueError("A stream has no batches to pack or pair; use the stage in foreachBatch.")
    parts = []
    for spec in dataset_specs(list(options.dataset), registry):
        check_stage(spec, stage)
        parts.append(align(stream_dataset(spark, spec, options.dataset_dir), spec))
    made = lambda rows: tokenize(rows.withColumn("rid", F.lit(None).cast("long")), stage, options, encode).drop("rid", "batch_id")
    probabilities = list(options.interleave_probs) if options.interleave_probs else None
    mixing.check_mix(options.mix_strategy, len(parts), probabilities)
    interleaved = len(parts) > 1 and options.mix_strategy != "concat"
    if not interleaved and options.val_size <= 1e-6:
        return {"train": made(mix_streams(parts).drop("ds_idx"))}
    folder = f"{shared_folder(spark)}/stream-{uuid4().hex}"
    columns = [c for c in parts[0].columns]
    # Rows of a micro-batch count in the order in which they were read.
    keyed = [p.withColumn("__key", F.xxhash64(F.to_json(F.struct(*columns)))) for p in parts]
    write = lambda to: lambda rows, number: rows.select(*columns, "__key").write.mode("overwrite").parquet(f"{folder}/{to}/batch={number}")
    source = mix_streams(keyed).drop("ds_idx")
    if interleaved:
        settings = (options.mix_strategy, probabilities, options.seed)
        streams.interleaved_batches(keyed, "__key", write("mixed"), f"{folder}/mixing", *settings).awaitTermination()
        streams.interleaved_rest(spark, len(parts), "__key", write("mixed"), f"{folder}/mixing", *settings)
        source = read_back(spark, f"{folder}/mixed", source)
    if options.val_size > 1e-6:
        streams.take_and_skip(source, "__key", int(options.val_size), f"{folder}/split", f"{folder}/splitting", options.seed).awaitTermination()
        source = read_back(spark, f"{folder}/split/train", source)
        held = spark.read.schema(source.schema).parquet(f"{folder}/split/validation/batch=*")
        return {"train": made(source.drop("__key")), "validation": made(held.drop("__key"))}
    return {"train": made(source.drop("__key"))}


def read_back(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """The batches of a folder as a stream, the earliest first."""
    return spark.readStream.schema(like.schema).parquet(f"{folder}/batch=*")


def cached(spark: SparkSession, options: DataOptions, stage: str, specs: list[DatasetSpec], encode: Callable, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, kept under ``cache_path`` by the settings and the files it comes from."""
    if not options.cache_path:
        return make()
    settings = replace(options, cache_path=None, overwrite_cache=False, tokenized_path=None, val_size=0.0)
    state = [(s, input_state(spark, s, options.dataset_dir)) for s in specs]
    name = hashlib.sha256(repr((settings, stage, state, f"{encode.__module__}.{encode.__qualname__}")).encode()).hexdigest()[:32]
    path = f"{options.cache_path.rstrip('/')}/{name}"
    if options.overwrite_cache or not has_tokenized(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def get_dataset(spark: SparkSession, options: DataOptions, stage: str, registry: dict[str, dict] | str | None = None, encode: Callable[[Column], Column] = char_ids) -> dict[str, DataFrame]:
    """Train and validation tables; an existing tokenized folder takes the place of all else.

    With ``streaming`` the training set is a stream (see ``get_stream``).
    """
    options.validate(stage)
    if options.tokenized_path and has_tokenized(spark, options.tokenized_path):
        return read_tokenized(spark, options.tokenized_path)
    registry = registry if registry is not None else options.dataset_dir
    if options.streaming:
        return get_stream(spark, options, stage, registry, encode)
    out: dict[str, DataFrame] = {}
    if options.dataset:
        specs = dataset_specs(list(options.dataset), registry)
        train = cached(spark, options, stage, specs, encode, lambda: tokenize(merged(spark, specs, options, stage), stage, options, encode))
        key = "rid" if "rid" in train.columns else "__key"
        if key == "__key":
            train = train.withColumn("__key", F.concat_ws(":", "batch_id", "block"))
        out |= mixing.split(train, options.val_size, key, options.seed)
        out = {k: v.drop("__key") for k, v in out.items()}
    if options.eval_dataset:
        out["validation"] = tokenize(merged(spark, dataset_specs(list(options.eval_dataset), registry), options, stage), stage, options, encode, is_eval=True)
    for name, df in out.items():
        if df.isEmpty():
            raise RuntimeError(f"The {name} set of stage {stage} has no valid row; look at the data format.")
    if options.tokenized_path:
        write_tokenized(out, options.tokenized_path, options.streaming)
        return read_tokenized(spark, options.tokenized_path)
    return out


def unmerged(spark: SparkSession, options: DataOptions, stage: str, registry: dict[str, dict] | str | None = None) -> dict[str, DataFrame]:
    """Evaluation sets by name, ``validation_<dataset>``."""
    specs = dataset_specs(list(options.eval_dataset), registry if registry is not None else options.dataset_dir)
    return {f"validation_{n}": tokenize(merged(spark, [s], options, stage), stage, options, is_eval=True) for n, s in zip(options.eval_dataset, specs)}
