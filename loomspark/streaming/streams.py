"""Streaming sources, mixing, splits and monitoring with Structured Streaming.

Streams can't be sorted or numbered as a whole. Shuffles and mixes work on micro-batches and on
what earlier ones left over, which is held in tables beside the checkpoint; a split picks rows
by a hash of their key, or counts what it took before.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomspark.functions.lineage import cut_lineage
from loomspark.functions.text import hash_order
from loomspark.operators import mixing
from loomspark.sources.readers import LOG, hadoop_path


def stream_files(spark: SparkSession, path: str, schema: str, kind: str = "json", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(kind)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def check_streaming(max_steps: int, val_size: float, max_samples: int | None, tokenized_path: str | None) -> None:
    """Settings that an endless dataset can't have."""
    if max_steps <= 0:
        raise ValueError("A streamed dataset needs a number of steps.")
    if 1e-6 < val_size < 1:
        raise ValueError("A streamed dataset needs a whole number of validation rows.")
    if max_samples is not None:
        raise ValueError("A streamed dataset can't be limited by max_samples.")
    if tokenized_path is not None:
        raise ValueError("A streamed dataset can't be saved.")


def mix_streams(streams: list[DataFrame]) -> DataFrame:
    """Rows of several streams as they come; their order is not defined."""
    return reduce(DataFrame.unionByName, [s.withColumn("ds_idx", F.lit(i)) for i, s in enumerate(streams)])


class Held:
    """Rows that micro-batches hand on to the next ones, as tables beside a query's checkpoint.

    Batch ``n`` reads what batch ``n - 1`` left and writes its own version, so a batch that is run
    again after a failure does the same. The two latest versions are kept.
    """

    def __init__(self, spark: SparkSession, checkpoint: str, name: str):
        self.spark, self.path = spark, f"{checkpoint.rstrip('/')}/held/{name}"

    def read(self, number: int) -> DataFrame | None:
        place, system = hadoop_path(self.spark, f"{self.path}/{number}")
        return self.spark.read.parquet(f"{self.path}/{number}") if system.exists(place) else None

    def write(self, rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{number}")
        place, system = hadoop_path(self.spark, f"{self.path}/{number - 2}")
        if number >= 2 and system.exists(place):
            system.delete(place, True)

    def last(self) -> int:
        """The number of the latest version, -1 for none."""
        place, system = hadoop_path(self.spark, self.path)
        if not system.exists(place):
            return -1
        return max((int(s.getPath().getName()) for s in system.listStatus(place)), default=-1)


#: Writes the rows of one batch; a batch that is run again comes with the same number.
Sink = Callable[[DataFrame, int], None]


def shuffled_batches(stream: DataFrame, key: str, sink: Sink, checkpoint: str, seed: int = 42, buffer: int = 0) -> StreamingQuery:
    """Rows shuffled over micro-batches through a buffer of ``buffer`` rows.

    A batch meets what the buffer holds; of all these rows, in an order by hash that differs
    from batch to batch, the last ``buffer`` ones stay and the others go to ``sink`` in that
    order (column ``place``). So a row may leave many batches after it came. No row is lost: what the
    buffer holds in the end is given out by ``shuffled_rest``. Without a buffer a batch is
    shuffled by itself.
    """
    held = Held(stream.sparkSession, checkpoint, "buffer")

    def write(batch: DataFrame, number: int) -> None:
        before = held.read(number - 1) if number else None
        rows = batch if before is None else batch.unionByName(before.select(*batch.columns))
        order = [hash_order(f"{seed}:{number}", F.col(key)), F.col(key)]
        placed = mixing.number_rows(rows, order, "place")
        out = max(0, placed.count() - buffer)
        if buffer:
            held.write(placed.where(F.col("place") >= out).drop("place"), number)
        sink(placed.where(F.col("place") < out).orderBy("place"), number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def shuffled_rest(spark: SparkSession, key: str, sink: Sink, checkpoint: str, seed: int = 42) -> None:
    """What the buffer of an ended ``shuffled_batches`` still holds, as one more batch."""
    held = Held(spark, checkpoint, "buffer")
    number = held.last()
    rows = held.read(number) if number >= 0 else None
    if rows is not None:
        order = [hash_order(f"{seed}:{number + 1}", F.col(key)), F.col(key)]
        sink(mixing.number_rows(rows, order, "place").orderBy("place"), number + 1)


def split_stream(stream: DataFrame, key: str, share: float, seed: int = 42) -> dict[str, DataFrame]:
    """Disjoint validation and training streams: a row's hash decides, so each row is always
    in the same part."""
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    chosen = number < int(share * 2**32)
    return {"validation": stream.where(chosen), "train": stream.where(~chosen)}


def monitor(spark: SparkSession, path: str) -> DataFrame:
    """A training log as it grows: latest step, loss and progress."""
    log = spark.readStream.schema(LOG).json(path)
    return log.agg(F.max("current_steps").alias("current_steps"), F.max_by("loss", "current_steps").alias("loss"), F.max_by("percentage", "current_steps").alias("percentage"))


def keep_latest(updates: DataFrame, path: str, checkpoint: str, seconds: int | None = 2) -> StreamingQuery:
    """An aggregate's latest state as a Parquet table at ``path``, written by the tasks.

    ``seconds`` None: all that is there is read, then the query ends.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    writer = updates.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


class Interleaving:
    """Queues of several streams, and how far the mix has come.

    A row's place in its own stream (``rid``) follows the order of arrival: micro-batches one
    after the other, and ``key`` inside them. Steps ask for datasets in turn or by chance, exactly
    as ``mixing.mix`` does, and a step's row is the next one of its dataset. A batch gives all
    steps whose rows have come; rows that are not asked for yet wait in the queue, for any
    number of batches.
    """

    def __init__(self, spark: SparkSession, datasets: int, key: str, checkpoint: str, strategy: str, probabilities: list[float] | None, seed: int):
        mixing.check_mix(strategy, datasets, probabilities)
        self.spark, self.k, self.key, self.strategy, self.seed = spark, datasets, key, strategy, seed
        self.probabilities = probabilities
        self.shares = [p / sum(probabilities) for p in probabilities] if probabilities else None
        self.queue, self.state = Held(spark, checkpoint, "queue"), Held(spark, checkpoint, "state")
        self.history = f"{checkpoint.rstrip('/')}/held/history"

    def arrived(self, batch: DataFrame, seen: list[int]) -> DataFrame:
        """The batch's rows with their ``rid``."""
        numbered = mixing.number_rows(batch, [F.col("ds_idx"), F.col(self.key)], "__n")
        firsts = F.broadcast(numbered.groupBy("ds_idx").agg(F.min("__n").alias("__first")))
        base = F.element_at(F.array(*(F.lit(n).cast("long") for n in seen)), F.col("ds_idx") + 1)
        return numbered.join(firsts, "ds_idx").withColumn("rid", F.col("__n") - F.col("__first") + base).drop("__n", "__first")

    def ready(self, done: int, taken: list[int], seen: list[int]) -> tuple[DataFrame, int]:
        """The steps (mix_pos, ds_idx, rid) that can be given, and the number of steps then done."""
        if self.shares is None:
            # Whole rounds: a round is complete once every stream has its row.
            stop = self.k * min(seen)
            steps = self.spark.range(done, max(done, stop)).withColumnRenamed("id", "mix_pos")
            return steps.withColumns({"ds_idx": (F.col("mix_pos") % self.k).cast("int"), "rid": F.floor(F.col("mix_pos") / self.k)}), max(done, stop)
        # One step more than there are rows: one of them has to lack its row.
        ahead = self.spark.range(done, done + sum(seen) - sum(taken) + 1).withColumnRenamed("id", "mix_pos")
        picked = ahead.withColumn("ds_idx", mixing.chosen(F.col("mix_pos"), self.shares, self.seed))
        at = lambda values: F.element_at(F.array(*(F.lit(n).cast("long") for n in values)), F.col("ds_idx") + 1)
        numbered = cut_lineage(mixing.number_picks(picked, self.k).withColumn("rid", F.col("pick") + at(taken)).drop("pick"))
        # A stream's last known row may be its very last one, and no step may follow that.
        ends = numbered.where(F.col("rid") >= at(seen) - 1).agg(F.min(F.when(F.col("rid") >= at(seen), F.col("mix_pos")).otherwise(F.col("mix_pos") + 1))).first()[0]
        if self.waits(taken, seen):
            ends = done
        stop = done if ends is None else ends
        return numbered.where(F.col("mix_pos") < stop), stop

    def waits(self, taken: list[int], seen: list[int]) -> bool:
        """Whether a stream that gives rows has given all that came so far."""
        return any(t == n for t, n, s in zip(taken, seen, self.shares) if s > 0 and t)

    def write(self, batch: DataFrame, number: int, sink: Sink) -> None:
        before = self.state.read(number - 1) if number else None
        seen, taken, done = ([0] * self.k, [0] * self.k, 0) if before is None else self.unpack(before)
        new = cut_lineage(self.arrived(batch, seen))
        counts = {r["ds_idx"]: r["n"] for r in new.groupBy("ds_idx").agg(F.count(F.lit(1)).alias("n")).collect()}
        seen = [n + counts.get(i, 0) for i, n in enumerate(seen)]
        waiting = self.queue.read(number - 1) if number else None
        rows = new if waiting is None else new.unionByName(waiting.select(*new.columns))
        steps, stop = self.ready(done, taken, seen)
        given = {r["ds_idx"]: r["n"] for r in steps.groupBy("ds_idx").agg(F.count(F.lit(1)).alias("n")).collect()}
        left = [t + given.get(i, 0) for i, t in enumerate(taken)]
        at = F.element_at(F.array(*(F.lit(n).cast("long") for n in left)), F.col("ds_idx") + 1)
        self.queue.write(rows.where(F.col("rid") >= at), number)
        if self.strategy == "interleave_over":
            new.write.mode("overwrite").parquet(f"{self.history}/batch={number}")
        sink(rows.join(steps, ["ds_idx", "rid"]), number)
        self.state.write(self.spark.createDataFrame([(seen, left, stop)], "seen array<long>, taken array<long>, done long"), number)

    @staticmethod
    def unpack(state: DataFrame) -> tuple[list[int], list[int], int]:
        r = state.first()
        return list(r["seen"]), list(r["taken"]), r["done"]

    def finish(self, sink: Sink) -> None:
        """What the strategy asks for behind the last step: nothing where the shortest stream ends
        the mix; else all steps to come, for which shorter streams start over."""
        number = self.state.last()
        if self.strategy != "interleave_over" or number < 0:
            return
        seen, _, done = self.unpack(self.state.read(number))
        if not all(seen):
            return
        # Only batches that were finished: one that failed half-way may have left its rows.
        rows = self.spark.read.parquet(*(f"{self.history}/batch={i}" for i in range(number + 1)))
        parts = [rows.where(F.col("ds_idx") == i).drop("ds_idx") for i in range(self.k)]
        mixed = mixing.mix(parts, self.strategy, self.probabilities, self.seed)
        sink(mixed.where(F.col("mix_pos") >= done), number + 1)


def interleaved_batches(streams: list[DataFrame], key: str, sink: Sink, checkpoint: str, strategy: str = "interleave_under", probabilities: list[float] | None = None, seed: int = 42) -> StreamingQuery:
    """Several streams mixed in turn or by chance, to ``sink``, with ds_idx, rid and mix_pos.

    Rows without a partner wait for later micro-batches (see ``Interleaving``), so batches of any
    sizes give the mix of the whole streams. When the query has ended, ``interleaved_rest`` gives
    what ``interleave_over`` still asks for; what ``interleave_under`` leaves in the queue is
    behind the end of its mix.
    """
    mixer = Interleaving(streams[0].sparkSession, len(streams), key, checkpoint, strategy, probabilities, seed)
    write = lambda batch, number: mixer.write(batch, number, sink)
    return mix_streams(streams).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def interleaved_rest(spark: SparkSession, datasets: int, key: str, sink: Sink, checkpoint: str, strategy: str = "interleave_under", probabilities: list[float] | None = None, seed: int = 42) -> None:
    """The rows that are due once all streams of an ended ``interleaved_batches`` have ended."""
    Interleaving(spark, datasets, key, checkpoint, strategy, probabilities, seed).finish(sink)


def take_and_skip(stream: DataFrame, key: str, n: int, path: str, checkpoint: str, seed: int = 42) -> StreamingQuery:
    """The first ``n`` rows of a shuffled stream under ``path/validation``, the others under
    ``path/train``, one folder a micro-batch.

    Each micro-batch is shuffled by hash and gives what is still missing; how much that is, is
    read from what earlier batches wrote, so a batch that is run again writes the same.
    """
    session = stream.sparkSession
    kinds = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        held = session.read.schema(kinds).parquet(*(f"{path}/validation/batch={i}" for i in range(number))).count() if number else 0
        ranked = mixing.number_rows(batch, [hash_order(seed, F.col(key)), F.col(key)], "__rank")
        for name, rows in (("validation", ranked.where(F.col("__rank") < n - held)), ("train", ranked.where(F.col("__rank") >= n - held))):
            rows.drop("__rank").write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append records to a log folder, each exactly once."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def events_by_window(stream: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour", kind: str = "event_type") -> DataFrame:
    """Counts by event-time window, with late rows up to a bound (an addition of this engine)."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
