"""The same analytics over Structured Streaming sources.

Keyed state is sharded, so no operator needs all keys in one place; reservoirs and Bloom filters are states of a shard.
"""

from __future__ import annotations

import math
import pickle
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.hashing import P, coefficients, text_number
from ..operators.sketches import FM_FAMILY, distinct_estimates
from ..runtime import new_path


def parquet_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files that match the path; the schema is taken from those there now."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def replay(df: DataFrame, name: str, output_mode: str = "append") -> DataFrame:
    """Run a streaming frame over all that is available, into Parquet files of the shared folder, and return them as a table.

    Every micro-batch is written by the executors into a folder of its own, over what a failed attempt may have left there.
    With "complete" the result is what the last one wrote, else all of them. Offsets and state are kept in the shared
    folder, so the query can go on after a failure.
    """
    spark = df.sparkSession
    path, batches = new_path(spark), []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch-{number}")
        batches.append(number)

    q = df.writeStream.queryName(name).outputMode(output_mode).option("checkpointLocation", new_path(spark)).foreachBatch(write).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    kept = sorted(set(batches))[-1:] if output_mode == "complete" else sorted(set(batches))
    return spark.read.schema(df.schema).parquet(*(f"{path}/batch-{n}" for n in kept)) if kept else spark.createDataFrame([], df.schema)


def windowed_counts(stream: DataFrame, when: str, key: str, width: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """Tumbling (or, with slide, sliding) event-time counts per key; records later than ``late`` are dropped with their state."""
    timed = stream.withColumn("at", F.col(when).cast("timestamp")).withWatermark("at", late)
    w = F.window("at", width, slide) if slide else F.window("at", width)
    return timed.groupBy(w, key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("from"), F.col("window.end").alias("to"), key, "n")


def session_counts(stream: DataFrame, when: str, key: str, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """Sessions of each key, closed after a gap."""
    timed = stream.withColumn("at", F.col(when).cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.session_window("at", gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("from"), F.col("session_window.end").alias("to"), key, "n")


class BloomState:
    """A Bloom filter of fixed size with linear hashes; kept in the state of a shard."""

    def __init__(self, bits: int, hashes: int, seed: int = 17):
        self.bits, self.coeffs, self.data = bits, coefficients(hashes, seed), np.zeros(bits, bool)

    def ask(self, numbers: np.ndarray) -> np.ndarray:
        """For each value, in order, whether it may have been put in before; puts it in. All values are worked on at once: a
        value tests positive if each of its bits was set already or is set by a value before it."""
        x = numbers.astype(np.int64) % P
        at = np.stack([(a * x + b) % P % self.bits for a, b in self.coeffs])
        places, first, inverse = np.unique(at.T, return_index=True, return_inverse=True)  # by value, then by hash
        earlier = (first // len(self.coeffs))[inverse].reshape(at.T.shape) < np.arange(len(x))[:, None]
        seen = (self.data[at.T] | earlier).all(axis=1)
        self.data[places] = True
        return seen


def bloom_seen(stream: DataFrame, value: str, seq: str, bits: int = 69_997, hashes: int = 4, shards: int = 8) -> DataFrame:
    """seq, value and maybe_seen for each record of a stream, from one Bloom filter a shard of the values, kept across batches."""
    rows = stream.select(F.col(seq).cast("long").alias("seq"), F.col(value).cast("string").alias("value")).where("seq is not null and value is not null")
    rows = rows.withColumn("number", text_number(F.col("value"))).withColumn("shard", F.pmod("number", F.lit(shards)).cast("int"))

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bloom = pickle.loads(state.get[0]) if state.exists else BloomState(bits, hashes)
        frames = [f for f in frames if len(f)]
        if not frames:
            return
        whole = pd.concat(frames).sort_values("seq", kind="stable")
        whole["maybe_seen"] = bloom.ask(whole["number"].to_numpy())
        state.update((pickle.dumps(bloom),))
        yield whole[["seq", "value", "maybe_seen"]]

    out, kept = "seq long, value string, maybe_seen boolean", "bloom binary"
    return rows.groupBy("shard").applyInPandasWithState(run, out, kept, "append", GroupStateTimeout.NoTimeout)


class ReservoirState:
    """A reservoir that draws how many records to skip; kept in the state of a shard."""

    def __init__(self, size: int, seed: int):
        self.size, self.rng, self.seen, self.slots, self.w, self.upcoming = size, random.Random(seed), 0, [], 1.0, 0

    def _skip(self) -> None:
        self.w *= math.exp(math.log(1 - self.rng.random()) / self.size)
        self.upcoming += 1 + (math.floor(math.log(1 - self.rng.random()) / math.log1p(-self.w)) if self.w > 1e-300 else 2**62)

    def take(self, values) -> None:
        """Read these values; only those that come in are looked at."""
        room = min(self.size - len(self.slots), len(values))
        if room > 0:
            self.slots += list(values[:room])
            if len(self.slots) == self.size:
                self.upcoming = self.size - 1
                self._skip()
        if len(self.slots) == self.size:
            while self.upcoming < self.seen + len(values):
                self.slots[self.rng.randrange(self.size)] = values[self.upcoming - self.seen]
                self._skip()
        self.seen += len(values)


def reservoir(stream: DataFrame, value: str, seq: str, size: int = 100, shards: int = 8, seed: int = 5) -> DataFrame:
    """After each batch the reservoir of each shard that got records: shard, seen, slot, value (update mode). Records go to
    shards by a hash of their sequence number, so evenly; a shard's reservoir is a uniform sample of its records, and
    ``merged_reservoir`` makes one sample of them."""
    rows = stream.select(F.col(value).cast("string").alias("value"), F.pmod(text_number(F.col(seq).cast("string")), F.lit(shards)).cast("int").alias("shard")).where("shard is not null")

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = pickle.loads(state.get[0]) if state.exists else ReservoirState(size, seed + int(key[0]))
        for f in frames:
            kept.take(f["value"].to_numpy())
        state.update((pickle.dumps(kept),))
        yield pd.DataFrame({"shard": key[0], "seen": kept.seen, "slot": range(len(kept.slots)), "value": kept.slots})

    out = "shard int, seen long, slot int, value string"
    return rows.groupBy("shard").applyInPandasWithState(run, out, "kept binary", "update", GroupStateTimeout.NoTimeout)


def last_reservoirs(updates: DataFrame) -> DataFrame:
    """The reservoirs as they are after the last update of each shard: shard, seen, slot, value."""
    last = updates.groupBy("shard").agg(F.max("seen").alias("seen"))  # one row a shard
    return updates.join(F.broadcast(last), ["shard", "seen"])


def merged_reservoir(updates: DataFrame, size: int = 100, seed: int = 5) -> DataFrame:
    """One uniform sample of the whole stream: seen, slot, value, from the shards' reservoirs; how many values come from each
    shard is drawn in proportion to the records it stands for. At most shards * size values meet in one task."""

    def merge(t: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        groups = [g.sort_values("slot") for _, g in t.groupby("shard", sort=True)]
        left, picked = [int(g["seen"].iloc[0]) for g in groups], [0] * len(groups)
        total = sum(left)
        for _ in range(min(size, total)):  # one record after the other, without replacement
            i = int(np.searchsorted(np.cumsum(left), rng.integers(sum(left)), side="right"))
            left[i] -= 1
            picked[i] += 1
        values = [v for g, n in zip(groups, picked) for v in g["value"].to_numpy()[rng.permutation(len(g))[:n]]]
        return pd.DataFrame({"seen": total, "slot": range(len(values)), "value": values})

    return last_reservoirs(updates).groupBy(F.lit("all").alias("one")).applyInPandas(merge, "seen long, slot int, value string")


def batch_estimates(stream: DataFrame, value: str, batch: str, name: str, coeffs: list[tuple[int, int]] = FM_FAMILY) -> DataFrame:
    """Flajolet-Martin estimates of each batch's distinct values: batch, n_distinct, estimate.

    Micro-batches bring the distinct values of what they read, which are deduplicated over all of them, so it doesn't matter
    how a batch's records are spread over micro-batches.
    """
    rows = stream.select(F.col(batch).cast("long").alias("batch"), F.col(value).cast("string").alias("value")).dropna()
    return distinct_estimates(replay(rows, name), coeffs)
