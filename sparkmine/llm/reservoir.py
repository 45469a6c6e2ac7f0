"""Uniform fixed-size sample of data of unknown length: skipping reservoirs per partition, merged by hypergeometric draws.

Each partition runs a reservoir that draws how many records to skip instead of a number for each record, and counts its
records. Reservoirs are merged in rounds: how many rows of the merged sample come from each is drawn from the
(multivariate) hypergeometric distribution of their population sizes, then that many rows are taken at random. So every
record of the whole is equally likely, as is every set of records. The states of pieces that arrive at different times
merge the same way.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import col, stored

#: Reservoirs merged by one task.
FAN_IN = 64


def _drawn(good: int, bad: int, k: int, rng: random.Random) -> int:
    """How many of k rows drawn without replacement from good + bad rows are good: a hypergeometric number.

    By inversion over the at most k + 1 outcomes, whose chances follow from one another by exact ratios, so populations may be
    of any size.
    """
    low, high = max(0, k - bad), min(k, good)
    if low >= high:
        return low
    x = np.arange(low, high, dtype=float)
    steps = np.log((good - x) / (x + 1) * ((k - x) / (bad - k + x + 1)))
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    chance = np.cumsum(np.exp(logs - logs.max()))
    return low + min(int(np.searchsorted(chance, rng.random() * chance[-1], side="right")), high - low)


def _taken(weights: Sequence[int], k: int, rng: random.Random) -> list[int]:
    """How many of k rows drawn without replacement come from each population: hypergeometric draws, one a population."""
    rest, out = sum(weights), []
    k = min(k, rest)
    for w in weights:
        rest -= w
        out.append(_drawn(w, rest, k, rng))
        k -= out[-1]
    return out


class _Reservoir:
    """A reservoir of k places that draws how many records to skip; ``place`` says where the next records go."""

    def __init__(self, k: int, rng: random.Random):
        self.k, self.rng, self.seen, self.w, self.upcoming = k, rng, 0, 1.0, 0
        self.kept: list[pa.Array] = []  # each of one record

    def take(self, rows: pa.Array) -> None:
        """Read these records: only those that stay at the end are copied, so that their batch can go."""
        n, at, new, rng, k = len(rows), 0, {}, self.rng, self.k
        while at < n and self.seen + at < k:
            new[len(self.kept)] = at
            self.kept.append(None)
            at += 1
            if len(self.kept) == k:
                self.w = math.exp(math.log(1 - rng.random()) / k)
                self.upcoming = k + math.floor(math.log(1 - rng.random()) / math.log1p(-self.w))
        if len(self.kept) == k:
            while self.upcoming < self.seen + n:
                new[rng.randrange(k)] = self.upcoming - self.seen
                self.w *= math.exp(math.log(1 - rng.random()) / k)
                self.upcoming += 1 + (math.floor(math.log(1 - rng.random()) / math.log1p(-self.w)) if self.w > 1e-300 else 2**62)
        self.seen += n
        for slot, place in new.items():
            self.kept[slot] = rows.take(pa.array([place], pa.int64()))


#: Records that the open reservoirs of a task may hold together; beyond, the oldest is given out as a finished state.
OPEN_RECORDS = 100_000


def reservoir_states(df: DataFrame, k: int, seed: int = 0, arrival: str = "", piece: str | None = None) -> DataFrame:
    """One reservoir for each partition of df, in rows: its number (part), the records it stands for (seen), and up to
    k records (row). A partition without records gives none.

    arrival: a name for what is read here. States that will be merged must have been drawn independently: give data that
    arrives separately different names (or seeds), else partitions of the same number would keep the same places.
    piece: a column that names the piece a record belongs to. Each piece then has reservoirs of its own, with the columns
    piece (as text, null for null) and no (a piece may have several in one partition, numbered apart).
    """
    fields = [T.StructField("part", T.LongType()), T.StructField("seen", T.LongType()), T.StructField("row", df.schema)]
    schema = T.StructType(([T.StructField("piece", T.StringType()), T.StructField("no", T.LongType())] if piece else []) + fields)
    row = F.struct(*(col(c) for c in df.columns)).alias("row")
    out = df.select(row, F.spark_partition_id().alias("part"), (col(piece).cast("string") if piece else F.lit("")).alias("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str | None, tuple[int, _Reservoir]] = {}
        part, begun = 0, 0

        def state(name: str | None) -> pa.RecordBatch:
            no, r = open_.pop(name)
            n = len(r.kept)
            columns = {"part": pa.array([part] * n, pa.int64()), "seen": pa.array([r.seen] * n, pa.int64()), "row": pa.concat_arrays(r.kept)}
            return pa.RecordBatch.from_pydict(({"piece": pa.array([name] * n, pa.string()), "no": pa.array([no] * n, pa.int64())} if piece else {}) | columns)

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(1)[0].as_py()
            names = batch.column(2).dictionary_encode("encode")
            held = names.dictionary.to_pylist()
            for code, name in enumerate(held):
                rows = batch.column(0) if len(held) == 1 else batch.column(0).take(pa.array(np.flatnonzero(names.indices.to_numpy() == code)))
                if name not in open_:
                    while open_ and (len(open_) + 1) * k > OPEN_RECORDS:
                        yield state(next(iter(open_)))
                    open_[name] = begun, _Reservoir(k, random.Random(f"{seed}/{arrival}/{part}/{begun}"))
                    begun += 1
                open_[name][1].take(rows)
        while open_:
            yield state(next(iter(open_)))

    return out.mapInArrow(run, schema)


def _merger(k: int, seed: int, level: int, fan_in: int | None):
    """Merges the reservoirs of one group; fan_in: the width of the groups, none for a single one."""

    def merge(t: pa.Table) -> pa.Table:
        own: dict[tuple, list[int]] = {}
        for i, p in enumerate(zip(*(t.column(c).to_pylist() for c in ("part", "no") if c in t.column_names))):
            own.setdefault(p, []).append(i)
        seen, names = t.column("seen").to_pylist(), sorted(own)
        group = names[0][0] // fan_in if fan_in else 0
        piece = t.column("piece")[0].as_py() if "piece" in t.column_names else ""
        rng = random.Random(f"{seed}/{level}/{group}/{piece}")
        weights = [seen[own[p][0]] for p in names]
        take = [i for p, n in zip(names, _taken(weights, k, rng)) for i in rng.sample(own[p], n)]
        rows, n = t.take(pa.array(take, pa.int64())), len(take)
        new = {"part": pa.array([group] * n, pa.int64()), "no": pa.array([0] * n, pa.int64()), "seen": pa.array([sum(weights)] * n, pa.int64())}
        schema = t.schema.remove(t.schema.get_field_index("to"))
        return pa.table({c: new.get(c, rows.column(c)) for c in schema.names}, schema=schema)

    return merge


def merge_states(states: DataFrame, k: int, seed: int = 0, fan_in: int = FAN_IN, parts: int | None = None) -> DataFrame:
    """One state (part 0) of all the states given, or of each piece if they have the column piece. The ``part`` numbers of
    states must differ (within a piece those of part and no). parts: how many there are at most, if known."""
    if parts is None:
        parts = (states.agg(F.max("part")).first()[0] or 0) + 1
    by, level = [c for c in ("piece", "to") if c in (*states.columns, "to")], 0
    while True:
        level += 1
        many = parts > fan_in
        to = F.expr(f"part div {fan_in}") if many else F.lit(0)
        states = states.withColumn("to", to).groupBy(*by).applyInArrow(_merger(k, seed, level, fan_in if many else None), states.schema)
        parts = math.ceil(parts / fan_in)
        if parts <= 1:
            return states


def of_pieces(states: DataFrame) -> DataFrame:
    """The states of pieces (one each, from ``merge_states``) with a part number each, to be merged into one."""
    by = W.orderBy("piece")
    numbers = states.select("piece").distinct().select("piece", (F.row_number().over(by) - 1).cast("long").alias("part"))  # one row a piece
    numbers = numbers.withColumnRenamed("piece", "of")
    return states.select("piece", "seen", "row").join(numbers, F.col("piece").eqNullSafe(F.col("of"))).select("part", "seen", "row")


def together(*states: DataFrame) -> DataFrame:
    """The states of pieces that arrived separately, with their partitions numbered apart, to be merged.

    They must have been drawn with different names or seeds (see ``reservoir_states``)."""
    whole = None
    for i, s in enumerate(states):
        s = s.withColumn("part", F.col("part") * len(states) + i)
        whole = s if whole is None else whole.unionByName(s)
    return whole


def _unpacked(states: DataFrame, taken: list[str]) -> DataFrame:
    """The rows of states with their population, under a name that isn't taken."""
    count = "population"
    while count in {c.lower() for c in taken}:
        count += "_"
    return states.select("row.*", F.col("seen").alias(count))


def fixed_sample(df: DataFrame, k: int, seed: int = 0, piece: str | None = None) -> DataFrame:
    """A uniform random sample of min(k, rows) rows of df, all its columns, with population: the number of records seen.

    Every row counts as a record of its own: repeated rows and rows with nulls have the same chance as others. A table of k
    rows or fewer comes whole; an empty one gives no rows. The same partitions and seed give the same sample. A column
    named population in df is kept and the count then gets the name population_.
    piece: a column by which records arrive; every piece (null is one too) is sampled by itself and the samples are merged.
    """
    # at most k rows a partition (and piece) are kept; the input is read once, whatever the number of merging rounds
    states = stored(reservoir_states(df, k, seed, piece=piece))
    if piece:
        states = of_pieces(stored(merge_states(states, k, seed)))
    return _unpacked(merge_states(states, k, seed + 1 if piece else seed), df.columns)


def piece_samples(df: DataFrame, k: int, piece: str, seed: int = 0) -> DataFrame:
    """A uniform sample of min(k, rows) rows of every piece, with population: the records of that piece.

    As ``fixed_sample`` for each value of the column piece by itself, null included.
    """
    return _unpacked(merge_states(stored(reservoir_states(df, k, seed, piece=piece)), k, seed), df.columns)
