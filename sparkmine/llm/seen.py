"""Has this key been seen before? Scalable Bloom chains, with a known bound on wrong answers.

Keys are hashed to shards; every shard reads its records in order and keeps a chain of Bloom filters instead of keys.
When a layer holds as many keys as it is made for, a layer ``growth`` times as large with an error rate tightened by
``tighten`` is added, so the chance of a wrong "seen" is at most ``error`` however long the history gets:
error * (1 - tighten) * (1 + tighten + tighten**2 + ...) = error. A "not seen" is never wrong.

The chains of all shards are a table (see ``STATE``). A run can start from the table of the runs before it, so a growing
history is never read again, and tables of histories built apart can be merged.

A key sent again and again is thinned before the shuffle: within an input batch only its first record has to ask the
filter, the others are certainly seen and are spread evenly over the shards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import col, stored

#: A row is a stretch of a layer's bits. room: keys the layer still has room for; salt: number its hashes are mixed with.
STATE = "shards int, shard int, layer int, at int, bits binary, n_bits long, hashes int, salt int, rate double, room long"
CHUNK = 8 * 2**20


@dataclass
class Layer:
    bits: np.ndarray
    n_bits: int
    hashes: int
    salt: int
    rate: float
    room: int


class BloomChain:
    """A chain of Bloom filters over 64-bit keys."""

    def __init__(self, error: float = 0.001, first: int = 4096, growth: int = 2, tighten: float = 0.5):
        self.error, self.first, self.growth, self.tighten = error, first, growth, tighten
        self.layers: list[Layer] = []

    def bound(self) -> float:
        """The compounded chance of a wrong "seen" so far."""
        return sum(x.rate for x in self.layers)

    def _add_layer(self) -> None:
        i = len(self.layers)
        capacity, rate = self.first * self.growth**i, self.error * (1 - self.tighten) * self.tighten**i
        k = max(1, math.ceil(-math.log2(rate)))
        # the size at which k hashes reach the rate, and some more as the formula is a little low for small filters
        m = math.ceil(-k * capacity / math.log1p(-(rate ** (1 / k))) * 1.02) + 64
        m = (m + 7) // 8 * 8
        self.layers.append(Layer(np.zeros(m // 8, np.uint8), m, k, i, rate, capacity))

    @staticmethod
    def _places(keys: np.ndarray, of: Layer, j: int) -> np.ndarray:
        """The bit place of each key for hash j: a mix of the key with the numbers of the layer and the hash."""
        with np.errstate(over="ignore"):
            h = keys ^ np.uint64(((j + 1) * 0x9E3779B97F4A7C15 + of.salt * 0xD1B54A32D192ED03) % 2**64)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return ((h ^ (h >> np.uint64(31))) % np.uint64(of.n_bits)).astype(np.int64)

    def __contains__(self, key: int) -> bool:
        return bool(self.holds(np.array([key], np.int64))[0])

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """For each key whether some layer holds it (perhaps wrongly)."""
        keys, out = keys.astype(np.uint64), np.zeros(len(keys), bool)
        for x in reversed(self.layers):  # the largest first
            left = np.flatnonzero(~out)
            for j in range(x.hashes):  # keys with an unset bit are out
                if not len(left):
                    break
                at = self._places(keys[left], x, j)
                left = left[(x.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]
            out[left] = True
        return out

    def add(self, keys: np.ndarray) -> None:
        """Put in keys that are not held; layers are added as they fill."""
        keys = keys.astype(np.uint64)
        while len(keys):
            if not self.layers or not self.layers[-1].room:
                self._add_layer()
            x = self.layers[-1]
            now, keys = keys[: x.room], keys[x.room :]
            for j in range(x.hashes):
                at = self._places(now, x, j)
                np.bitwise_or.at(x.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
            x.room -= len(now)

    def rows(self) -> Iterator[tuple]:
        """The chain as rows (layer, at, bits, n_bits, hashes, salt, rate, room)."""
        for i, x in enumerate(self.layers):
            for at in range(0, len(x.bits), CHUNK):
                yield i, at // CHUNK, x.bits[at : at + CHUNK].tobytes(), x.n_bits, x.hashes, x.salt, x.rate, x.room

    def put(self, at: int, bits: bytes, n_bits: int, hashes: int, salt: int, rate: float, room: int) -> None:
        """Take over a row; rows come in order. at = 0 begins a layer."""
        if at == 0:
            self.layers.append(Layer(np.zeros(n_bits // 8, np.uint8), n_bits, hashes, salt, rate, room))
        self.layers[-1].bits[at * CHUNK : at * CHUNK + len(bits)] = np.frombuffer(bits, np.uint8)


_KEPT = ("layer", "at", "bits", "n_bits", "hashes", "salt", "rate", "room")


def merge_states(*states: DataFrame) -> DataFrame:
    """The state of several histories together: the layers of all their chains, whose bounds add up. They must have the same
    number of shards."""
    whole = None
    for i, s in enumerate(states):
        s = s.withColumn("layer", F.col("layer") * len(states) + i)
        whole = s if whole is None else whole.unionByName(s)
    return whole


def bloom_answers(df: DataFrame, key: str, order: str, error: float = 0.001, shards: int | None = None, history: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Answers and state. Answers of the filters: key, order, maybe_seen, asked (the filter was asked), bound (on the chance of a
    wrong answer), one for each row with a key and an order. State: the chains after it, to be written and given as
    ``history`` to the next run, whose records all count as later.

    Records of the same key and order don't precede each other. shards: parts of the key space, each with its own chain; by
    default as many as the session's shuffle partitions; those of the history if there is one. Both frames are made by one
    job that runs at once.
    """
    if history is not None:
        row = history.select("shards").first()  # none in an empty state
        shards = row["shards"] if row else shards
    shards = shards or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = stored(_asked(df, key, order, error, shards, history, True))
    answers = both.where("bits is null").select("key", "order", "maybe_seen", "asked", "bound")
    return answers, both.where("bits is not null").select(F.lit(shards).alias("shards"), "shard", *_KEPT)


def bloom_seen(df: DataFrame, key: str, order: str, error: float = 0.001, shards: int | None = None) -> DataFrame:
    """Only the answers, without a history and without keeping the state; not run before it is asked for."""
    shards = shards or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _asked(df, key, order, error, shards, None, False).select("key", "order", "maybe_seen", "asked", "bound")


def _asked(df: DataFrame, key: str, order: str, error: float, shards: int, history: DataFrame | None, keep: bool) -> DataFrame:
    rows = df.select(col(key).cast("string").alias("key"), col(order).cast("long").alias("order")).where("key is not null and order is not null")
    rows = rows.withColumn("hash", F.xxhash64("key"))

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, o = b.column(2).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            by = np.lexsort((o, h))
            new = np.ones(len(h), bool)
            new[1:] = h[by][1:] != h[by][:-1]
            head = o[by][np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
            asked = np.empty(len(h), bool)
            asked[by] = o[by] == head  # records of one order don't precede each other
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(asked)], names=["key", "order", "hash", "asked"])

    rows = rows.mapInArrow(thin, "key string, order long, hash long, asked boolean")
    spread = F.when(F.col("asked"), F.col("hash")).otherwise(F.xxhash64("key", "order"))
    rows = rows.select(F.pmod(spread, F.lit(shards)).cast("int").alias("shard"), F.lit(1).alias("kind"), "*")
    names = ["shard", "kind", "key", "order", "hash", "asked", *_KEPT]
    types = dict(f.split() for f in STATE.split(", "))
    rows = rows.select(*names[:6], *(F.lit(None).cast(types[c]).alias(c) for c in _KEPT))
    if history is not None:
        old = history.select("shard", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("key"), (F.col("layer").cast("long") * 2**31 + F.col("at")).alias("order"), F.lit(0).cast("long").alias("hash"), F.lit(False).alias("asked"), *_KEPT)
        rows = rows.unionByName(old)
    # the rows of a shard: its state first, then its records in order, those of one key and order side by side
    rows = rows.repartition(shards, "shard").sortWithinPartitions("shard", "kind", "order", "hash")
    out = pa.schema([("key", pa.string()), ("order", pa.int64()), ("maybe_seen", pa.bool_()), ("asked", pa.bool_()), ("bound", pa.float64()), ("shard", pa.int32()), *((c, {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}[types[c]]) for c in _KEPT)])

    def result(n: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in out], schema=out)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, shard, last = BloomChain(error), None, (None, None, False)  # last: order, hash and answer of the record before

        def state() -> Iterator[pa.RecordBatch]:
            for row in chain.rows() if keep and shard is not None else ():
                yield result(1, shard=pa.array([shard], pa.int32()), **{c: pa.array([v], out.field(c).type) for c, v in zip(_KEPT, row)})

        for b in batches:
            of, kind = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cuts = np.flatnonzero(np.diff(of)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(of)]):
                if start == end:
                    continue
                if of[start] != shard:
                    yield from state()
                    chain, shard, last = BloomChain(error), int(of[start]), (None, None, False)
                split = start + int((kind[start:end] == 0).sum())
                for r in b.slice(start, split - start).to_pylist():
                    chain.put(*(r[c] for c in _KEPT[1:]))
                if split == end:
                    continue
                part = b.slice(split, end - split)
                o, h, asked = (part.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5))
                seen = np.ones(len(h), bool)
                if asked.any():
                    o, h = o[asked], h[asked]
                    same = np.concatenate(([(o[0], h[0]) == last[:2]], (o[1:] == o[:-1]) & (h[1:] == h[:-1])))
                    answer = np.empty(len(h), bool)
                    first = h[~same]
                    keys, at, inverse = np.unique(first, return_index=True, return_inverse=True)
                    held = chain.holds(keys)
                    answer[~same] = held[inverse] | (np.arange(len(first)) != at[inverse])
                    chain.add(keys[~held])
                    # a record of the same key and order as the one before has its answer
                    source = np.maximum.accumulate(np.where(same, -1, np.arange(len(h))))
                    answer = np.where(source >= 0, answer[source], last[2])
                    last = o[-1], h[-1], bool(answer[-1])
                    seen[asked] = answer
                yield result(len(seen), key=part.column(2), order=part.column(3), maybe_seen=pa.array(seen), asked=part.column(5), bound=pa.array(np.full(len(seen), chain.bound())))
        yield from state()

    return rows.mapInArrow(ask, "key string, order long, maybe_seen boolean, asked boolean, bound double, shard int, " + ", ".join(f"{c} {types[c]}" for c in _KEPT))


def _without_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The records that the filters aren't asked about: key, order, seen (false without a key, else null)."""
    rest = df.select(col(key).cast("string").alias("key"), col(order).cast("long").alias("order")).where("key is null or order is null")
    return rest.withColumn("seen", F.when(F.col("order").isNotNull(), False))


def seen_before(df: DataFrame, key: str, order: str, error: float = 1e-6, shards: int | None = None) -> DataFrame:
    """For each record whether its key occurred in a record of smaller order, as the filters say: key, order, seen, bound.

    "Not seen" is never wrong; a "seen" is with a chance of at most bound, which stays below ``error``. No keys are kept, and
    nothing is joined. Of records with the same key and order none precedes the other. Records with a null key have seen =
    false and no bound: no key, no earlier one. Records with a null order have seen = null. Repeated rows are answered
    each. An empty table has no rows; other columns are ignored.
    """
    answers = bloom_seen(df, key, order, error, shards).select("key", "order", F.col("maybe_seen").alias("seen"), "bound")
    return answers.unionByName(_without_key(df, key, order).withColumn("bound", F.lit(None).cast("double")))


def checked(df: DataFrame, key: str, order: str, error: float = 1e-6, shards: int | None = None) -> DataFrame:
    """The answers of ``seen_before`` next to the truth, found by an exact check: key, order, maybe_seen (the filter's answer),
    seen (the truth), wrong (they differ), bound. For reports of the rate of wrong answers; it needs all earlier records.

    Only the filters' positive answers are checked: against the record that brought the key in (the filter's one negative
    answer for it), or, for the few keys whose first record was wrongly answered already, against the least order among
    their positive answers. Records without key or order as in ``seen_before``, and never wrong.
    """
    answers = stored(bloom_seen(df, key, order, error, shards))
    negative = answers.where(~F.col("maybe_seen"))
    sure = answers.where("maybe_seen and not asked")
    positive = answers.where("maybe_seen and asked")
    brought = negative.groupBy("key").agg(F.min("order").alias("first"))
    missed = positive.join(brought, "key", "left_anti").groupBy("key").agg(F.min("order").alias("first"))
    told = positive.join(brought.unionByName(missed), "key").withColumn("seen", F.col("order") > F.col("first"))
    out = told.select(*answers.columns, "seen").unionByName(negative.withColumn("seen", F.lit(False))).unionByName(sure.withColumn("seen", F.lit(True)))
    out = out.select("key", "order", "maybe_seen", "seen", (F.col("maybe_seen") != F.col("seen")).alias("wrong"), "bound")
    rest = _without_key(df, key, order)
    wrong = F.when(F.col("seen").isNotNull(), False)
    return out.unionByName(rest.select("key", "order", F.col("seen").alias("maybe_seen"), "seen", wrong.alias("wrong"), F.lit(None).cast("double").alias("bound")))


def wrong_rate(answers: DataFrame) -> DataFrame:
    """One row about ``checked`` answers: records, n_seen, n_wrong, wrong_rate (of records whose key is new) and bound."""
    new = F.count_if(~F.col("seen") & F.col("bound").isNotNull())
    return answers.agg(
        F.count("*").alias("n_records"), F.count_if("seen").alias("n_seen"), F.count_if("wrong").alias("n_wrong"),
        F.try_divide(F.count_if("wrong"), new).alias("wrong_rate"), F.max("bound").alias("bound"),
    )
