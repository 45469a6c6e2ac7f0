"""Filling fixed-capacity containers with texts: cost-balanced packing.

Texts are measured in tokens of a public tokenizer; the cost of an item of n tokens is ``linear * n + quadratic * n * n``
(attention within each text). Items, in descending size, go to the container of the lowest cost that still has room;
where none has, a container is opened. Only a text above the capacity is split, into full pieces and a rest.

Items are packed in groups of about ``group_items``, chosen by a hash of a row's own number (not of its id, which many rows
may share), so the work is spread and each task holds one group's sizes (never texts). A group fills hundreds of containers
or more, so what its last ones leave unused is little.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import col, stored

_encoders: dict = {}
LONG = 20_000
LONG_BLANK = re.compile(f"[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{{{LONG},}}")


def token_counter(vocabulary: str):
    """A function of a text that counts its tokens. vocabulary: path of a .tiktoken (ranks), .json or .model file."""
    if vocabulary not in _encoders:
        if vocabulary.endswith(".tiktoken"):
            import public_tokenizers
            import tiktoken

            with open(vocabulary, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            whole = tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})  # any text as one piece
            _encoders[vocabulary] = lambda text: _count(enc, whole, text)
        elif vocabulary.endswith(".json"):
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(vocabulary)
            tok.encode_special_tokens = True
            _encoders[vocabulary] = lambda text: len(tok.encode(text, add_special_tokens=False).ids)
        else:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
            _encoders[vocabulary] = lambda text: len(sp.encode(text, num_threads=1))
    return _encoders[vocabulary]


def _count(enc, whole, text: str) -> int:
    """Tokens of a text. The library's pattern overflows its stack on very long runs of white space; such a run is one piece
    of its own, but for a last character that goes on with what follows, and is encoded as that."""
    n = at = 0
    for run in LONG_BLANK.finditer(text) if len(text) > LONG else ():
        end = run.end() if run.end() == len(text) else run.end() - 1
        n += len(enc.encode_ordinary(text[at : run.start()])) + len(whole.encode_ordinary(text[run.start() : end]))
        at = end
    return n + len(enc.encode_ordinary(text[at:] if at else text))


def token_sizes(df: DataFrame, item: str, text: str, vocabulary: str) -> DataFrame:
    """item, n_tokens of every row; null and empty texts have 0."""
    rows = df.select(col(item).alias("item"), col(text).cast("string").alias("text"))
    kind = rows.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([count(t) if t else 0 for t in b.column(1).to_pylist()], pa.int64())], names=["item", "n_tokens"])

    return rows.mapInArrow(run, f"item {kind}, n_tokens long")


def pack_sizes(sizes: np.ndarray, capacity: int, linear: float, quadratic: float) -> tuple[np.ndarray, np.ndarray]:
    """Container and place (tokens before it) of each size; sizes are 1 to capacity."""
    order = np.argsort(-sizes, kind="stable")
    n = max(1, math.ceil(int(sizes.sum()) / capacity))  # containers there at least must be
    cost, room = np.zeros(2 * n + 1), np.full(2 * n + 1, capacity, np.int64)  # two neighbours opened in need hold more than one full
    to, at = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in order:
        s = sizes[i]
        c = int(np.where(room[:n] >= s, cost[:n], np.inf).argmin())
        if room[c] < s:
            if n == len(room):
                cost, room = np.append(cost, np.zeros(n)), np.append(room, np.full(n, capacity, np.int64))
            c, n = n, n + 1
        to[i], at[i] = c, capacity - room[c]
        room[c] -= s
        cost[c] += linear * s + quadratic * s * s
    return to, at


def packed(sized: DataFrame, item: str, size: str, capacity: int = 2048, linear: float = 1.0, quadratic: float = 1 / 2048, group_items: int = 8192) -> DataFrame:
    """Where each item goes: item, piece (0 unless split), piece_start, piece_size, container, place (tokens before it).

    Items above the capacity are split into pieces of the capacity and a rest. Items of size 0 or null take no room: one
    row with piece 0 and null container and place. Repeated ids are packed as items of their own; ties in size are taken
    in the order of ids. Container ids are unique but not dense. An empty table has no rows. Other columns are ignored.
    """
    rows = sized.select(col(item).alias("item"), F.coalesce(col(size).cast("long"), F.lit(0)).alias("n"))
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / capacity).cast("int") - 1, F.lit(0)))
    rows = rows.select("item", "n", F.explode(pieces).alias("piece"))
    rows = rows.select("item", "piece", (F.col("piece").cast("long") * capacity).alias("piece_start"), F.greatest(F.lit(0), F.least(F.lit(capacity), F.col("n") - F.col("piece").cast("long") * capacity)).cast("int").alias("piece_size"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    n = rows.where(F.col("piece_size").between(1, capacity - 1)).count()
    groups = max(1, math.ceil(n / group_items))
    kind = rows.schema["item"].dataType.simpleString()
    schema = f"item {kind}, piece int, piece_start long, piece_size int, container long, place int"

    def pack(t: pa.Table) -> pa.Table:
        group = t.column("group")[0].as_py()
        order = np.array(sorted(range(len(t)), key=lambda i, a=t.column("item").to_pylist(), b=t.column("piece").to_pylist(), c=t.column("row").to_pylist(): (a[i] is not None, a[i] if a[i] is not None else 0, b[i], c[i])), np.int64)
        t = t.take(pa.array(order))
        to, at = pack_sizes(t.column("piece_size").to_numpy().astype(np.int64), capacity, linear, quadratic)
        return pa.table({**{c: t.column(c).combine_chunks() for c in ("item", "piece", "piece_start", "piece_size")}, "container": pa.array((group * 2**32 + to) * 2), "place": pa.array(at.astype(np.int32))})

    open_ = rows.where(F.col("piece_size").between(1, capacity - 1)).withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    placed = open_.groupBy("group").applyInArrow(pack, schema)
    # a full piece fills a container by itself: no need to look for one
    full = rows.where(F.col("piece_size") == capacity).select("item", "piece", "piece_start", "piece_size", (F.monotonically_increasing_id() * 2 + 1).alias("container"), F.lit(0).alias("place"))
    none = rows.where("piece_size = 0").select("item", "piece", "piece_start", "piece_size", F.lit(None).cast("long").alias("container"), F.lit(None).cast("int").alias("place"))
    return placed.unionByName(full).unionByName(none)


def fill(placements: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row about placements: n_containers, used tokens, and the share of the capacity used."""
    by = placements.where("container is not null").groupBy("container").agg(F.sum("piece_size").alias("used"))
    return by.agg(F.count("*").alias("n_containers"), F.sum("used").alias("used"), (F.sum("used") / (F.count("*") * F.lit(float(capacity)))).alias("share_used"))

