"""Evaluation texts leaking into training text: Aho-Corasick over words, one pass over every text.

Passages, questions and answers are normalised to words. The patterns of the automaton are all runs of ``run`` words of each
passage (a shorter passage as a whole) and each question and answer as a whole, however short. A document is read once, word
by word; hits are mapped back to offsets in the original text.

Words go into the automaton as 32-bit numbers (CRC-32), which are the same for any set of items; a hit counts only if the
words themselves agree.

The test items are stated queries, the corpus is scanned once, in place and without a shuffle, one text at a time and
whole. Items of up to ``block_chars`` characters (counted) are sent to the workers and make one automaton. More items are
written to the shared folder in blocks of about that size, whatever their number: every task numbers the words of a
stretch of its texts once and runs them through one block's automaton after the other, which it reads itself. So neither the
driver nor a worker ever holds more than one block of items.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import col, new_path, qualified, stored
from .words import word_spans, words

PARTS = ("passage", "question", "answer")
#: Characters of texts whose words a task holds as numbers (4 bytes a word) while it goes through several blocks.
HELD_CHARS = 64_000_000
_built: dict = {}
_numbers: dict[str, int] = {}


def _number(w: str) -> int:
    n = zlib.crc32(w.encode("utf-8", "surrogatepass"))
    if len(_numbers) < 200_000 and len(w) < 40:
        _numbers[w] = n
    return n


def numbered(ws: list[str]) -> tuple[int, ...]:
    """The number of each word."""
    known = tuple(map(_numbers.get, ws))
    return tuple(_number(w) if n is None else n for n, w in zip(known, ws)) if None in known else known


class Automaton:
    """Patterns of (item number, part) over the numbers of words."""

    def __init__(self, items: list[tuple[str | None, str | None, str | None]], run: int):
        import ahocorasick

        self.run = run
        self.words = [[words(t or "") for t in texts] for texts in items]
        owners: dict[tuple[int, ...], list[tuple[int, int, int]]] = {}
        for i, texts in enumerate(self.words):
            for part, ws in enumerate(texts):
                seq, n = numbered(ws), min(run, len(ws)) if part == 0 else len(ws)
                for j in range(len(seq) - n + 1 if n else 0):
                    owners.setdefault(seq[j : j + n], []).append((i, part, j))
        self.empty = not owners
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for seq, who in owners.items():
            self.machine.add_word(seq, (len(seq), who))
        if not self.empty:
            self.machine.make_automaton()

    def hits(self, ws: list[str] | None, numbers: tuple[int, ...], text: str | None = None) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """For each (item, part) the matched stretches in words (first, last), in order; consecutive runs of a passage
        are joined, but not those of a passage that is shorter than a run.

        ws: the words of the text; if None they are taken from the text, only where the numbers match something.
        """
        out: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for end, (n, who) in self.machine.iter(numbers):
            if ws is None:
                ws = words(text)
            own = ws[end - n + 1 : end + 1]
            for i, part, j in who:
                if self.words[i][part][j : j + n] != own:
                    continue
                found = out.setdefault((i, part), [])
                if part == 0 and n == self.run and found and found[-1][1] >= end - 1:
                    found[-1] = (found[-1][0], end)
                else:
                    found.append((end - n + 1, end))
        return out


def leaked_items(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, question: str | None = None, answer: str | None = None, run: int = 12, block_chars: int = 2_000_000, held_chars: int = HELD_CHARS) -> DataFrame:
    """Every document that contains part of a test item: doc_id, item_id, part, n_matches, longest_run (words), supported, start, end.

    part is "passage" (``run`` consecutive words of it, or all of a shorter one), "question" or "answer" (all of it). None is
    left out for being short; longest_run is the number of matching words, and supported says whether the hit stands for
    itself (``run`` words or more) or another part of the same item occurs in the document too, which tells a leak from a
    short answer such as "yes" that any text may hold. n_matches: places of the text, consecutive runs of a passage being one.
    start and end are the offsets of the first match in the original text, in characters; null in the rare texts whose
    normalisation can't be followed back. One row per input document, item and part: repeated documents or items are
    reported each. Null and empty texts, and texts without a word, match nothing. Empty tables give no rows. Other columns are
    ignored.
    block_chars: characters of items in one automaton (about 150 bytes each in a worker). held_chars: see the module.
    """
    spark = docs.sparkSession
    given = items.select(col(item_id).alias("item"), *(col(c).cast("string").alias(p) if c else F.lit(None).cast("string").alias(p) for p, c in zip(PARTS, (passage, question, answer))))
    length = sum((F.coalesce(F.length(p), F.lit(0)) for p in PARTS), F.lit(0))
    chars = given.agg(F.sum(length)).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars))
    if blocks == 1:
        table = given.toArrow()  # at most block_chars characters
        item_type, sent, folder = table.schema.field("item").type, spark.sparkContext.broadcast(table), None
    else:
        path = new_path(spark)
        item_type, sent = stored(given.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")), "block", path=path).select("item").limit(0).toArrow().schema.field(0).type, None
        folder = qualified(spark, path)
    rows = docs.select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text"))
    kinds = rows.schema["doc_id"].dataType.simpleString(), given.schema["item"].dataType.simpleString()
    name = uuid.uuid4().hex

    def machine_of(block: int) -> tuple[pa.Array, Automaton]:
        if (name, block) not in _built:
            _built.clear()
            if folder is None:
                t = sent.value
            else:
                import pyarrow.dataset
                import pyarrow.fs

                system, at = pyarrow.fs.FileSystem.from_uri(f"{folder}/block={block}")
                made = system.get_file_info(at).type != pyarrow.fs.FileType.NotFound
                t = pyarrow.dataset.dataset(at, filesystem=system, format="parquet").to_table(columns=["item", *PARTS]) if made else pa.table({c: [] for c in ("item", *PARTS)})
            _built[name, block] = t.column("item").combine_chunks(), Automaton(list(zip(*(t.column(p).to_pylist() for p in PARTS))), run)
        return _built[name, block]

    def search(batch: pa.RecordBatch, of_block: list[tuple[int, list, pa.Array]]) -> pa.RecordBatch:
        """The result rows of one batch: for each block its hits, by place in the batch."""
        place, item, rest = [], [], []
        for at, found, ids in of_block:
            spans = word_spans(batch.column(1)[at].as_py())
            parts: dict[int, int] = {}
            for i, _ in found:
                parts[i] = parts.get(i, 0) + 1
            item.append(ids.take(pa.array([i for i, _ in found], pa.int64())))
            for (i, part), runs in found.items():
                first = (spans[runs[0][0]][0], spans[runs[0][1]][1]) if spans else (None, None)
                longest = max(y - x + 1 for x, y in runs)
                place.append(at)
                rest.append((PARTS[part], len(runs), longest, longest >= run or parts[i] > 1, *first))
        part, n, longest, supported, start, end = zip(*rest) if rest else [()] * 6
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(place, pa.int64())), pa.concat_arrays(item).cast(item_type) if item else pa.array([], item_type), pa.array(part, pa.string()), pa.array(n, pa.int32()), pa.array(longest, pa.int32()),
                pa.array(supported, pa.bool_()), pa.array(start, pa.int64()), pa.array(end, pa.int64()),
            ],
            names=["doc_id", "item_id", "part", "n_matches", "longest_run", "supported", "start", "end"],
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if blocks == 1:
            ids, machine = machine_of(0)
            for batch in batches:
                found = []
                for at, t in enumerate(batch.column(1) if not machine.empty else ()):
                    if t := t.as_py():
                        ws = words(t)
                        if hits := machine.hits(ws, numbered(ws)):
                            found.append((at, hits, ids))
                yield search(batch, found)
            return
        held: list[tuple[pa.RecordBatch, list[np.ndarray]]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            for block in range(blocks):
                ids, machine = machine_of(block)
                for batch, numbers in held if not machine.empty else ():
                    found = [(at, hits, ids) for at, ns in enumerate(numbers) if len(ns) and (hits := machine.hits(None, tuple(ns.tolist()), batch.column(1)[at].as_py()))]
                    if found:
                        yield search(batch, found)

        n = 0
        for batch in batches:
            held.append((batch, [np.array(numbered(words(t)) if t else [], np.uint32) for t in batch.column(1).to_pylist()]))
            n += batch.column(1).nbytes
            if n >= held_chars:
                yield from flush()
                held, n = [], 0
        yield from flush()

    return rows.mapInArrow(scan, f"doc_id {kinds[0]}, item_id {kinds[1]}, part string, n_matches int, longest_run int, supported boolean, start long, end long")
