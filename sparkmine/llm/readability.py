"""Reading level of each document: a linear pairwise ranker on graded documents, calibrated by isotonic regression.

Every word gets a vector: its length, syllables, whether it is long, and its grammatical class, from a small tagger (closed
classes by their members, open ones by endings). Features describe vocabulary and syntax: words and classes are measured in
windows along the text and the quartiles of the windows are the features, so a greeting, a quoted passage or boilerplate of
another level moves them little; the sequence of classes gives the lengths of phrases, clauses per sentence, passives and
nouns with prepositions; sentences give their length. The ranker learns from pairs of documents of different levels which
is harder; an isotonic fit, on scores of documents that the ranker had not seen, turns scores into levels.

The texts are scanned once, without a shuffle: their features are kept as a table, from which the labelled ones are taken for
the fit, and all are scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import col, stored
from .words import WORD, normal

WINDOW = 25
#: Words in a stretch of which the share of different ones is measured.
STRETCH = 200
TAG = re.compile(r"<[^>\n]{0,200}>")
#: Ends of sentences, list items and paragraphs; bounded, so that no text takes more than time in proportion to its length.
SENTENCE = re.compile(r"[.!?](?=\s|$)|\n[ \t]{0,16}[-*•\n]")
END = "\x01"  # stands for an end of a sentence among the words
TOKEN = re.compile(rf"[^\W_]+|{END}")
VOWELS = re.compile(r"[aeiouyáéíóúàèìòùäöüâêîôû]+")

#: English function words by class.
CLOSED = {
    "subordinator": "after although because before if once since though unless until whereas whether while when",
    "relative": "how that what where which who whom whose why",
    "coordinator": "and but nor or so yet",
    "preposition": "about across against among as at between beyond by despite during for from in into of on regarding through throughout to toward towards under upon with within without",
    "determiner": "a an another any each every no some such the these this those",
    "pronoun": "he her him his i it its me my our she their them they us we you your",
    "auxiliary": "am are be been being can could did do does had has have is may might must shall should was were will would",
}
#: English endings of open classes.
ENDINGS = {
    "nominal": ("ance", "ence", "ism", "ity", "ment", "ness", "ship", "sion", "tion", "ure"),
    "adverb": ("ly",),
    "participle": ("ed", "ing"),
    "adjective": ("able", "al", "ary", "ful", "ible", "ic", "ive", "less", "ous"),
}
CLASSES = [*CLOSED, *ENDINGS, "other"]
_CLASS_OF = {w: c for c, ws in CLOSED.items() for w in ws.split()}
SUBORDINATOR, RELATIVE, PREPOSITION, AUXILIARY, NOMINAL, PARTICIPLE = (CLASSES.index(c) for c in ("subordinator", "relative", "preposition", "auxiliary", "nominal", "participle"))
N_WORD = 5 + len(CLASSES) - 1
N_FEATURES = 20 + 2 * (N_WORD - 5) + 13
KEPT_WORDS = 200_000


def word_class(w: str) -> str:
    if c := _CLASS_OF.get(w):
        return c
    return next((c for c, ends in ENDINGS.items() if len(w) >= 5 and w.endswith(ends)), "other")


def _word(w: str) -> tuple[list[float], int]:
    """The vector of a word, and the number of its class."""
    n, c = len(w), CLASSES.index(word_class(w))
    of_class = [0.0] * (len(CLASSES) - 1)
    if c < len(of_class):
        of_class[c] = 1.0
    return [float(n), float(max(1, len(VOWELS.findall(w)))), float(n >= 7), float(n >= 10), float(n >= 13), *of_class], c


class _Words:
    """Vectors and classes of the words met so far (short ones, up to KEPT_WORDS)."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.vectors, self.classes = np.zeros((1024, N_WORD), np.float32), np.zeros(1024, np.int8)

    def of(self, ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
        get = self.at.get
        at = np.fromiter(map(get, ws, repeat(-1)), np.int64, len(ws))
        others = []
        for i in np.flatnonzero(at < 0).tolist():
            w = ws[i]
            if (j := get(w)) is None:
                v, c = _word(w)
                if len(self.at) >= KEPT_WORDS or len(w) >= 40:
                    others.append((i, v, c))
                    j = 0
                else:
                    j = self.at[w] = len(self.at)
                    if j == len(self.classes):
                        self.vectors, self.classes = np.concatenate((self.vectors, np.zeros_like(self.vectors))), np.concatenate((self.classes, np.zeros_like(self.classes)))
                    self.vectors[j], self.classes[j] = v, c
            at[i] = j
        vectors, classes = self.vectors[at], self.classes[at]
        for i, v, c in others:
            vectors[i], classes[i] = v, c
        return vectors, classes


_known = _Words()


def features(text: str | None) -> tuple[int, np.ndarray | None]:
    """The number of words and the features; none for a text without words."""
    if not text:
        return 0, None
    n_all, body = None, normal(text)
    if "<" in text:
        n_all = len(WORD.findall(body))
        body = normal(TAG.sub(" . ", text))
    tokens = TOKEN.findall(SENTENCE.sub(f" {END} ", body))
    ws = [t for t in tokens if t != END]
    n = len(ws)
    n_all = n if n_all is None else n_all
    if not n:
        return n_all, None
    v, c = _known.of(ws)
    k = max(1, round(n / WINDOW))
    edges = np.arange(k) * n // k
    means = np.add.reduceat(v, edges, axis=0) / np.diff(np.append(edges, n))[:, None]
    means.sort(axis=0)
    at = lambda share: means[int(share * (k - 1) + 0.5)]

    ends = np.flatnonzero(np.array([t == END for t in tokens]))
    sents = np.diff(np.concatenate(([-1], ends, [len(tokens)]))) - 1
    sents = np.sort(sents[sents > 0]).astype(float)
    total = np.cumsum(sents)

    # a phrase is a run of words that are no function words
    content = np.concatenate(([False], c >= len(CLOSED), [False]))
    starts, stops = np.flatnonzero(content[1:] & ~content[:-1]), np.flatnonzero(~content[1:] & content[:-1])
    phrases = stops - starts if len(starts) else np.zeros(1)
    follows = lambda a, b: float(np.count_nonzero((c[:-1] == a) & (c[1:] == b))) / n
    clauses = np.count_nonzero((c == SUBORDINATOR) | (c == RELATIVE)) / len(sents)
    stretches = [len(set(ws[i : i + STRETCH])) / min(n - i, STRETCH) for i in range(0, max(1, n - STRETCH // 2), STRETCH)]
    f = np.concatenate((
        at(0.25)[:5], at(0.5)[:5], at(0.75)[:5], v.mean(axis=0)[:5], at(0.5)[5:], v.mean(axis=0)[5:],
        [
            np.log(sents[np.searchsorted(total, total[-1] / 2)]), np.log(sents.mean()), min(1.0, sents[len(sents) // 2] / 40), body.count(",") / n, np.mean(stretches), np.log(n),
            phrases.mean(), np.count_nonzero(phrases >= 3) / len(phrases), min(4.0, clauses), min(6.0, np.count_nonzero(c == AUXILIARY) / len(sents)),
            follows(AUXILIARY, PARTICIPLE), follows(NOMINAL, PREPOSITION), min(1.0, np.count_nonzero(c == PREPOSITION) / (len(sents) * 8)),
        ],
    )).astype(float)
    return n_all, f


@dataclass
class LevelModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights

    def level(self, scores: np.ndarray) -> np.ndarray:
        return np.interp(scores, self.knots, self.levels)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing fit of y on x (pool adjacent violators): knots and values."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum, count, sum of x
    for a, v in zip(x[order], y[order]):
        blocks.append([v, 1.0, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], top)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def _ranked(x: np.ndarray, y: np.ndarray, pairs: int, ridge: float, rng: np.random.Generator) -> np.ndarray:
    """Weights of a logistic pairwise ranker, by Newton's method on at most ``pairs`` pairs of different levels."""
    i, j = rng.integers(0, len(y), (2, pairs * 2))
    harder = y[i] > y[j]
    d = (x[i] - x[j])[harder][:pairs]
    w = np.zeros(x.shape[1])
    for _ in range(30 if len(d) else 0):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w)), d.T @ (p - 1) / len(d) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, pairs: int = 20_000, ridge: float = 0.2, seed: int = 0, folds: int = 5) -> LevelModel:
    """The ranker on all documents; levels by an isotonic fit on the scores that each fold gets from rankers fitted on the others."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = (x - mean) / scale
    w = _ranked(z, y, pairs, ridge, rng)
    scores, fold = z @ w, rng.permutation(len(y)) % folds
    if len(y) >= 4 * folds:
        scores = np.empty(len(y))
        for k in range(folds):
            other = _ranked(z[fold != k], y[fold != k], pairs, ridge, rng)
            # rankers differ in scale, so scores are brought to that of the final one
            size = (z[fold != k] @ other).std() + 1e-12
            scores[fold == k] = z[fold == k] @ other * ((z[fold != k] @ w).std() / size)
    return LevelModel(mean, scale, w, *isotonic(scores, y))


def measured(docs: DataFrame, doc_id: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, f (features, null for a text without words) of every document, and the columns in keep (with a trailing
    _ where their name is one of the operator's)."""
    own = {"doc_id", "n_words", "f", "score", "level_value", "reading_level"}
    rows = docs.select(col(text).cast("string").alias("text"), col(doc_id).alias("doc_id"), *(col(c).alias(c + "_" * (c.lower() in own)) for c in keep))
    others = rows.schema.fields[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t.as_py()) for t in b.column(0)]
            fs = pa.array([None if f is None else f.astype(np.float32) for _, f in found], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([n for n, _ in found], pa.int32()), fs], names=[*b.schema.names[1:], "n_words", "f"])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "n_words int, f array<float>"]))


def _graded(features_of: DataFrame, labels: DataFrame, label_id: str, level: str, max_labels: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and levels of at most max_labels documents, whatever is repeated in either table."""
    # the bound on the labels makes the broadcast one of proven size
    by = labels.select(col(label_id).alias("id"), col(level).cast("double").alias("level")).where("id is not null and level is not null").groupBy("id").agg(F.avg("level").alias("level"))
    by = by.orderBy(F.xxhash64("id"), "id").limit(max_labels)
    rows = features_of.where("f is not null").select(F.col("doc_id").alias("id"), "f").join(F.broadcast(by), "id")
    # one document of an id, so that not more rows than labels come to the driver
    t = rows.groupBy("id").agg(F.min(F.struct(F.xxhash64("f").alias("h"), "f", "level")).alias("r")).select("r.level", "r.f").toArrow()
    x = np.array(t.column("f").to_pylist(), float).reshape(-1, N_FEATURES)
    y = t.column("level").to_numpy()
    order = np.lexsort((*x.T, y))  # the fit doesn't depend on the order in which rows come
    return x[order], y[order]


def reading_levels(docs: DataFrame, doc_id: str, text: str, labels: DataFrame, label_id: str, level: str, max_labels: int = 20_000, keep: tuple[str, ...] = (), model: LevelModel | None = None) -> DataFrame:
    """doc_id, n_words, score, level_value (1 to 5, continuous), reading_level (rounded, halves up), and the columns in keep
    (with a trailing _ where their name is one of these, or f).

    The model is fitted on at most max_labels labelled documents (the mean where one is rated several times), chosen by a
    hash of their ids, unless one is given. Null, empty and wordless texts have null levels, as has every text if no label
    fits. Repeated documents are scored each; of those with a labelled id one is fitted. Labels of unknown documents don't
    matter. An empty table has no rows.
    """
    rows = measured(docs, doc_id, text, keep)
    if model is None:
        rows = stored(rows)
        x, y = _graded(rows, labels, label_id, level, max_labels)
        model = fit(x, y) if len(y) else None
    others = [f for f in rows.schema.fields if f.name not in ("n_words", "f")]
    rows = rows.select(*(col(f.name) for f in others), "n_words", "f")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.column(len(others) + 1)
            has = f.is_valid().to_numpy(zero_copy_only=False) & (model is not None)
            score, value = np.zeros(len(has)), np.zeros(len(has))
            if has.any():
                score[has] = model.score(f.drop_null().flatten().to_numpy().astype(float).reshape(-1, N_FEATURES))
                value[has] = model.level(score[has])
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(score, mask=~has), pa.array(value, mask=~has), pa.array(np.floor(value + 0.5).astype(np.int32), mask=~has)],
                names=[*b.schema.names[:-1], "score", "level_value", "reading_level"],
            )

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "n_words int, score double, level_value double, reading_level int"])
    return rows.mapInArrow(run, schema)


def is_english(lang: Column) -> Column:
    """Whether a language code or name means English, in any spelling (en, EN, en-US, en_GB, eng, English)."""
    return F.coalesce(F.lower(F.btrim(lang)).rlike(r"^(en|eng|english)([-_ .(].*)?$"), F.lit(False))
