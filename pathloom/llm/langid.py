"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

DIMENSIONS = 1 << 15
#: The model is fitted on a sample of labelled rows: about so many of each language.
SAMPLE = 600
UNKNOWN = "und"
_TABLE = 0x3000
_FOLDED: list[np.ndarray] = []


def _folded() -> np.ndarray:
    """Code points below _TABLE as lower-cased letters, or a space for what is no letter."""
    if not _FOLDED:
        fold = [ord(c.lower()[0]) if (c := chr(i)).isalpha() else 32 for i in range(_TABLE)]
        _FOLDED.append(np.array(fold, np.uint32))
    return _FOLDED[0]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(slots, counts) of hashed 1- to 3-grams of a whole text's letters; None without a letter."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    low = codes < _TABLE
    if low.all():
        a = _folded()[codes]
    else:
        a = codes.copy()
        a[low] = _folded()[codes[low]]
        for c in np.unique(codes[~low]):
            if not chr(c).isalpha():
                a[codes == c] = 32
    space = a == 32
    if space.all():
        return None
    a = a[~(space & np.r_[False, space[:-1]])]
    a = np.r_[np.uint32(32), a, np.uint32(32)]
    one = a[1:-1] * np.uint32(0x9E3779B1)
    two = (a[:-1] * np.uint32(0x85EBCA6B) + a[1:]) * np.uint32(0xC2B2AE35) + np.uint32(1)
    three = (two[:-1] + a[2:]) * np.uint32(0x27D4EB2F) + np.uint32(2)
    shift = np.uint32(32 - (DIMENSIONS - 1).bit_length())
    h = np.concatenate([one, two, three])
    h ^= h >> np.uint32(15)
    slots = (h * np.uint32(0x2C1B3C6D)) >> shift
    counts = np.bincount(slots, minlength=DIMENSIONS)
    used = np.flatnonzero(counts)
    return used, counts[used]


class Model:
    """weights: slots and a bias by languages. An empty model knows no language."""

    def __init__(self, languages: list[str], weights: np.ndarray, idf: np.ndarray, temperature: float = 1.0):
        self.languages, self.weights, self.idf, self.temperature = languages, weights, idf, temperature

    def vector(self, found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        slots, counts = found
        x = (1 + np.log(counts)) * self.idf[slots]
        norm = np.sqrt((x * x).sum())
        return np.r_[slots, DIMENSIONS], np.r_[x / norm if norm else x, 1.0]

    def logits(self, found) -> np.ndarray:
        slots, x = self.vector(found)
        return x @ self.weights[slots]

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, calibrated probability); ``und`` and 0 for a text that is null or has no letter."""
        found = grams(text)
        if found is None or not self.languages:
            return UNKNOWN, 0.0
        p = _softmax(self.logits(found) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def inverse_frequency(rows: int, df: np.ndarray) -> np.ndarray:
    return np.log((1 + rows) / (1 + df)) + 1


def document_frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """(texts with a letter, of these those with each slot) over all of ``text``. A task gives at most a row for each slot, as does the result."""

    def run(batches):
        total, df = 0, np.zeros(DIMENSIONS, np.int64)
        for text in (t for batch in batches for part in common.slices(batch) for t in part.column(0).to_pylist()):
            if (found := grams(text)) is not None:
                total += 1
                df[found[0]] += 1
        used = np.flatnonzero(df)
        yield common.frame({"slot": (np.r_[used, DIMENSIONS], pa.int64()), "n": (np.r_[df[used], total], pa.int64())})

    found = rows.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(DIMENSIONS + 1)
    counts[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return int(counts[-1]), counts[:-1]


def train(
    rows: list[tuple[str, np.ndarray, np.ndarray]],
    idf: np.ndarray | None = None,
    epochs: int = 3,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.05,
    seed: int = 7,
) -> Model:
    """Fits by follow-the-regularised-leader with both penalties; a fifth of the rows calibrates the temperature. Without ``idf`` it is that of ``rows``."""
    languages = sorted({r[0] for r in rows})
    if idf is None:
        df = np.zeros(DIMENSIONS)
        for _, slots, _ in rows:
            df[slots] += 1
        idf = inverse_frequency(len(rows), df)
    model = Model(languages, np.zeros((DIMENSIONS + 1, len(languages))), idf)
    if len(languages) < 2:
        return model
    order = np.random.default_rng(seed).permutation(len(rows))
    held, fit = order[: len(rows) // 5], order[len(rows) // 5 :]
    at = {x: k for k, x in enumerate(languages)}
    z, n = np.zeros_like(model.weights), np.zeros_like(model.weights)

    def weights(slots):
        return np.where(np.abs(z[slots]) > l1, (np.sign(z[slots]) * l1 - z[slots]) / ((beta + np.sqrt(n[slots])) / alpha + l2), 0)

    for epoch in range(epochs):
        for i in np.random.default_rng(seed + epoch).permutation(fit):
            slots, x = model.vector(rows[i][1:])
            w = weights(slots)
            p = _softmax(x @ w)
            p[at[rows[i][0]]] -= 1
            g = x[:, None] * p
            more = n[slots] + g * g
            z[slots] += g - (np.sqrt(more) - np.sqrt(n[slots])) / alpha * w
            n[slots] = more
    model.weights = weights(np.arange(DIMENSIONS + 1))
    if len(held):
        logits = np.array([model.logits(rows[i][1:]) for i in held])
        truth = np.array([at[rows[i][0]] for i in held])

        def loss(t: float) -> float:
            p = _softmax(logits / np.exp(t))
            return -np.log(np.maximum(p[np.arange(len(held)), truth], 1e-12)).mean()

        a, b, ratio = -3.0, 3.0, (np.sqrt(5) - 1) / 2
        for _ in range(40):  # golden-section search
            c, d = b - ratio * (b - a), a + ratio * (b - a)
            a, b = (a, d) if loss(c) <= loss(d) else (c, b)
        model.temperature = float(np.exp((a + b) / 2))
    return model


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from ``docs``; a hash of the id picks about ``sample`` rows of each language. Null languages and texts without a letter aren't learned from.

    Document frequencies are those of all rows that can be learned from. Features are counted on the executors; the driver
    gets at most DIMENSIONS numbers of a sampled row, and of all rows together. Repeated rows count as often as they
    stand there, within the bound. Without a row to learn from the model knows no language. Other columns take no part.
    """
    common.ship(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(text_col).alias("text"),
    ).filter("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return train([])
    shares = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample / n))])
    some = rows.withColumn("by", common.share(F.col("id"), "langid")).filter(F.col("by") < F.element_at(shares, F.col("lang")))

    def run(batches):
        names = ("by", "tie", "lang", "slots", "counts")
        kinds = (pa.float64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        for part in (x for batch in batches for x in common.slices(batch)):
            out = []
            for by, tie, lang, text in zip(*[c.to_pylist() for c in part.columns], strict=True):
                if (found := grams(text)) is not None:
                    out.append((by, tie, lang, found[0].astype(np.int32), found[1].astype(np.int32)))
            if out:
                yield common.frame({n: (v, k) for n, v, k in zip(names, zip(*out, strict=True), kinds, strict=True)})

    # features, not texts, are sorted; repeated ids can't make the sample larger than its bound
    features = some.select("by", F.xxhash64("id", "text").alias("tie"), "lang", "text")
    features = features.mapInArrow(run, "by double, tie long, lang string, slots array<int>, counts array<int>")
    table = features.orderBy("by", "tie", "lang").limit(2 * sample * len(counts)).select("lang", "slots", "counts").toArrow()
    found = zip(table.column("lang").to_pylist(), table.column("slots").to_pylist(), table.column("counts").to_pylist(), strict=True)
    learned = sorted(((a, np.array(b), np.array(c)) for a, b, c in found), key=lambda r: (r[0], len(r[1]), r[1].tolist(), r[2].tolist()))
    return train(learned, inverse_frequency(*document_frequencies(rows)))


def with_letters(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``lettered``: whether a text has a letter; false for a null text."""
    return common.extend(
        docs,
        [("lettered", T.BooleanType())],
        [text_col],
        lambda: lambda texts: [[any(map(str.isalpha, t or "")) for t in texts]],
    )


FIELDS = [("lang_pred", T.StringType()), ("score", T.DoubleType())]


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score, from the whole text alone. Columns that clash are replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def task():
        def call(texts):
            known: dict = {}
            for t in texts:
                if t not in known:
                    known[t] = held.value.predict(t)
            return [[known[t][0] for t in texts], [known[t][1] for t in texts]]

        return call

    return common.extend(docs, FIELDS, [text_col], task)
