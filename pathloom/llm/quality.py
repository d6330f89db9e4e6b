"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: A filter sees WIDTH bytes; chunks overlap, as one starts every STRIDE bytes.
FILTERS, WIDTH, STRIDE = 16, 8, 2
#: GRAM bytes are a repeat where they stood up to BACK bytes earlier. A window of WIDTH bytes can't see a repeated
#: word, so what a filter sees of a byte is its value and whether it ends a repeat.
GRAM, BACK = 4, 64
#: Windows that are held at a time; longer texts go through in runs, and the pools of runs are joined.
RUN = 1 << 16
#: The network is fitted on a sample: about so many labelled rows of each class, whole texts of any length, until they come to so
#: many bytes.
SAMPLE = 1200
SAMPLE_BYTES = 48 << 20
THRESHOLD = 0.3


def windows(text: str | None) -> np.ndarray:
    """The text's bytes, padded with zeros to whole windows. 256 is added to each that ends a repeat."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(WIDTH, WIDTH + -(-max(0, len(raw) - WIDTH) // STRIDE) * STRIDE)
    data = np.frombuffer(raw + bytes(size - len(raw)), np.uint8)
    return data + np.uint16(256) * _repeats(data)


def _repeats(data: np.ndarray) -> np.ndarray:
    """Whether GRAM bytes up to and with each byte stood once before, at most BACK bytes earlier and without overlap. Padding counts as none."""
    out = np.zeros(len(data), bool)
    for first in range(0, len(data), RUN):
        some = data[max(0, first - BACK - GRAM + 1) : first + RUN].astype(np.uint32)
        code = some[3:] | some[2:-1] << 8 | some[1:-2] << 16 | some[:-3] << 24
        again = np.zeros(len(code), bool)
        for lag in range(GRAM, min(BACK, len(code) - 1) + 1):
            again[lag:] |= code[lag:] == code[:-lag]
        again &= code != 0
        new = min(RUN, len(data) - first)
        here = again[-new:] if first else np.concatenate([np.zeros(GRAM - 1, bool), again])
        out[first : first + new] = here
    return out


class Network:
    """taps: for each place in a window and byte, ending a repeat or not, a value for each filter; then max-pooling and a logistic layer."""

    def __init__(self, taps: np.ndarray, bias: np.ndarray, out: np.ndarray, out_bias: float):
        self.taps, self.bias, self.out, self.out_bias = taps, bias, out, out_bias

    def pool(self, data: np.ndarray, where: bool = False):
        """Each filter's largest value over all windows, and the window."""
        count = (len(data) - WIDTH) // STRIDE + 1
        best, at = np.full(FILTERS, -np.inf, np.float32), np.zeros(FILTERS, np.int64)
        for first in range(0, count, RUN):
            n = min(RUN, count - first)
            begin = first * STRIDE
            total = np.zeros((n, FILTERS), np.float32)
            for j in range(WIDTH):
                total += self.taps[j].take(data[begin + j : begin + j + (n - 1) * STRIDE + 1 : STRIDE], axis=0)
            if where:
                k = total.argmax(axis=0)
                top = total[k, np.arange(FILTERS)]
                better = top > best
                at = np.where(better, k + first, at)
            else:
                top = total.max(axis=0)
            best = np.maximum(best, top)
        return best, at

    def score(self, text: str | None) -> float:
        best, _ = self.pool(windows(text))
        z = float(np.tanh(np.maximum(best + self.bias, 0)) @ self.out + self.out_bias)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(
    rows: list[tuple[int, str]],
    epochs: int = 8,
    rate: float = 0.02,
    batch: int = 16,
    decay: float = 1e-5,
    seed: int = 11,
    odds: float | None = None,
) -> Network:
    """Adam on the mean log loss, classes weighed alike; then the bias is shifted to ``odds`` of class 1 to class 0, by default those of ``rows``.

    Without both classes the score is close to that of the only one, and 0.5 without rows.
    """
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.1, (WIDTH, 512, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.5, FILTERS).astype(np.float32),
        0.0,
    )
    labels = np.array([r[0] for r in rows], np.int64)
    if len(set(labels.tolist())) < 2:
        net.out[:] = 0
        net.out_bias = 0.0 if not len(rows) else 4.0 if labels[0] else -4.0
        return net
    share = np.bincount(labels, minlength=2) / len(labels)
    data = [windows(t) for _, t in rows]
    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in (("taps", net.taps), ("bias", net.bias), ("out", net.out))}
    state["out_bias"] = [0.0, 0.0]
    step, total = 0, epochs * -(-len(rows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for first in range(0, len(rows), batch):
            some = order[first : first + batch]
            grad = {"taps": np.zeros_like(net.taps), "bias": np.zeros_like(net.bias), "out": np.zeros_like(net.out), "out_bias": 0.0}
            for i in some:
                best, at = net.pool(data[i], where=True)
                h = np.tanh(np.maximum(best + net.bias, 0))
                p = 1 / (1 + np.exp(-np.clip(h @ net.out + net.out_bias, -30, 30)))
                g = (p - labels[i]) * 0.5 / share[labels[i]] / len(some)
                grad["out"] += g * h
                grad["out_bias"] += g
                inner = (g * net.out * (1 - h * h) * (best + net.bias > 0)).astype(np.float32)
                grad["bias"] += inner
                for j in range(WIDTH):  # only the windows that won pass a gradient on
                    np.add.at(grad["taps"][j], (data[i][at * STRIDE + j], np.arange(FILTERS)), inner)
            step += 1
            now = rate * (1 - step / (total + 1))
            for k, g in grad.items():
                m, v = state[k]
                g = g + decay * getattr(net, k)
                state[k] = [0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g]
                m, v = state[k][0] / (1 - 0.9**step), state[k][1] / (1 - 0.999**step)
                setattr(net, k, getattr(net, k) - now * m / (np.sqrt(v) + 1e-8))
    net.taps = net.taps.astype(np.float32)
    net.out_bias = float(net.out_bias + np.log(share[1] / share[0] if odds is None else odds))  # classes were weighed alike
    return net


def fit(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = SAMPLE,
    most: int = SAMPLE_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> Network:
    """Learns from the labelled rows of ``docs``; a hash of the id picks about ``sample`` rows of each class.

    Rows are taken whole in the hash's order until they come to ``most`` bytes, the row that reaches it included, so what the driver
    gets is bounded, and texts of any length are learned from. The odds that scores are calibrated to are those of
    all labels given. An id with several labels counts with the smallest; null labels and ids, and labelled rows
    with a null text, aren't learned from. Repeated rows count as often as they stand there, within the bounds.
    """
    marked = labels.select(
        F.col(id_col).alias("id"),
        F.col(label_col).cast("int").alias("label"),
    ).filter("id is not null and label in (0, 1)")
    marked = marked.groupBy("id").agg(F.min("label").alias("label"))
    counts = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    if not counts:
        return train([])
    limit = 2 * sample * len(counts)
    shares = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample / n))])
    picked = marked.withColumn("by", common.share(F.col("id"), "quality")).filter(F.col("by") < F.element_at(shares, F.col("label")))
    picked = F.broadcast(picked.orderBy("by", "id").limit(limit))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).filter("text is not null")
    some = texts.join(picked, "id").withColumn("tie", F.xxhash64("text"))
    order = F.struct("by", "id", "tie")
    sizes = some.select(order.alias("key"), F.octet_length("text").alias("bytes")).orderBy("key").limit(limit).collect()
    before = np.cumsum([0, *[r["bytes"] for r in sizes]])[:-1]
    taken = int((before < most).sum())
    if not taken:
        return train([])
    last = F.struct(*[F.lit(x).cast(t.dataType).alias(t.name) for x, t in zip(sizes[taken - 1]["key"], some.select("by", "id", "tie").schema, strict=True)])
    table = some.filter(order <= last).orderBy("by", "id", "tie").limit(taken).select("label", "text").toArrow()
    rows = list(zip(table.column("label").to_pylist(), table.column("text").to_pylist(), strict=True))
    return train(rows, odds=counts[1] / counts[0] if len(counts) == 2 else None)


FIELDS = [("score", T.DoubleType()), ("predicted", T.IntegerType())]


def predict(docs: DataFrame, net: Network, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds score and predicted, from the whole text alone; a null text counts as empty. Columns that clash are replaced."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def task():
        def call(texts):
            known: dict = {}
            for t in texts:
                if t not in known:
                    known[t] = held.value.score(t)
            scores = [known[t] for t in texts]
            return [scores, [int(s >= threshold) for s in scores]]

        return call

    return common.extend(docs, FIELDS, [text_col], task)
