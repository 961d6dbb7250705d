"""Text quality by a small convolutional network over bytes, trained and run in numpy.

A text is cut into chunks of equal length. Neighbours overlap by at least a filter's width less one, so each window
of bytes lies whole in some chunk, and the last chunk ends where the text ends. Bytes become short vectors, learned
filters run over every place of a chunk, and each filter keeps its largest answer in the chunk. A hidden layer
reads these; over all chunks its answers are averaged, and the largest of each is kept. One logistic unit combines
both into a probability.

Training takes a bounded sample of labelled texts (`QualityNet.per_label`). From each it takes up to `drawn` chunks
an epoch, drawn anew from the whole text. Classes weigh alike while the filters are learned; last, the bias is
moved so that the shares of labels among all labelled texts hold. Scoring reads every chunk of every text.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.llm.common import table, text_of

# Byte 0 to 255, and one for places after the end of a short text.
PAD = 256
NAMES = ("embed", "filters", "bias", "hidden", "hidden_bias", "out", "out_bias")


@dataclass(frozen=True)
class QualityNet:
    """`per_label`: most texts of a label to learn from, by hash. `chunk`: bytes of a chunk; `width`: of a filter.
    `size`: of a byte's vector; `filters`, `hidden`: number of each. `epochs`, `batch`, `drawn`, `rate`: training.
    `seed`: of the first weights and of the draws. `least`: score from which a text is predicted 1. `rows`: chunks
    worked on together."""

    per_label: int = 1000
    chunk: int = 64
    width: int = 7
    size: int = 4
    filters: int = 32
    hidden: int = 24
    epochs: int = 24
    batch: int = 48
    drawn: int = 16
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 7
    least: float = 0.7
    rows: int = 512

    @property
    def places(self) -> int:
        return self.chunk - self.width + 1


def chunk_starts(length: int, net: QualityNet) -> np.ndarray:
    """Where the chunks of a text of so many bytes begin; one chunk for a text no longer than that."""
    if length <= net.chunk:
        return np.zeros(1, np.int64)
    starts = np.arange(0, length - net.chunk, net.places, dtype=np.int64)
    return np.append(starts, length - net.chunk)


def bytes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "replace"), np.uint8)


def cut(data: np.ndarray, starts: np.ndarray, net: QualityNet) -> np.ndarray:
    """The chunks that begin at `starts`, a row each; short texts are filled up."""
    if len(data) < net.chunk:
        out = np.full((len(starts), net.chunk), PAD, np.int16)
        out[:, : len(data)] = data
        return out
    return data[starts[:, None] + np.arange(net.chunk)].astype(np.int16)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Network:
    """Weights, what they answer, and how they learn."""

    def __init__(self, weights: dict[str, np.ndarray], net: QualityNet):
        self.w, self.net = weights, net

    @classmethod
    def fresh(cls, net: QualityNet) -> Network:
        rng = np.random.default_rng(net.seed)
        normal = lambda spread, *shape: (spread * rng.standard_normal(shape)).astype(np.float32)
        span = net.width * net.size
        weights = {
            "embed": normal(0.5, PAD + 1, net.size), "filters": normal(span**-0.5, span, net.filters),
            "bias": np.zeros(net.filters, np.float32), "hidden": normal(net.filters**-0.5, net.filters + 1, net.hidden),
            "hidden_bias": np.zeros(net.hidden, np.float32), "out": normal(0.1, 2 * net.hidden),
            "out_bias": np.zeros(1, np.float32),
        }
        weights["embed"][PAD] = 0
        return cls(weights, net)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.w)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes, net: QualityNet) -> Network:
        with np.load(io.BytesIO(data)) as held:
            return cls({name: held[name] for name in NAMES}, net)

    def pooled(self, chunks: np.ndarray, where: bool = False):
        """Largest answer of each filter in each chunk, with a last column for how much of the chunk is text; and, if
        asked for, at which place it is."""
        net, w = self.net, self.w
        at = w["embed"][chunks].reshape(len(chunks), net.chunk * net.size)
        windows = np.lib.stride_tricks.as_strided(
            at, (len(chunks), net.places, net.width * net.size), (at.strides[0], net.size * 4, 4)
        )
        answers = windows.reshape(-1, net.width * net.size) @ w["filters"]
        answers = answers.reshape(len(chunks), net.places, net.filters)
        filled = (chunks != PAD).mean(axis=1, dtype=np.float32)[:, None]
        # The bias and the rectifier are the same at every place, so they can wait for the largest.
        if where:
            place = answers.argmax(axis=1)
            top = np.take_along_axis(answers, place[:, None, :], 1)[:, 0]
        else:
            place, top = None, answers.max(axis=1)
        return np.hstack([np.maximum(top + w["bias"], 0), filled]), place

    def seen(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled @ self.w["hidden"] + self.w["hidden_bias"], 0)

    def score(self, text: str) -> float:
        """Probability of label 1, from all chunks of the text."""
        net, data = self.net, bytes_of(text)
        starts = chunk_starts(len(data), net)
        total, top = np.zeros(net.hidden), np.zeros(net.hidden)
        for begin in range(0, len(starts), net.rows):
            seen = self.seen(self.pooled(cut(data, starts[begin : begin + net.rows], net))[0])
            total, top = total + seen.sum(axis=0), np.maximum(top, seen.max(axis=0))
        logit = np.concatenate([total / len(starts), top]) @ self.w["out"] + self.w["out_bias"][0]
        return float(_sigmoid(logit))

    def scores(self, texts: list[str]) -> list[float]:
        """`score` of each text; short texts are worked on together."""
        net, out = self.net, [0.0] * len(texts)
        waiting: list[tuple[int, np.ndarray]] = []

        def flush():
            if not waiting:
                return
            seen = self.seen(self.pooled(np.concatenate([c for _, c in waiting]))[0])
            begins = np.concatenate([[0], np.cumsum([len(c) for _, c in waiting])[:-1]])
            sizes = np.array([len(c) for _, c in waiting])[:, None]
            whole = np.hstack([np.add.reduceat(seen, begins) / sizes, np.maximum.reduceat(seen, begins)])
            for (at, _), p in zip(waiting, _sigmoid(whole @ self.w["out"] + self.w["out_bias"][0])):
                out[at] = float(p)
            waiting.clear()

        held = 0
        for at, text in enumerate(texts):
            data = bytes_of(text)
            starts = chunk_starts(len(data), net)
            if len(starts) > net.rows:
                out[at] = self.score(text)
                continue
            if held + len(starts) > net.rows:
                flush()
                held = 0
            waiting.append((at, cut(data, starts, net)))
            held += len(starts)
        flush()
        return out

    def gradients(self, chunks: np.ndarray, sizes: np.ndarray, marks: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted log loss of texts, whose chunks follow each other, `sizes` of each."""
        net, w = self.net, self.w
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        owner = np.repeat(np.arange(len(sizes)), sizes)
        pooled, place = self.pooled(chunks, True)
        seen = self.seen(pooled)
        mean, top = np.add.reduceat(seen, begins) / sizes[:, None], np.maximum.reduceat(seen, begins)
        whole = np.hstack([mean, top])
        wrong = ((_sigmoid(whole @ w["out"] + w["out_bias"][0]) - marks) * weight).astype(np.float32)
        g = {"out": wrong @ whole, "out_bias": np.array([wrong.sum()], np.float32)}
        back = wrong[:, None] * w["out"]
        # Only the chunk that holds a largest answer learns from it; of several, each does.
        largest = seen == top[owner]
        d_seen = back[owner, : net.hidden] / sizes[owner, None] + largest * back[owner, net.hidden :]
        d_seen = (d_seen * (seen > 0)).astype(np.float32)
        g["hidden"], g["hidden_bias"] = pooled.T @ d_seen, d_seen.sum(axis=0)
        d_pooled = (d_seen @ w["hidden"].T)[:, : net.filters] * (pooled[:, : net.filters] > 0)
        g["bias"] = d_pooled.sum(axis=0)
        # Each filter learns from the one window that answered most.
        codes = chunks[np.arange(len(chunks))[:, None, None], place[:, :, None] + np.arange(net.width)]
        windows = w["embed"][codes].reshape(len(chunks), net.filters, -1)
        g["filters"] = np.einsum("cf,cfs->sf", d_pooled, windows, optimize=True)
        d_windows = (d_pooled[:, :, None] * w["filters"].T[None]).reshape(-1, net.size)
        flat = codes.reshape(-1)
        g["embed"] = np.stack(
            [np.bincount(flat, d_windows[:, i], minlength=PAD + 1) for i in range(net.size)], axis=1
        ).astype(np.float32)
        g["embed"][PAD] = 0
        return g


def train(examples: list[tuple[str, int]], shares: tuple[float, float], net: QualityNet) -> Network:
    """A network taught on (text, label); `shares`: texts of each label there are in all."""
    model, rng = Network.fresh(net), np.random.default_rng(net.seed)
    counts = [sum(y == label for _, y in examples) for label in (0, 1)]
    prior = np.log((shares[1] + 1) / (shares[0] + 1))
    if not all(counts):
        # Nothing to tell apart: every text has the share of the labels.
        model.w["out"][:] = 0
        model.w["out_bias"][:] = prior
        return model
    data = [bytes_of(t) for t, _ in examples]
    marks = np.array([y for _, y in examples], np.float32)
    weight = np.where(marks == 1, len(examples) / 2 / counts[1], len(examples) / 2 / counts[0]).astype(np.float32)
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    step = 0
    for epoch in range(net.epochs):
        rate = net.rate * (1 - epoch / net.epochs) + net.rate / 50
        order = rng.permutation(len(data))
        for begin in range(0, len(order), net.batch):
            some = order[begin : begin + net.batch]
            chunks, sizes = [], []
            for i in some:
                starts = chunk_starts(len(data[i]), net)
                if len(starts) > net.drawn:
                    starts = rng.choice(starts, net.drawn, replace=False)
                chunks.append(cut(data[i], starts, net))
                sizes.append(len(starts))
            g = model.gradients(np.concatenate(chunks), np.array(sizes), marks[some], weight[some] / len(some))
            step += 1
            for name, value in g.items():
                value = value + net.decay * model.w[name]
                first[name] = 0.9 * first[name] + 0.1 * value
                second[name] = 0.999 * second[name] + 0.001 * value * value
                ahead = first[name] / (1 - 0.9**step)
                model.w[name] -= (rate * ahead / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    model.w["out_bias"] += np.float32(prior)
    return model


def fit_quality(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    net: QualityNet = QualityNet(),
) -> bytes:
    """The network, as bytes, from texts and the rows (key, label) of `labels` to learn from.

    Null labels and keys teach nothing. Shares of labels are counted over all of `labels`; examples are the different
    texts of each label with the smallest hashes. A text with both labels is an example of both.
    """
    marked = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    whole = docs.select(docs[key].alias("k"), text_of(docs, text).alias("t"))
    # Hashes first: only the chosen examples' texts are moved, each once.
    hashed = whole.select("k", F.xxhash64("t").alias("h")).join(marked, "k").groupBy("y", "h").agg(F.lit(1).alias("one"))
    chosen: dict[int, list[int]] = {}
    for y in (0, 1):
        for r in hashed.where(F.col("y") == y).orderBy("h").limit(net.per_label).collect():
            chosen.setdefault(r["h"], []).append(y)
    texts = whole.select(F.xxhash64("t").alias("h"), "t").where(F.col("h").isin(list(chosen))).groupBy("h").agg(F.min("t").alias("t"))
    shares = (float(counts.get(0, 0)), float(counts.get(1, 0)))

    def build(batches):
        examples = [
            (t, y) for batch in batches for h, t in zip(*(batch.column(c).to_pylist() for c in ("h", "t"))) for y in chosen[h]
        ]
        yield pa.RecordBatch.from_arrays([pa.array([train(examples, shares, net).to_bytes()], pa.binary())], names=["net"])

    # One task: the sample is bounded. Sorted, so that every run learns in the same order.
    built = texts.repartition(1).sortWithinPartitions("h").mapInArrow(build, "net binary").first()
    return bytes(built[0]) if built else train([], shares, net).to_bytes()


def score_quality(
    docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text", net: QualityNet = QualityNet()
) -> DataFrame:
    """A row per document: key, `score` and `predicted` (1 from `net.least` on).

    Null texts count as empty. Texts shorter than a chunk, empty ones too, are one chunk filled up, and scored
    like others. Null keys stay; repeated rows are scored each; an empty table gives an empty result. Without
    labels of both kinds every score is the share of label 1. Only the two named columns are read, so labels,
    languages and keys can't enter a score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some tens of KB, whatever the table
    source = docs.select(docs[key].alias("k"), text_of(docs, text).alias("t"))
    kind = dict(source.dtypes)["k"]

    def score(batches):
        network = Network.from_bytes(shared.value, net)
        for batch in batches:
            # A few texts at a time as Python strings, so that memory stays bounded.
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                scores = [round(s, 6) for s in network.scores(part.column("t").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(scores, pa.float64())], names=["k", "score"])

    out = source.mapInArrow(score, f"k {kind}, score double")
    return out.select(F.col("k").alias(key), "score", (F.col("score") >= net.least).cast("int").alias("predicted"))


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


def op13_bytenet(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels.where(~held_out(F.col("doc_id"))))
    return score_quality(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
