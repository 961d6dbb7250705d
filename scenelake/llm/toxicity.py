"""Toxicity by the nearest labelled examples.

Texts are vectors of TF-IDF weights over terms: five-byte grams of the lower-cased words, each word with a blank
before and after it. Which terms count is chosen on the labelled examples: those whose presence goes with a
label, by the log-likelihood ratio of the 2 x 2 table. One more term stands for all grams of a text, so that texts
are near which hold such terms about as densely. The nearest examples by cosine are found exactly in an
inverted index whose postings are cut into blocks of examples. For each block and term the index keeps the
largest weight, so a block's best possible cosine is known before a posting is read; blocks are opened from the
highest bound on, until no bound reaches the k-th cosine found.

Neighbours vote with their cosine. Votes become probabilities by isotonic regression on leave-one-out votes of
the examples, weighted to the shares of labels among all labelled texts. The neighbours and their cosines are the
evidence.

Examples are a bounded sample of the labelled rows (`ToxicityModel.per_label`), so the index is of bounded size
and goes to every task; every text is scored whole.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.llm.common import small_batches, table, text_of
from scenelake.session import cut_lineage

WIDTH = 5


@dataclass(frozen=True)
class ToxicityModel:
    """`per_label`: most examples of a label, by hash of their text. `terms`: most terms. `least_ratio`: least
    log-likelihood ratio of a term, `least_lift`: how much more often one label has it. `least_texts`: examples a term is in at least. `k`: neighbours. `block`:
    examples in a block. `prior_votes`: votes of the average that every text gets.
    `length_weight`: weight of the term for all grams, times the root of their number."""

    per_label: int = 1500
    terms: int = 4000
    least_ratio: float = 30.0
    least_lift: float = 5.0
    length_weight: float = 0.2
    least_texts: int = 4
    k: int = 15
    block: int = 64
    prior_votes: float = 0.2


def grams_of(text: str) -> np.ndarray:
    """All terms of a text, repeated as they occur, as whole numbers made of their bytes."""
    words = " ".join(text.lower().split())
    data = np.frombuffer(f" {words} ".encode("utf-8", "replace"), np.uint8)
    if len(data) < WIDTH:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(data) - WIDTH + 1, np.uint64)
    for i in range(WIDTH):
        out = (out << np.uint64(8)) | data[i : len(data) - WIDTH + 1 + i]
    return out


class Index:
    """Terms, postings in blocks, and the largest weight of each block and term."""

    FIRST = 8
    ARRAYS = ("terms", "idf", "labels", "keys", "posts", "weights", "starts", "tops", "steps", "levels", "prior")

    def __init__(self, arrays: dict[str, np.ndarray], model: ToxicityModel):
        self.__dict__.update(arrays)
        self.model = model
        self.blocks = self.tops.shape[1]
        # A small table says at once that most grams aren't terms.
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self._slot(self.terms)] = True

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Places of a text's terms and their weights, of length one; nothing for a text without a term."""
        grams = grams_of(text)
        size = len(grams)
        grams = grams[self.maybe[self._slot(grams)]] if len(self.terms) else grams[:0]
        if not len(grams):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.terms, grams), len(self.terms) - 1)
        places, counts = np.unique(at[self.terms[at] == grams], return_counts=True)
        return _weighted(places, counts, size, self.idf, self.model)

    def nearest(self, places: np.ndarray, weights: np.ndarray, without: int = -1) -> list[tuple[float, int]]:
        """The k examples of highest cosine above 0, ties to the smaller number; exact."""
        k, best = self.model.k, []
        if not len(places):
            return best
        bounds = weights @ self.tops[places]
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        # The most promising blocks first; then, at once, all that may still hold one of the k best.
        first, rest = order[: self.FIRST], order[self.FIRST :]
        best = self._best(places, weights, first, best, without)
        if len(best) == k:
            # Rounding may put a cosine a hair above its bound.
            rest = rest[bounds[rest] + 1e-9 >= best[-1][0]]
        return self._best(places, weights, rest, best, without) if len(rest) else best

    def _best(self, places, weights, blocks, best, without):
        """The k best of `best` and the examples in `blocks`, by the postings of these blocks alone."""
        k, size = self.model.k, self.model.block
        begins = self.starts[places[:, None], blocks].ravel()
        lengths = self.starts[places[:, None], blocks + 1].ravel() - begins
        at = np.repeat(begins - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        each = np.repeat(np.repeat(weights, len(blocks)), lengths)
        sums = np.bincount(self.posts[at], each * self.weights[at], minlength=self.blocks * size)
        if without >= 0:
            sums[without] = 0
        least = best[-1][0] if len(best) == k else 0.0
        found = np.flatnonzero(sums > 0 if least <= 0 else sums >= least)
        if len(found) > k:
            # Ties with the k-th are kept for the comparison by number below.
            found = found[sums[found] >= np.partition(sums[found], -k)[-k]]
        best = best + [(float(sums[i]), int(i)) for i in found]
        return sorted(best, key=lambda f: (-f[0], f[1]))[:k]

    def vote(self, near: list[tuple[float, int]]) -> float:
        total = sum(c for c, _ in near)
        toxic = sum(c for c, i in near if self.labels[i])
        p = self.model.prior_votes
        return (toxic + p * float(self.prior[0])) / (total + p)

    def score(self, near: list[tuple[float, int]]) -> float:
        return float(np.interp(self.vote(near), self.steps, self.levels))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **{n: getattr(self, n) for n in self.ARRAYS})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes, model: ToxicityModel) -> Index:
        with np.load(io.BytesIO(data)) as found:
            return cls({n: found[n] for n in cls.ARRAYS}, model)


def _weighted(
    places: np.ndarray, counts: np.ndarray, size: int, idf: np.ndarray, model: ToxicityModel
) -> tuple[np.ndarray, np.ndarray]:
    """Vector of a text of `size` grams with these terms: places and weights, the last for all grams."""
    if not len(places):
        return np.zeros(0, np.int64), np.zeros(0)
    weights = np.append((1 + np.log(counts)) * idf[places], model.length_weight * np.sqrt(size))
    return np.append(places, len(idf)), weights / np.sqrt((weights**2).sum())


def _ratio(a: np.ndarray, b: np.ndarray, na: float, nb: float) -> np.ndarray:
    """Log-likelihood ratio of presence in a of na and b of nb texts."""
    rate = (a + b) / max(na + nb, 1)
    out = np.zeros(len(a))
    for count, size in ((a, na), (b, nb)):
        for seen, expected in ((count, size * rate), (size - count, size * (1 - rate))):
            with np.errstate(divide="ignore", invalid="ignore"):
                out += np.where(seen > 0, seen * np.log(seen / expected), 0)
    return 2 * out


def _isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing fit, as points to draw straight lines between."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # weight, sum, lowest x, highest x
    for i in order:
        if pools and pools[-1][3] == x[i]:
            pools[-1][0] += w[i]
            pools[-1][1] += w[i] * y[i]
        else:
            pools.append([w[i], w[i] * y[i], x[i], x[i]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    total, mean = sum(p[0] for p in pools), sum(p[1] for p in pools) / max(sum(p[0] for p in pools), 1e-12)
    # A little of the average keeps probabilities off 0 and 1.
    level = [(p[1] + mean * 1e-3 * total / len(pools)) / (p[0] + 1e-3 * total / len(pools)) for p in pools]
    steps = [v for p in pools for v in (p[2], p[3] + 1e-12)]
    return np.array(steps), np.repeat(level, 2)


def build_index(
    examples: Iterator[tuple[int, str, int]], shares: tuple[float, float], model: ToxicityModel = ToxicityModel()
) -> Index:
    """The index of examples (key, text, label); `shares`: label 0's and 1's among all labelled rows."""
    keys, labels, sets = [], [], []
    for key, text, label in examples:
        keys.append(key)
        labels.append(label)
        sets.append(np.unique(grams_of(text), return_counts=True))
    marks, n = np.array(labels, np.int8), len(labels)
    ones, noughts = float((marks == 1).sum()), float((marks == 0).sum())
    sides = [np.concatenate([np.zeros(0, np.uint64), *(s[0] for s, m in zip(sets, labels) if m == side)]) for side in (0, 1)]
    counted = [np.unique(s, return_counts=True) for s in sides]
    grams = np.union1d(counted[0][0], counted[1][0])
    seen = []
    for found, counts in counted:
        column = np.zeros(len(grams))
        column[np.searchsorted(grams, found)] = counts
        seen.append(column)
    both = seen[0] + seen[1]
    ratio = _ratio(seen[1], seen[0], ones, noughts)
    rates = [(seen[1] + 0.5) / (ones + 1), (seen[0] + 0.5) / (noughts + 1)]
    lift = np.maximum(rates[0] / rates[1], rates[1] / rates[0])
    good = np.flatnonzero((ratio >= model.least_ratio) & (lift >= model.least_lift) & (both >= model.least_texts))
    good = np.sort(good[np.argsort(-ratio[good], kind="stable")[: model.terms]])
    terms, idf = grams[good], np.log((1 + n) / (1 + both[good])) + 1
    vectors = []
    for found, counts in sets:
        at = np.minimum(np.searchsorted(terms, found), max(len(terms) - 1, 0))
        hit = terms[at] == found if len(terms) else np.zeros(len(found), bool)
        vectors.append(_weighted(at[hit], counts[hit], int(counts.sum()), idf, model))
    places, values = [v[0] for v in vectors], [v[1] for v in vectors]
    numbers = [np.full(len(v[0]), i) for i, v in enumerate(vectors)]
    cat = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
    place, number, value = cat(places, np.int64), cat(numbers, np.int64), cat(values, np.float64)
    order = np.lexsort((number, place))
    place, number, value = place[order], number[order], value[order]
    blocks = max(1, -(-n // model.block))
    cell = place * blocks + number // model.block
    columns = len(terms) + 1
    starts = np.searchsorted(cell, np.arange(columns * blocks + 1))
    rows = np.arange(columns)[:, None] * blocks + np.arange(blocks + 1)[None, :]
    tops = np.zeros(columns * blocks)
    np.maximum.at(tops, cell, value)
    prior = shares[1] / max(sum(shares), 1e-12)
    index = Index({
        "terms": terms, "idf": idf, "labels": marks, "keys": np.array(keys, np.int64), "posts": number, "weights": value,
        "starts": starts[rows].reshape(columns, blocks + 1), "tops": tops.reshape(columns, blocks),
        "steps": np.array([0.0, 1.0]), "levels": np.array([prior, prior]), "prior": np.array([prior]),
    }, model)
    if ones and noughts:
        votes = [index.vote(index.nearest(*vector, number)) for number, vector in enumerate(vectors)]
        each = np.where(marks == 1, shares[1] / ones, shares[0] / noughts)
        index.steps, index.levels = _isotonic(np.array(votes), marks.astype(float), each)
    return index


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    model: ToxicityModel = ToxicityModel(),
) -> bytes:
    """The index, as bytes, from texts and the rows (key, label) of `labels` to learn from.

    Null labels teach nothing. Shares of labels are counted over all of `labels`; examples are the texts of each
    label with the smallest hashes, repeated texts once.
    """
    marked = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    # Hashes first: only the chosen examples' texts go on.
    hashed = cut_lineage(
        docs.select(docs[key].alias("k"), F.xxhash64(text_of(docs, text)).alias("h")).join(marked, "k")
        .groupBy("y", "h").agg(F.min("k").alias("k"))
    )
    sides = [hashed.where(F.col("y") == y).orderBy("h").limit(model.per_label).select("k", "y") for y in (0, 1)]
    chosen = {r["k"]: r["y"] for r in sides[0].unionByName(sides[1]).collect()}
    examples = docs.where(docs[key].isin(list(chosen))).select(docs[key].alias("k"), text_of(docs, text).alias("t"))
    # However often a chosen row is repeated, one goes on.
    examples = examples.groupBy("k").agg(F.min("t").alias("t"))
    shares = (float(counts.get(0, 0)), float(counts.get(1, 0)))

    def build(batches):
        def rows():
            for batch in batches:
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if k not in seen:
                        seen.add(k)
                        yield k, t, chosen[k]

        seen: set = set()
        data = build_index(rows(), shares, model).to_bytes()
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["index"])

    # One task: the sample is bounded. Sorted, so that every run numbers the examples alike.
    built = examples.repartition(1).sortWithinPartitions("k").mapInArrow(build, "index binary").first()
    return bytes(built[0]) if built else build_index(iter(()), shares, model).to_bytes()


def score_toxicity(
    docs: DataFrame, index: bytes, key: str = "doc_id", text: str = "text", model: ToxicityModel = ToxicityModel()
) -> DataFrame:
    """A row per document: key, `score`, `predicted`, `neighbours` (keys of the nearest examples) and `cosines`.

    Texts without a term, null and empty ones too, have no neighbours and get the calibrated score of no vote.
    Null keys stay; repeated rows are scored each. An empty table gives an empty result. Only the two named
    columns are read, so labels, languages and keys can't enter a score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by per_label and terms
    source = docs.select(docs[key].alias("k"), text_of(docs, text).alias("t"))
    kind = dict(source.dtypes)["k"]

    def score(batches):
        found = Index.from_bytes(shared.value, model)
        nothing = found.score([])
        for batch in batches:
            scores, keys, cosines = [], [], []
            for value in batch.column("t"):
                places, weights = found.vector(value.as_py())
                near = found.nearest(places, weights)
                scores.append(round(found.score(near), 6) if near else nothing)
                keys.append([int(found.keys[i]) for _, i in near])
                cosines.append([round(c, 6) for c, _ in near])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k"), pa.array(scores, pa.float64()), pa.array(keys, pa.list_(pa.int64())),
                    pa.array(cosines, pa.list_(pa.float64())),
                ],
                names=["k", "score", "neighbours", "cosines"],
            )

    out = source.mapInArrow(score, f"k {kind}, score double, neighbours array<bigint>, cosines array<double>")
    return out.select(
        F.col("k").alias(key), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours", "cosines"
    )


def reject_toxic(
    docs: DataFrame, index: bytes, text: str = "text", least: float = 0.5, model: ToxicityModel = ToxicityModel()
) -> DataFrame:
    """`docs` without the rows whose text scores `least` or more; rows and columns that stay are unchanged."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by per_label and terms

    def clean(batches):
        found = Index.from_bytes(shared.value, model)
        for batch in batches:
            keep = [
                found.score(found.nearest(*found.vector(value.as_py() or ""))) < least for value in batch.column(text)
            ]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def trained_on(spark, sf_dir: str) -> bytes:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return fit(docs, labels.where(~held_out(F.col("doc_id"))))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), trained_on(spark, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "neighbours", "cosines")
