"""Phrase collocations by prefix-free parsing.

Parsing. Texts are cut at punctuation and line ends into pieces, and pieces into overlapping chunks: a window of
`overlap` words whose hash is 0 modulo `every` ends one chunk and begins the next. Where chunks begin depends on the
words alone, so passages that repeat give the same chunks wherever they stand. Different chunks form a dictionary
with the number of times each was parsed; counting goes on in the dictionary only, weighted.

Ownership. A chunk that another one follows leaves n-grams that begin in its last `overlap` words to that one. As
no phrase is longer than `overlap` + 1 words, each occurrence lies whole in the chunk that owns its first word.

Counting. Words are counted first, then pairs of frequent words by their hashes, then all phrases in which every pair
may be frequent, as what they are. A filter of bounded size says what may be; hashes that meet, and a filter
that is full, let too many pass, which costs time and changes no result. Counts are summed per batch of chunks before they are shuffled.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenelake.llm.common import table, text_of
from scenelake.session import cut_lineage


@dataclass(frozen=True)
class PhraseParameters:
    """`longest`: most words of a phrase. `least`: occurrences of a candidate. `top`: phrases per language. `every`:
    one window of words in so many begins a chunk. `words`: words that a task looks at together, about.
    `filter_bits`: most bits of the filter. `salts`: tasks over which candidates with the same one-word part are spread."""

    longest: int = 5
    least: int = 100
    top: int = 2000
    every: int = 32
    words: int = 300_000
    filter_bits: int = 1 << 26
    salts: int = 16

    @property
    def overlap(self) -> int:
        return self.longest - 1


# A-Z become small, what ends a piece a line end, a tab a blank: one pass over the bytes.
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_PLAIN = bytes.maketrans(
    bytes(range(65, 91)) + _ENDS + b"\t", bytes(range(97, 123)) + b"\n" * len(_ENDS) + b" "
)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces_of(text: str) -> Iterator[list[bytes]]:
    """Words of each piece of a text that has any."""
    for piece in text.encode("utf-8", "replace").translate(_PLAIN).split(b"\n"):
        if words := piece.split():
            yield words


def chunks_of(words: list[bytes], ends: list[int], p: PhraseParameters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where chunks begin and end, and whether another follows, in the words of pieces that end at `ends`."""
    size, w = len(words), p.overlap
    piece_ends = np.array(ends, np.int64)
    piece_starts = np.concatenate([[0], piece_ends[:-1]])
    end_of = np.repeat(piece_ends, piece_ends - piece_starts)
    hashes = np.fromiter(map(zlib.crc32, words), np.uint64, size)
    window = np.zeros(max(size - w + 1, 0), np.uint64)
    for i in range(w):
        window = _mixed(window + hashes[i : i + len(window)] * _ODD)
    begins = np.flatnonzero(window % np.uint64(p.every) == 0)
    begins = begins[begins + w <= end_of[begins]]
    starts = np.union1d(piece_starts, begins)
    last = np.append(starts[1:], size)
    followed = last < end_of[starts]
    return starts, np.where(followed, last + w, end_of[starts]), followed


def parsed(docs: DataFrame, p: PhraseParameters) -> DataFrame:
    """(lang, chunk, followed, n) of (lang, text): the dictionary of different chunks and how often each was parsed."""

    def batch_of(counts: Counter) -> pa.RecordBatch:
        langs, chunks, followed = zip(*counts) if counts else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(langs, pa.string()), pa.array(chunks, pa.binary()).cast(pa.string()),
                pa.array(followed, pa.bool_()), pa.array(counts.values(), pa.int64()),
            ],
            names=["lang", "chunk", "followed", "n"],
        )

    def counted(words: list[bytes], ends: list[int], langs: list[str]) -> Counter:
        if not words:
            return Counter()
        starts, stops, followed = chunks_of(words, ends, p)
        of = np.searchsorted(np.array(ends), starts, side="right").tolist()
        return Counter(
            (langs[o], b" ".join(words[a:b]), f)
            for o, a, b, f in zip(of, starts.tolist(), stops.tolist(), followed.tolist())
        )

    def run(batches):
        words, ends, langs = [], [], []
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for piece in pieces_of(text.as_py()):
                    words += piece
                    ends.append(len(words))
                    langs.append(lang)
                if len(words) >= p.words:
                    yield batch_of(counted(words, ends, langs))
                    words, ends, langs = [], [], []
        yield batch_of(counted(words, ends, langs))

    chunks = docs.select("lang", "text").mapInArrow(run, "lang string, chunk string, followed boolean, n bigint")
    return chunks.groupBy("lang", "chunk", "followed").agg(F.sum("n").alias("n"))


class Filter:
    """A set of keys in a fixed number of bits, two a key; it may hold more than was put in."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(keys: np.ndarray, bits: int) -> np.ndarray:
        mask, spread = np.uint64(bits - 1), _mixed(keys)
        return np.concatenate([spread & mask, (spread >> np.uint64(32)) & mask])

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        one, two = np.split(self.places(_key(hashes), len(self.bits) * 64), 2)
        found = [self.bits[x >> np.uint64(6)] >> (x & np.uint64(63)) & np.uint64(1) for x in (one, two)]
        return (found[0] & found[1]).astype(bool)


def _hashes(values: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(v) for v in values), np.uint64, len(values))


def _begun(lang: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mixed(lang + word * _ODD)


def _longer(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mixed(phrase + word * _ODD)


def _key(hashes: np.ndarray) -> np.ndarray:
    """What is shuffled of a hash: 36 bits tell enough apart, and pack well."""
    return hashes >> np.uint64(28)


def keys_of_words(words: DataFrame) -> DataFrame:
    """(key) of (lang, phrase) of one word each."""

    def run(batches):
        for batch in batches:
            langs, words = (_hashes(batch.column(c).to_pylist()) for c in ("lang", "phrase"))
            yield pa.RecordBatch.from_arrays([pa.array(_key(_begun(langs, words)).astype(np.int64))], names=["key"])

    return words.select("lang", "phrase").mapInArrow(run, "key bigint")


def filter_of(keys: DataFrame, p: PhraseParameters) -> np.ndarray:
    """Bits of the filter on (key), as many as the number of keys asks for up to `filter_bits`."""
    size = min(p.filter_bits, 1 << max(12, int(16 * keys.count()).bit_length()))

    def places(batches):
        for batch in batches:
            at = Filter.places(batch.column("key").to_numpy().astype(np.uint64), size).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at)], names=["at"])

    words = keys.mapInArrow(places, "at bigint").groupBy(F.expr("at div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")
    )
    found = words.toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bits


class _Words:
    """The words of many chunks as numbers, with what is needed to count phrases in them."""

    def __init__(self, chunks: pa.Table, p: PhraseParameters):
        chunks = chunks.combine_chunks()
        lists = pc.split_pattern(chunks.column("chunk"), " ")
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        encoded = lists.flatten().dictionary_encode()
        lang = chunks.column("lang").combine_chunks().dictionary_encode()
        self.codes, self.words = encoded.indices.to_numpy().astype(np.int64), encoded.dictionary
        self.langs = lang.dictionary
        sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
        ends = np.cumsum(sizes)
        #: Words from a place to the end of its chunk, itself included; what its chunk owns.
        self.left = np.repeat(ends, sizes) - np.arange(len(self.codes))
        followed = chunks.column("followed").to_numpy().astype(np.int64)
        self.owned = self.left > np.repeat(followed * p.overlap, sizes)
        self.weights = np.repeat(chunks.column("n").to_numpy(), sizes)
        self.lang = np.repeat(lang.indices.to_numpy().astype(np.int64), sizes)

    def pairs(self, known: Filter) -> tuple[np.ndarray, np.ndarray]:
        """Places where two words follow each other that the filter holds, and the hashes of these pairs."""
        words = _hashes(self.words.to_pylist())
        hashes = _begun(_hashes(self.langs.to_pylist())[self.lang], words[self.codes])
        alive = known.holds(hashes)
        at = np.flatnonzero(alive[:-1] & alive[1:] & (self.left[:-1] >= 2))
        return at, _longer(hashes[at], words[self.codes[at + 1]])

    def starts(self, known: Filter, longest: int) -> Iterator[tuple[int, np.ndarray]]:
        """Sizes and places of owned phrases of two words and more, in which the filter holds every word and pair."""
        at, hashes = self.pairs(known)
        at = at[known.holds(hashes)]
        for k in range(2, longest + 1):
            yield k, at[self.owned[at]]
            alive = np.zeros(len(self.codes), bool)
            alive[at] = True
            at = np.flatnonzero(alive[:-1] & alive[1:] & (self.left[:-1] > k))

    def counts(self, k: int, at: np.ndarray) -> pa.RecordBatch:
        """(lang, phrase, n) of the phrases of k words that begin `at`."""
        base = len(self.words)
        group = self.lang[at] * base + self.codes[at]
        for j in range(1, k):
            if len(group) and (int(group.max()) + 1) * base >= 1 << 62:
                group = np.unique(group, return_inverse=True)[1]
            group = group * base + self.codes[at + j]
        _, first, inverse = np.unique(group, return_index=True, return_inverse=True)
        # Whole numbers below 2^53, which the sums of one batch are, are exact in floating point.
        sums = np.bincount(inverse, self.weights[at], minlength=len(first)).astype(np.int64)
        begin = at[first]
        parts = [self.words.take(pa.array(self.codes[begin + j])) for j in range(k)]
        phrases = pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0]
        return pa.RecordBatch.from_arrays(
            [self.langs.take(pa.array(self.lang[begin])), phrases, pa.array(sums)], names=["lang", "phrase", "n"]
        )


def _over_words(dictionary: DataFrame, schema: str, work, p: PhraseParameters) -> DataFrame:
    """What `work` makes of the words of many chunks at a time, whose number is bounded whatever a batch holds."""

    def run(batches):
        waiting, size = [], 0
        for batch in batches:
            step = max(1, batch.num_rows * 6 * p.words // max(batch.nbytes, 1))
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                waiting.append(part)
                size += part.nbytes
                if size >= 6 * p.words:
                    yield from work(_Words(pa.Table.from_batches(waiting), p))
                    waiting, size = [], 0
        if waiting:
            yield from work(_Words(pa.Table.from_batches(waiting), p))

    return dictionary.select("lang", "chunk", "followed", "n").mapInArrow(run, schema)


def _frequent(counts: DataFrame, p: PhraseParameters, *by: str) -> DataFrame:
    return cut_lineage(counts.groupBy(*by).agg(F.sum("n").alias("f")).where(F.col("f") >= p.least))


def frequent_phrases(dictionary: DataFrame, p: PhraseParameters) -> DataFrame:
    """(lang, phrase, f, k) of all phrases of 1 to `longest` words that occur `least` times or more."""
    context, phrase = dictionary.sparkSession.sparkContext, "lang string, phrase string, n bigint"
    counts = _over_words(dictionary, phrase, lambda w: [w.counts(1, np.flatnonzero(w.owned))], p)
    words = _frequent(counts, p, "lang", "phrase")
    word_keys = keys_of_words(words)
    of_words = context.broadcast(filter_of(word_keys, p))  # at most filter_bits, as below

    def pair_counts(w: _Words):
        at, hashes = w.pairs(Filter(of_words.value))
        keys, inverse = np.unique(_key(hashes[w.owned[at]]), return_inverse=True)
        sums = np.bincount(inverse, w.weights[at[w.owned[at]]], minlength=len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(sums)], names=["key", "n"])

    pair_keys = _frequent(_over_words(dictionary, "key bigint, n bigint", pair_counts, p), p, "key").select("key")
    of_both = context.broadcast(filter_of(word_keys.unionByName(pair_keys), p))

    def longer_counts(w: _Words):
        for k, at in w.starts(Filter(of_both.value), p.longest):
            yield w.counts(k, at)

    longer = _frequent(_over_words(dictionary, phrase, longer_counts, p), p, "lang", "phrase")
    return words.unionByName(longer).withColumn("k", F.size(F.split("phrase", " ")))


def scored(phrases: DataFrame, totals: DataFrame, p: PhraseParameters) -> DataFrame:
    """Candidates (lang, phrase, a, l, r, n, score) at their lowest-scoring cut."""
    words = F.split("phrase", " ")
    cuts = phrases.where("k > 1").select(
        "lang", "phrase", F.col("f").alias("a"), "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    ).select(
        "lang", "phrase", "a", "cut", F.array_join(F.slice(words, F.lit(1), F.col("cut")), " ").alias("first"),
        F.array_join(F.slice(words, F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("rest"),
    )
    # One word may be part of a large share of all candidates: its candidates are spread, and its count repeated.
    salt = F.pmod(F.xxhash64("phrase"), F.lit(p.salts)).cast("int")
    parts = phrases.select(
        "lang", F.col("phrase").alias("part"), "f",
        F.explode(F.when(F.col("k") == 1, F.sequence(F.lit(0), F.lit(p.salts - 1))).otherwise(F.array(F.lit(0)))).alias("salt"),
    )

    def with_count(df: DataFrame, part: str, name: str) -> DataFrame:
        own = F.when(F.instr(part, " ") == 0, salt).otherwise(0)
        return df.withColumn("salt", own).join(
            parts.withColumnsRenamed({"part": part, "f": name}), ["lang", part, "salt"]
        ).drop("salt")

    whole = with_count(with_count(cuts, "first", "l"), "rest", "r").join(totals, "lang")
    wide = lambda c: f"cast({c} as decimal(19,0))"
    score = F.expr(f"(cast(1000 as decimal(4,0)) * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})")
    least = whole.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    return least.select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score")


def without_contained(candidates: DataFrame, phrases: DataFrame) -> DataFrame:
    """Candidates that no longer phrase holds as often as they occur themselves.

    Only phrases one word longer are looked at: if a longer one is as frequent, so is each one between.
    """
    words = F.split("phrase", " ")
    holders = phrases.where("k > 2").select(
        "lang", F.col("f").alias("outer"),
        F.explode(F.array(
            F.array_join(F.slice(words, F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("k") - 1), " ")
        )).alias("phrase"),
    ).groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    found = candidates.join(holders, ["lang", "phrase"], "left")
    return found.where(F.col("outer").isNull() | (F.col("outer") < F.col("a"))).drop("outer")


def collocations(
    docs: DataFrame, lang: str = "lang", text: str = "text", p: PhraseParameters = PhraseParameters()
) -> DataFrame:
    """The `top` phrases of each language: lang, `rank`, `phrase`, `a` (its occurrences), `l` and `r` (those of the two
    parts of its lowest-scoring cut), `n` (all words of the language) and `score`.

    A-Z count as a-z. Ties go to the phrase that occurs more often, then to the smaller one by UTF-8 bytes; of
    cuts with equal scores the first counts. A null language is `und`, together with rows that say so. Null,
    empty and blank texts hold no words; repeated rows count each; a language without a frequent phrase gives no
    rows, an empty table none at all. Only the two named columns are read.
    """
    source = docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), text_of(docs, text).alias("text"))
    dictionary = cut_lineage(parsed(source, p))
    words = F.size(F.split("chunk", " ")) - F.when(F.col("followed"), F.lit(p.overlap)).otherwise(0)
    totals = dictionary.groupBy("lang").agg(F.sum(words * F.col("n")).alias("n"))
    phrases = frequent_phrases(dictionary, p)
    left = without_contained(scored(phrases, cut_lineage(totals), p), phrases)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
