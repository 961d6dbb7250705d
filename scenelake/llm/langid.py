"""Language of web pages by fusing evidence.

log P(language | page) = log prior of the page's host + tempered log likelihood of its text
                       + log P(declared language | language) + log P(suffix's language | language).

* Text: hashed byte trigrams of the visible text, multinomial with additive smoothing, trained on a bounded
  sample of texts of each language (`LanguageModel.per_language`).
* Declared language and address suffix: both are small tables of how often a language (by its text) declares
  each, counted over all pages.
* Host prior: soft counts of languages (by text) summed over host, domain and everything, each level smoothed
  by the one above, without the page's own share.

Text is looked at once; what is joined and summed afterwards are a few numbers per page.
"""

from __future__ import annotations

import html as markup
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.llm.common import table
from scenelake.session import cut_lineage

LANGUAGES = ("de", "en", "es", "fr")
# Country suffixes whose main language is one of the above.
SUFFIXES = {
    "de": "de", "at": "de", "li": "de", "uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en",
    "es": "es", "mx": "es", "ar": "es", "cl": "es", "co": "es", "pe": "es", "fr": "fr",
}
HIDDEN = re.compile(r"(?is)<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*(?:>|\Z)")
# The attributes of a tag end where another one begins, so no part of a page is looked at twice.
HTML_TAG = re.compile(r"(?i)<html\b([^<>]*)")
LANG = re.compile(r"""(?i)\slang\s*=\s*["']?([a-z]{2,3})""")


@dataclass(frozen=True)
class LanguageModel:
    """`per_language`: most texts of a language that train the likelihood. `buckets`: hashed trigrams.
    `most_grams`: trigrams a text counts for at most, since neighbours aren't independent: the mean log
    likelihood times this. `smoothing`: of the small tables. `strength`: pages the level above counts for."""

    languages: tuple[str, ...] = LANGUAGES
    per_language: int = 300
    buckets: int = 1 << 15
    most_grams: float = 30.0
    smoothing: float = 1.0
    strength: float = 20.0


def visible_text(html: str | None) -> str:
    """Text outside markup; a tag or comment that is never closed hides the rest of the page."""
    return markup.unescape(HIDDEN.sub(" ", html or ""))


def declared_language(html: str | None) -> str | None:
    for tag in HTML_TAG.finditer(html or ""):
        if found := LANG.search(tag.group(1)):
            return found.group(1).lower()
    return None


def _grams(text: str, buckets: int) -> np.ndarray:
    data = np.frombuffer(" ".join(text.lower().split()).encode(), np.uint8).astype(np.uint64)
    if len(data) < 3:
        return np.zeros(0, np.int64)
    keys = (data[:-2] << np.uint64(16)) | (data[1:-1] << np.uint64(8)) | data[2:]
    mixed = keys * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(40)).astype(np.int64) % buckets


def train_likelihood(texts: DataFrame, model: LanguageModel = LanguageModel()) -> np.ndarray:
    """Log likelihoods (buckets x languages) from a bounded table (lang, text)."""
    names, buckets = list(model.languages), model.buckets

    def count(batches):
        sums = np.zeros((buckets, len(names)), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang in names:
                    sums[:, names.index(lang)] += np.bincount(_grams(text or "", buckets), minlength=buckets)
        held = np.flatnonzero(sums.any(axis=1))
        columns = [pa.array(held, pa.int64()), *(pa.array(c) for c in sums[held].T)]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", *(f"_{i}" for i in range(len(names)))])

    # Summed by Spark: a row per bucket comes to the driver, however many tasks the texts are dealt over.
    schema = ", ".join(["bucket bigint", *(f"_{i} bigint" for i in range(len(names)))])
    counts = texts.select("lang", "text").mapInArrow(count, schema).groupBy("bucket").agg(
        *(F.sum(f"_{i}").alias(f"_{i}") for i in range(len(names)))
    )
    sums = np.zeros((len(names), buckets), np.int64)
    for bucket, *row in counts.collect():
        sums[:, bucket] = row
    shares = (sums + 0.5) / (sums + 0.5).sum(axis=1, keepdims=True)
    return np.log(shares).T


def training_texts(docs: DataFrame, model: LanguageModel = LanguageModel()) -> DataFrame:
    """The bounded sample (lang, text): of each language the texts with the smallest hashes of their key.
    Keys are found without reading a text."""
    keys: list[int] = []
    for lang in model.languages:
        chosen = docs.where(F.col("lang") == lang).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id")
        keys += [r[0] for r in chosen.limit(model.per_language).collect()]
    # However often a chosen row is repeated, one goes on.
    return docs.where(F.col("doc_id").isin(keys)).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _sums(facts: DataFrame, by: list[str], n: int) -> DataFrame:
    return facts.groupBy(*by).agg(*(F.sum(F.col("soft")[i]).alias(f"_{i}") for i in range(n)))


def identify(
    pages: DataFrame, likelihood: np.ndarray, key: str = "page_id", url: str = "url", html: str = "html",
    model: LanguageModel = LanguageModel(),
) -> DataFrame:
    """A row per page: key, `lang`, `confidence`, the evidence (`text_lang`, `declared_lang`, `suffix_lang`,
    `host`) and `posterior` (in the order of `model.languages`).

    A page without text, URL or markup has only the other evidence; without any the shares of all pages
    decide. Ties go to the first language. Null keys stay; repeated rows are judged each, and count each for
    their host. An empty table gives an empty result. Only the three named columns are read.
    """
    names, n, most = list(model.languages), len(model.languages), model.most_grams
    buckets = model.buckets

    def scan(batches):
        for batch in batches:
            evidence, declared = [], []
            for text in batch.column("html").to_pylist():
                grams = _grams(visible_text(text), buckets)
                score = likelihood[grams].mean(axis=0) * min(most, len(grams)) if len(grams) else np.zeros(n)
                evidence.append((score - score.max()).round(6).tolist())
                declared.append(declared_language(text))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k"), batch.column("host"),
                    pa.array(evidence, pa.list_(pa.float64())), pa.array(declared, pa.string()),
                ],
                names=["k", "host", "evidence", "declared"],
            )

    source = pages.select(
        pages[key].alias("k"), _host(pages[url].cast("string")).alias("host"), pages[html].cast("string").alias("html")
    )
    kind = dict(source.dtypes)["k"]
    seen = source.mapInArrow(scan, f"k {kind}, host string, evidence array<double>, declared string")
    weights = F.transform("evidence", lambda x: F.exp(x))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    suffix = F.create_map(*(F.lit(x) for pair in SUFFIXES.items() for x in pair))
    facts = cut_lineage(seen.select(
        "k", "host", "evidence",
        F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("site"),
        F.when(F.col("declared").isin(names), F.col("declared")).when(F.col("declared").isNull(), "none")
        .otherwise("other").alias("declared"),
        F.coalesce(
            F.when(F.col("host") != "", F.element_at(suffix, F.regexp_extract("host", r"([^.]*)$", 1))), F.lit("none")
        ).alias("suffix"),
        F.transform(weights, lambda w: w / total).alias("soft"),
    ))

    # Both tables have a few dozen rows, whatever the pages are.
    def chances(column: str) -> dict[str, list[float]]:
        counts = {r[0]: [float(r[f"_{i}"]) for i in range(n)] for r in _sums(facts, [column], n).collect()}
        values = [*names, "none", "other"]
        sums = [sum(c[i] for c in counts.values()) for i in range(n)]
        s = model.smoothing
        return {
            v: [(counts.get(v, [0.0] * n)[i] + s) / (sums[i] + s * len(values)) for i in range(n)] for v in values
        }

    def looked_up(column: str, chance: dict[str, list[float]]) -> Column:
        logs = {v: F.array(*(F.lit(round(float(np.log(x)), 9)) for x in row)) for v, row in chance.items()}
        out = logs["other"]
        for value, row in logs.items():
            out = F.when(F.col(column) == value, row).otherwise(out)
        return out

    whole = facts.agg(*(F.coalesce(F.sum(F.col("soft")[i]), F.lit(0.0)).alias(f"_{i}") for i in range(n))).first()
    shares = [(float(x) + 1.0) / (sum(map(float, whole)) + n) for x in whole]

    def prior(own: str, above: list[Column]) -> list[Column]:
        counts = [F.greatest(F.col(f"{own}_{i}") - F.col("soft")[i], F.lit(0.0)) for i in range(n)]
        size = sum(counts, F.lit(0.0))
        return [(c + model.strength * a) / (size + model.strength) for c, a in zip(counts, above)]

    joined = facts
    for level in ("site", "host"):
        sums = _sums(facts, [level], n).select(level, *(F.col(f"_{i}").alias(f"{level}_{i}") for i in range(n)))
        joined = joined.join(sums, level, "left")
    by_site = prior("site", [F.lit(x) for x in shares])
    by_host = prior("host", by_site)
    fused = joined.withColumn("declared_log", looked_up("declared", chances("declared"))).withColumn(
        "suffix_log", looked_up("suffix", chances("suffix"))
    )
    logs = F.array(*(
        F.col("evidence")[i] + F.col("declared_log")[i] + F.col("suffix_log")[i] + F.log(by_host[i]) for i in range(n)
    ))
    scored = fused.withColumn("logs", logs)
    top = F.array_max("logs")
    odds = F.transform("logs", lambda x: F.exp(x - top))
    out = scored.withColumn("odds", odds).withColumn(
        "posterior",
        F.transform("odds", lambda x: F.round(x / F.aggregate("odds", F.lit(0.0), lambda a, y: a + y), 6)),
    )
    named = F.array(*map(F.lit, names))
    best = lambda c: F.get(named, (F.array_position(c, F.array_max(c)) - 1).cast("int"))
    known = lambda c: F.when(~F.col(c).isin("none", "other"), F.col(c))
    return out.select(
        F.col("k").alias(key), best("posterior").alias("lang"), F.array_max("posterior").alias("confidence"),
        best("evidence").alias("text_lang"), known("declared").alias("declared_lang"),
        known("suffix").alias("suffix_lang"), "host", "posterior",
    )


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    model = LanguageModel()
    likelihood = train_likelihood(training_texts(table(spark, sf_dir, "documents"), model), model)
    return identify(table(spark, sf_dir, "pages"), likelihood, model=model)
