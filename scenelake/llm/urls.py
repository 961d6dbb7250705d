"""URL filters: listed rules first, and for the rest a logistic regression on hashed character n-grams.

The labelled URL table is small: a bounded sample of the URLs that a rule decides, evenly from both verdicts
(`UrlModel.per_label` each, by hash of the URL, so every run takes the same). Training is full-batch gradient
descent: a step is one grouped sum over the sample's n-grams, and only its `buckets` sums come to the driver.
Weights then stand in the scoring expression as one literal array, so scoring needs no join and no shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.llm.common import let, table
from scenelake.session import cut_lineage

# The rules asked for, (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlModel:
    """`sizes`: lengths of the n-grams. `buckets`: hashed features. `per_label`: most URLs a verdict gives
    to training. `steps`, `rate`, `penalty`: gradient descent with
    steps scaled by each weight's past gradients, and its L2 term."""

    sizes: tuple[int, ...] = (3, 4)
    buckets: int = 2048
    per_label: int = 1000
    steps: int = 20
    rate: float = 1.0
    penalty: float = 1e-4


def host_of(url: Column) -> Column:
    """Lower-cased host; empty for null and for URLs without `://`."""
    found = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Path up to the query or fragment; empty for null and for URLs without `://`."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), else null. Of equally long ones the first by name."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, at, prefix in reversed(ranked):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(prefix)
        found = F.when(
            fits, F.struct(F.lit(at + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
        ).otherwise(found)
    return found


def features(host: Column, path: Column, model: UrlModel) -> Column:
    """Buckets of the character n-grams of host and path, each once. Host and path have marked ends, so that
    an n-gram says where it stands; a bias is added by the caller."""

    def grams(text: Column) -> Column:
        parts = []
        for n in model.sizes:
            parts.append(F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))),
                lambda i, n=n: F.pmod(F.xxhash64(F.substring(text, i, F.lit(n))), F.lit(model.buckets)).cast("int"),
            ))
        return F.concat(*parts)

    marked = lambda kind, c: F.concat(F.lit(kind + "^"), c, F.lit("$"))
    return F.array_distinct(F.concat(let(marked("h", host), grams), let(marked("p", path), grams)))


def _score(found: Column, weights: list[float], bias: float) -> Column:
    """Probability that a URL is to be blocked. Features share their weight by the root of their number."""
    # One text, cast once when the plan is made: a literal array without thousands of expressions.
    table_ = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    total = F.aggregate(found, F.lit(0.0), lambda a, i: a + F.get(table_, i))
    return 1.0 / (1.0 + F.exp(-(F.lit(bias) + total / F.sqrt(F.size(found)))))


def labelled_urls(pages: DataFrame, url: str, model: UrlModel, rules=RULES) -> DataFrame:
    """(url, label) of a bounded sample of the different URLs that a rule decides; label 1 is block."""
    ruled = pages.select(pages[url].alias("url")).where("url is not null").withColumn(
        "verdict", rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"]
    )
    sides = [
        ruled.where(F.col("verdict") == verdict)
        .select("url").distinct()
        .orderBy(F.xxhash64("url"), "url")
        .limit(model.per_label)
        .select("url", F.lit(label).alias("label"))
        for verdict, label in (("allow", 0), ("block", 1))
    ]
    return sides[0].unionByName(sides[1])


def train(labelled: DataFrame, model: UrlModel = UrlModel()) -> tuple[list[float], float]:
    """Weights and bias of the regression over a small table (url, label); label 1 is block.

    Without rows of both labels nothing can be learned: weights are zero and the bias follows the label seen,
    or allows when there is none.
    """
    sample = cut_lineage(labelled.select(
        features(host_of(F.col("url")), path_of(F.col("url")), model).alias("f"), F.col("label").cast("double").alias("y")
    ))
    n, ones = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if not n or not 0 < ones < n:
        return [0.0] * model.buckets, (1.0 if n and ones else -1.0)
    weights, bias = [0.0] * model.buckets, math.log(ones / (n - ones))
    past, bias_past = [1e-8] * model.buckets, 1e-8
    for _ in range(model.steps):
        error = _score(F.col("f"), weights, bias) - F.col("y")
        sums = (
            sample.select(F.explode(F.concat("f", F.array(F.lit(-1)))).alias("bucket"), error.alias("e"), F.size("f").alias("n"))
            .groupBy("bucket")
            .agg(F.sum(F.when(F.col("bucket") < 0, F.col("e")).otherwise(F.col("e") / F.sqrt("n"))).alias("g"))
            .collect()
        )
        slope = {r["bucket"]: r["g"] / n for r in sums}
        bias_past += slope.get(-1, 0.0) ** 2
        bias -= model.rate * slope.get(-1, 0.0) / math.sqrt(bias_past)
        for i, g in slope.items():
            if i >= 0:
                g += model.penalty * weights[i]
                past[i] += g * g
                weights[i] -= model.rate * g / math.sqrt(past[i])
    # Rounded, so that the order of sums in a run doesn't show.
    return [round(w, 6) for w in weights], round(bias, 6)


def judge_urls(
    pages: DataFrame, weights: list[float], bias: float, url: str = "url", key: str = "page_id",
    model: UrlModel = UrlModel(), rules=RULES,
) -> DataFrame:
    """A row per page: key, host, path, rule, verdict and the score of the regression (high: block).

    A rule's verdict goes before the score's. Null URLs, and those without `://`, have empty host and path, and
    are judged by the score of these. Repeated rows are judged each; other columns aren't read.
    """
    parts = pages.select(pages[key].alias("k"), pages[url].alias("url")).select(
        "k", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    ruled = parts.select("k", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("r"))
    scored = ruled.withColumn("score", _score(features(F.col("host"), F.col("path"), model), weights, bias))
    return scored.select(
        F.col("k").alias(key), "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score",
    )


def op8_url_filters(spark, sf_dir: str) -> DataFrame:
    pages, model = table(spark, sf_dir, "pages"), UrlModel()
    weights, bias = train(labelled_urls(pages, "url", model), model)
    return judge_urls(pages, weights, bias, model=model)
