"""Quality rules: counts over whole texts, and how far a text's histograms lie from its language.

The method compares two histograms of a text, of character classes and of common words, to those of the
reference languages by Jensen-Shannon distance (base 2, so 0 to 1). The reference of a language is the sum of
the histograms over all texts that declare it. A text is rejected if it lies far from every language, in a
histogram that holds enough for the distance to mean something (the minimum-length guards).

Most words of any text are in the last bin of the common-word histogram, which keeps its distance small. So the
common words are also compared among themselves, and their share of a text has a limit of its own. Both limits come
from the references: a share that no language is far above, and a distance at which languages lie from each other.

Everything is an expression over one row but for the references, one grouped sum.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.llm.common import BLANK, let, table, text_of, words_of
from scenelake.session import cut_lineage

# Frequent short words of the reference languages.
COMMON_WORDS = (
    "the and of to in is it for that with was be on as "
    "der die das und ist zu den von mit auf ein nicht dem des "
    "le la les et un une du que qui dans pour est en de "
    "el los las y del una con por para es como al se"
)
# Classes of characters, each as a pattern for a run of it; what is in none is "other".
CHARACTER_CLASSES = {
    "lower": "[a-z]+",
    "blank": f"[{BLANK}]+",
    "upper": "[A-Z]+",
    "mark": r"[.,;:!?'\"()-]+",
    "digit": "[0-9]+",
    "symbol": "[#*$%&|<>]+",
    "letter": r"\p{L}+",
}


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules.

    `window`: words a repeated passage has at least. `min_words`, `max_repeat_percent`: base rules.
    `max_class_distance`, `max_word_distance`: largest Jensen-Shannon distance to the nearest language.
    `min_chars`, `min_words_compared`: a shorter text isn't held against the histogram.
    `listed_part`, `listed_slack`: a text has at least this part of the share of common words that the language with
    the smallest share has, less the slack of some words, so that only texts of a few dozen words on can fail.
    `distance_part`: largest distance of the common words among themselves to the nearest language, as a part of the
    smallest distance between two languages, in a text with `min_listed` of them; `lone_distance` is it if there is
    only one language.
    """

    window: int = 8
    min_words: int = 20
    max_repeat_percent: int = 30
    max_class_distance: float = 0.45
    max_word_distance: float = 0.95
    min_chars: int = 200
    min_words_compared: int = 200
    words: tuple[str, ...] = field(default_factory=lambda: tuple(dict.fromkeys(COMMON_WORDS.split())))
    listed_part: float = 0.45
    listed_slack: int = 3
    distance_part: float = 0.8
    lone_distance: float = 0.75
    min_listed: int = 20


def _repeated_words(words: Column, window: int) -> Column:
    """Words covered by windows that occur twice or more. Windows are told apart by 64-bit hashes, within one
    text only; hashes are sorted, so the work is n log n for a text of any length."""

    def covered(hashes: Column) -> Column:
        placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

        def of_sorted(s: Column) -> Column:
            n = F.size(s)
            tied = F.filter(
                F.zip_with(
                    s,
                    F.zip_with(
                        F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(s, 1, n - 1)),
                        F.concat(F.slice(s, 2, n - 1), F.array(F.lit(None).cast("struct<h:bigint,i:int>"))),
                        lambda a, b: F.struct(a["h"].alias("before"), b["h"].alias("after")),
                    ),
                    lambda x, near: F.when(
                        x["h"].eqNullSafe(near["before"]) | x["h"].eqNullSafe(near["after"]), x["i"]
                    ),
                ),
                lambda i: i.isNotNull(),
            )
            start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("sum"))
            return F.aggregate(
                F.sort_array(tied),
                start,
                lambda acc, i: F.struct(
                    i.alias("last"), (acc["sum"] + F.least(F.lit(window), i - acc["last"])).alias("sum")
                ),
                lambda acc: acc["sum"],
            )

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            let(F.sort_array(placed), of_sorted)
        )

    def of_width(hashes: Column, width: int) -> Column:
        """Hashes of `width` neighbours each, from hashes of halves."""
        if width == 1:
            return hashes
        half = width // 2

        def joined(first: Column, second: Column) -> Column:
            n = F.size(hashes) - width + 1
            return F.zip_with(F.slice(first, 1, n), F.slice(second, half + 1, n), lambda a, b: F.xxhash64(a, b))

        if width == 2 * half:
            return let(of_width(hashes, half), lambda h: joined(h, h))
        return joined(of_width(hashes, half), of_width(hashes, width - half))

    hashed = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: of_width(h, window))
    return F.when(F.size(words) > window, let(hashed, covered)).otherwise(F.lit(0)).cast("long")


def text_counts(
    docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text", key: str = "doc_id", lang: str = "lang"
) -> DataFrame:
    """Counts of each text, with its histograms `classes` and `commons` (the last place of each: the rest).

    Null texts count as empty. Rows are kept as they come, repeated keys too.
    """
    base = docs.select(
        docs[key].alias("key"), docs[lang].cast("string").alias("lang"), text_of(docs, text).alias("text")
    )
    # Each class is taken out of what the ones before have left, so only the first two scan whole texts.
    steps = base
    left = "text"
    for name, pattern in CHARACTER_CLASSES.items():
        steps = steps.withColumn(f"_{name}", F.regexp_replace(F.col(left), pattern, ""))
        left = f"_{name}"
    sizes = [F.length(c) for c in ("text", *(f"_{n}" for n in CHARACTER_CLASSES))]
    classes = F.array(*(a - b for a, b in zip(sizes, sizes[1:])), sizes[-1]).cast("array<long>")
    place = list(CHARACTER_CLASSES).index
    steps = steps.select(
        "key", "lang", "text", classes.alias("classes"), words_of(F.col("text")).alias("words")
    )
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(f"[^{BLANK}]"))
    listed = F.array(*map(F.lit, rules.words))
    commons = let(
        F.filter("words", lambda w: w.isin(*rules.words)),
        lambda found: F.transform(listed, lambda w: (F.size(found) - F.size(F.array_remove(found, w))).cast("long")),
    )
    return steps.select(
        "key", "lang", "classes", commons.alias("found"),
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - F.col("classes")[place("blank")]).cast("long").alias("word_chars"),
        F.col("classes")[place("symbol")].alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("words"), rules.window).alias("n_repeat_words"),
    ).withColumn(
        "commons",
        F.concat("found", F.array(F.col("n_words") - F.aggregate("found", F.lit(0).cast("long"), lambda a, x: a + x))),
    ).drop("found")


def language_references(counts: DataFrame) -> list[tuple[list[float], list[float]]]:
    """Shares of character classes and common words of each language, over all texts that declare it.

    One grouped sum; a row per language and class, so what comes to the driver doesn't grow with the texts.
    """
    parts = [
        counts.where("lang is not null").select("lang", F.lit(name).alias("kind"), F.posexplode(name))
        for name in ("classes", "commons")
    ]
    sums = parts[0].unionByName(parts[1]).groupBy("lang", "kind", "pos").agg(F.sum("col").alias("n"))
    found: dict[str, dict[str, dict[int, int]]] = {}
    for lang, kind, pos, n in sums.collect():
        found.setdefault(lang, {}).setdefault(kind, {})[pos] = n
    out = []
    for lang in sorted(found):
        shares = []
        for kind in ("classes", "commons"):
            values = [v for _, v in sorted(found[lang].get(kind, {}).items())]
            shares.append([v / sum(values) for v in values] if sum(values) else [])
        if all(shares):
            out.append((shares[0], shares[1]))
    return out


def _among_listed(reference: list[float]) -> list[float]:
    """Shares of common words among themselves."""
    total = sum(reference[:-1])
    return [x / total for x in reference[:-1]]


def reference_distance(one: list[float], two: list[float]) -> float:
    """Jensen-Shannon distance of two references."""
    part = lambda p, q: p * math.log2(2 * p / (p + q)) if p else 0.0
    return math.sqrt(max(0.0, sum(part(p, q) + part(q, p) for p, q in zip(one, two)) / 2))


def listed_limits(references: list[tuple[list[float], list[float]]], rules: QualityRules) -> tuple[float, float]:
    """Smallest share of common words of a text, and their largest distance, both to four places."""
    listed = [r[1] for r in references if sum(r[1][:-1]) > 0]
    if not listed:
        return 0.0, rules.lone_distance
    among = [_among_listed(r) for r in listed]
    apart = [reference_distance(a, b) for a, b in itertools.combinations(among, 2)]
    share = rules.listed_part * min(sum(r[:-1]) for r in listed)
    return round(share, 4), round(rules.distance_part * min(apart), 4) if apart else rules.lone_distance


def _distance(shares: Column, reference: list[float]) -> Column:
    """Square root of the Jensen-Shannon divergence, base 2."""

    def term(p: Column, q: Column) -> Column:
        middle = (p + q) / 2
        own = F.when(p > 0, p * F.log2(p / middle)).otherwise(0.0)
        other = F.when(q > 0, q * F.log2(q / middle)).otherwise(0.0)
        return own + other

    terms = F.zip_with(shares, F.array(*map(F.lit, reference)), term)
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(F.lit(0.0), total / 2))


def _nearest(histogram: str, references: list[list[float]]) -> Column:
    total = F.aggregate(histogram, F.lit(0).cast("long"), lambda a, x: a + x)
    shares = let(total, lambda n: F.transform(histogram, lambda x: x / n))
    return F.when(
        total > 0, let(shares, lambda s: F.array_min(F.array(*(_distance(s, r) for r in references))))
    )


def quality_verdicts(counts: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """`counts` with `base_failed`, the distances, `n_listed` (common words) and two verdicts: `kept_histograms` by the
    base rules and the whole histograms, `kept` by the rules for common words too.

    Without any declared language there is no reference: distances are null and only the base rules hold.
    """
    references = language_references(counts)
    nothing = F.lit(None).cast("double")
    # At least two values under array_min and friends keep one plan for any number of languages.
    class_distance = _nearest("classes", [r[0] for r in references]) if references else nothing
    word_distance = _nearest("commons", [r[1] for r in references]) if references else nothing
    listed = [_among_listed(r[1]) for r in references if sum(r[1][:-1]) > 0]
    listed_distance = _nearest("listed", listed) if listed else nothing
    least_share, most_distance = listed_limits(references, rules)
    base_failed = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")
    )
    chars = F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)
    odd_classes = (chars >= rules.min_chars) & (F.col("class_distance") > rules.max_class_distance)
    odd_words = (F.col("n_words") >= rules.min_words_compared) & (F.col("word_distance") > rules.max_word_distance)
    few_listed = F.col("n_listed") + rules.listed_slack < least_share * F.col("n_words")
    odd_listed = (F.col("n_listed") >= rules.min_listed) & (F.col("listed_distance") > most_distance)
    return (
        counts.withColumn("listed", F.slice("commons", 1, len(rules.words)))
        .withColumns({
            "class_distance": class_distance, "word_distance": word_distance, "base_failed": base_failed,
            "n_listed": F.aggregate("listed", F.lit(0).cast("long"), lambda a, x: a + x),
            "listed_distance": listed_distance,
        })
        .withColumn(
            "kept_histograms",
            ~F.col("base_failed") & ~F.coalesce(odd_classes, F.lit(False)) & ~F.coalesce(odd_words, F.lit(False)),
        )
        .withColumn(
            "kept",
            F.col("kept_histograms") & ~((few_listed & bool(listed)) | F.coalesce(odd_listed, F.lit(False))),
        )
        .drop("listed")
    )


def judge_quality(
    docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text", key: str = "doc_id", lang: str = "lang"
) -> DataFrame:
    """A row per document: key, counts, `base_failed`, distances, `kept_histograms` and `kept`.

    Null and empty texts have no words and fail the base rules; null keys and languages stay; repeated rows are
    judged each; an empty table gives an empty result. Only the three named columns are read. The counts are
    written once, since the references need all of them before the first verdict.
    """
    counts = cut_lineage(text_counts(docs, rules, text, key, lang))
    return quality_verdicts(counts, rules).withColumnRenamed("key", key)


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    judged = judge_quality(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"),
        "n_listed", F.round("listed_distance", 6).alias("listed_distance"),
    )


def op10_quality_listed(spark, sf_dir: str) -> DataFrame:
    """The verdict by the whole histograms beside the one by all rules."""
    judged = judge_quality(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "n_listed", "kept_histograms", "kept",
        F.round("listed_distance", 6).alias("listed_distance"),
    )
