"""Mixing sources to target weights.

Documents hang under a tree of levels (domain, language, source). Weights are passed down it: a node's budget of
tokens is shared by its children in proportion to their weights, but no child gets more than its documents can
give in `max_epochs` epochs. What a child can't give goes to its siblings first; only what a whole family can't
give has been passed on one level up, because a family's limit is the sum of its members'. One window per level
finds the shares: with children sorted by limit over weight, the first ones are full and the rest share evenly.

A leaf's budget is whole epochs of all its documents and then a prefix of one more epoch, whose order is
seeded: documents by the hexadecimal MD5 of seed, epoch and key. Where the prefix ends is found by sums over
hash prefixes, 256 at a time, so no task ever sorts a whole leaf.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenelake.llm.common import table, text_of, words_of
from scenelake.session import cut_lineage

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class MixTarget:
    """`weights`: level -> value -> weight among its siblings; what isn't listed weighs 1. `budget_percent`:
    tokens to draw, of those there are. `max_epochs`: most epochs of a leaf. `digits`: pairs of hash digits that
    are summed before the rest is sorted; 2 leaves about 1 / 65,536 of a leaf to sort."""

    weights: Mapping[str, Mapping[str, float]] = field(default_factory=dict)
    budget_percent: int = 100
    max_epochs: int = 4
    seed: int = 17
    digits: int = 2


def _weight(level: str, target: MixTarget) -> Column:
    out = F.lit(1.0)
    for value, weight in target.weights.get(level, {}).items():
        out = F.when(F.col(level) == value, float(weight)).otherwise(out)
    return out


def _shared(children: DataFrame, parent: list[str], level: str, target: MixTarget) -> DataFrame:
    """Children (with `most` and their parent's `given`) with their own share as `given`."""
    family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(1))
    ordered = family.orderBy("level_ratio", level)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    after = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    known = children.withColumn("w", _weight(level, target)).withColumn("level_ratio", F.col("most") / F.col("w"))
    rate = (F.col("given") - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("w").over(after)
    rated = known.withColumn("rate", rate).withColumn("full", F.col("level_ratio") <= F.col("rate"))
    first_open = F.min(F.when(~F.col("full"), F.struct("level_ratio", level, "rate"))).over(family)["rate"]
    return rated.withColumn(
        "given", F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("w") * first_open)
    ).drop("w", "level_ratio", "rate", "full")


def leaf_budgets(sizes: DataFrame, target: MixTarget = MixTarget(), levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """A row a leaf: its levels, tokens `supply`, `budget`, and with it `epochs` and `rest` (tokens of the prefix).

    `sizes`: the levels and `tokens`. Leaves without tokens get no budget.
    """
    leaves = cut_lineage(sizes.groupBy(*levels).agg(F.sum("tokens").alias("supply"))).where("supply > 0")
    leaves = leaves.withColumn("most", F.col("supply") * target.max_epochs)
    whole = leaves.agg(
        (F.sum("supply") * target.budget_percent / 100.0).alias("asked"), F.sum("most").alias("can")
    ).select(F.least("asked", "can").cast("double").alias("given"))
    above = whole
    for depth, level in enumerate(levels):
        parent, own = list(levels[:depth]), list(levels[: depth + 1])
        nodes = leaves.groupBy(*own).agg(F.sum("most").alias("most"))
        nodes = nodes.join(above, parent) if parent else nodes.crossJoin(F.broadcast(above))  # one row
        above = _shared(nodes, parent, level, target).select(*own, "given")
    budget = F.least(F.floor(F.round("given", 3)), F.col("most")).cast("long")
    return leaves.join(above, list(levels)).select(
        *levels, "supply", budget.alias("budget")
    ).select(
        *levels, "supply", "budget",
        F.floor(F.col("budget") / F.col("supply")).cast("long").alias("epochs"),
    ).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("supply"))


def draw(
    docs: DataFrame, key: str, levels: Mapping[str, Column], tokens: Column, target: MixTarget = MixTarget()
) -> DataFrame:
    """A row per document: key, the levels, `n_tokens` and `copies`, how often the mix takes it (0: not).

    Null levels count as the value "unknown", null texts as empty. Rows that repeat a key are drawn each, next to
    each other in every epoch's order. An empty table gives an empty result. Only named columns are read.
    """
    names = list(levels)
    sizes = cut_lineage(docs.select(
        docs[key].alias("k"),
        *(F.coalesce(c.cast("string"), F.lit("unknown")).alias(n) for n, c in levels.items()),
        tokens.cast("long").alias("tokens"),
    ))
    leaves = cut_lineage(leaf_budgets(sizes, target, tuple(names)))
    ordered = sizes.join(leaves, names, "left").select(
        "k", *names, "tokens", F.coalesce("epochs", F.lit(0)).alias("epochs"), "rest",
        F.md5(F.concat_ws(":", F.lit(target.seed), "epochs", F.coalesce(F.col("k").cast("string"), F.lit("")))
              .cast("binary")).alias("h"),
    )
    ordered = cut_lineage(ordered)
    # `prefix`: the hash digits where a leaf's prefix ends, as far as known; `taken`: its tokens before them.
    ends = leaves.select(*names, F.lit("").alias("prefix"), F.lit(0).cast("long").alias("taken"))
    family = Window.partitionBy(*names).orderBy("part")
    for depth in range(target.digits):
        width = 2 * (depth + 1)
        inside = ordered.where("rest is not null").join(ends, names).where(
            F.substring("h", 1, width - 2) == F.col("prefix")
        )
        sums = inside.groupBy(*names, F.substring("h", 1, width).alias("part")).agg(
            F.sum("tokens").alias("n"), F.first("rest").alias("rest"), F.first("taken").alias("taken")
        )
        running = sums.withColumn("upto", F.col("taken") + F.sum("n").over(family))
        # The part in which the prefix ends: the first that goes beyond the rest.
        ends = cut_lineage(running.where(F.col("upto") > F.col("rest")).groupBy(*names).agg(
            F.min(F.struct("part", (F.col("upto") - F.col("n")).alias("taken"))).alias("e")
        ).select(*names, F.col("e.part").alias("prefix"), F.col("e.taken").alias("taken")))
    width = 2 * target.digits
    placed = ordered.join(ends, names, "left").withColumn("part", F.substring("h", 1, width))
    # No end: the rest holds the whole epoch, which only an empty rest of an empty leaf can do.
    decided = placed.withColumn(
        "state",
        F.when(F.col("rest").isNull() | F.col("prefix").isNull(), 0)
        .when(F.col("part") < F.col("prefix"), 1)
        .when(F.col("part") > F.col("prefix"), 0)
        .otherwise(2),
    )
    last = Window.partitionBy(*names).orderBy("h", "k", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    edge = decided.where("state = 2").withColumn("upto", F.col("taken") + F.sum("tokens").over(last))
    edge = edge.withColumn("state", (F.col("upto") <= F.col("rest")).cast("int"))
    columns = [F.col("k").alias(key), *names, F.col("tokens").alias("n_tokens"), (F.col("epochs") + F.col("state")).cast("long").alias("copies")]
    return decided.where("state < 2").select(*columns).unionByName(edge.select(*columns))


# Production parameters of the query and the pipeline.
PRODUCTION = MixTarget(weights={
    "domain": {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 2.0},
    "lang": {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.5},
})


def document_levels(docs: DataFrame) -> dict[str, Column]:
    """Domain, language and source of `documents`; a domain is every fourth source by its number."""
    number = F.regexp_extract(docs["source"], r"([0-9]{1,9})$", 1)
    return {
        "domain": F.concat(F.lit("d"), F.pmod(F.when(number != "", number).otherwise("0").cast("int"), F.lit(4))),
        "lang": docs["lang"],
        "source": docs["source"],
    }


def mix_documents(docs: DataFrame, target: MixTarget = PRODUCTION) -> DataFrame:
    return draw(docs, "doc_id", document_levels(docs), F.size(words_of(text_of(docs, "text"))), target)


def take_mix(docs: DataFrame, target: MixTarget = PRODUCTION) -> DataFrame:
    """`docs` as often as the mix takes them, in the same columns. Keys tell rows apart, and the text those without one:
    rows that repeat a key, or a text without a key, are all taken as often as it is drawn most."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text-"), F.sha2(text_of(docs, "text"), 256)))
    drawn = mix_documents(docs.withColumn("doc_id", own), target).where("copies > 0")
    # A row per copy before the join, so no column of the documents can clash with a count.
    copies = drawn.groupBy("doc_id").agg(F.max("copies").alias("copies")).select(
        F.col("doc_id").alias("_own_key"), F.explode(F.expr("sequence(1L, copies)")).alias("copy")
    ).select("_own_key")
    return docs.withColumn("_own_key", own).join(copies, "_own_key").select(*docs.columns)


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))
