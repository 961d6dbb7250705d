"""Text analysis, query matching and cover-density rank as column expressions."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words of the text-search configuration.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she "
    "her hers herself it its itself they them their theirs themselves what which who whom this that "
    "these those am is are was were be been being have has had having do does did doing a an the and "
    "but if or because as until while of at by for with about against between into through during "
    "before after above below to from up down in out on off over under again further then once here "
    "there when where why how all any both each few more most other some such no nor not only own "
    "same so than too very s t can will just don should now"
).split()

# Characters with a meaning in the query syntax of the document index.
SPECIAL_CHARACTERS = '"()[]{}:^~*?\\/+-!&|'

_SEPARATORS = r"[^\p{L}\p{N}]+"
TERM_WEIGHT = 0.1


def normalise(text: Column) -> Column:
    """Lower-case words separated and surrounded by single spaces."""
    spaced = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    return F.regexp_replace(spaced, _SEPARATORS, " ")


def tokens(text: Column) -> Column:
    """Words in order; the array index is the position."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _SEPARATORS), "")


def without_stop_words(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


def words_of(text: str) -> list[str]:
    """Driver-side form of `tokens`, for query strings."""
    return re.findall(r"[^\W_]+", text.lower())


@dataclass(frozen=True)
class Clause:
    """Words and phrases that must occur, and those that must not."""

    words: tuple[str, ...] = ()
    phrases: tuple[tuple[str, ...], ...] = ()
    excluded: tuple[tuple[str, ...], ...] = ()

    @property
    def terms(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys([*self.words, *(w for p in self.phrases for w in p)]))


def parse_query(text: str) -> list[Clause]:
    """Alternatives separated by `or`; inside one, words, "phrases" and -exclusions."""
    found: list[Clause] = []
    words: list[str] = []
    phrases: list[tuple[str, ...]] = []
    excluded: list[tuple[str, ...]] = []

    def close() -> None:
        if words or phrases or excluded:
            found.append(Clause(tuple(words), tuple(phrases), tuple(excluded)))
        words.clear(), phrases.clear(), excluded.clear()

    for minus, quoted, bare in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text or ""):
        if bare.lower() == "or" and not minus:
            close()
            continue
        parts = words_of(quoted or bare)
        if len(parts) == 1 and parts[0] in STOP_WORDS:
            continue
        if parts and minus:
            excluded.append(tuple(parts))
        elif len(parts) > 1:
            phrases.append(tuple(parts))
        elif parts:
            words.append(parts[0])
    close()
    return found


def matches(normal: Column, clauses: list[Clause]) -> Column:
    """Whether normalised text satisfies the query; an empty query matches nothing."""

    def has(part: tuple[str, ...]) -> Column:
        return F.contains(normal, F.lit(" " + " ".join(part) + " "))

    def one(clause: Clause) -> Column:
        tests = [has((w,)) for w in clause.words] + [has(p) for p in clause.phrases]
        tests += [~has(p) for p in clause.excluded]
        return reduce(lambda a, b: a & b, tests)

    return reduce(lambda a, b: a | b, [one(c) for c in clauses]) if clauses else F.lit(False)


def cover_rank(words: Column, clauses: list[Clause]) -> Column:
    """Cover-density rank: over the shortest spans that satisfy the query, 0.1 / (1 + other words inside).

    One left-to-right pass keeps the last position of every query term. A span ends wherever the
    latest possible start moves forward, so each minimal span counts exactly once.
    """
    vocabulary = F.array(*[F.lit(t) for t in terms_of(clauses)]).cast("array<string>")
    hits = F.filter(
        F.transform(
            words,
            lambda w, i: F.struct((i + 1).alias("pos"), F.array_position(vocabulary, w).alias("term")),
        ),
        lambda h: h["term"] > 0,
    )
    return _cover_rank(hits, clauses)


def terms_of(clauses: list[Clause]) -> list[str]:
    """All terms that may count for a rank, sorted."""
    return sorted({t for c in clauses for t in c.terms})


def places_of(held: Column, term: str) -> Column:
    """Where a term stands, from a map of terms to places."""
    return F.coalesce(held[term], F.array().cast("array<int>"))


def matches_at(held: Column, clauses: list[Clause]) -> Column:
    """`matches` from a map of terms to the places where they stand, instead of from the text."""

    def starts(term: str, back: int) -> Column:
        return F.transform(places_of(held, term), lambda p: p - F.lit(back))

    def has(part: tuple[str, ...]) -> Column:
        return F.size(reduce(F.array_intersect, [starts(w, i) for i, w in enumerate(part)])) > 0

    def one(clause: Clause) -> Column:
        tests = [has(p) for p in [*((w,) for w in clause.words), *clause.phrases]]
        return reduce(lambda a, b: a & b, tests + [~has(p) for p in clause.excluded])

    return reduce(lambda a, b: a | b, [one(c) for c in clauses]) if clauses else F.lit(False)


def cover_rank_at(held: Column, clauses: list[Clause]) -> Column:
    """`cover_rank` from a map of terms to the places where they stand."""

    def hits_of(term: str, number: int) -> Column:
        return F.transform(places_of(held, term), lambda p: F.struct(p.alias("pos"), F.lit(number).alias("term")))

    hits = [hits_of(t, i + 1) for i, t in enumerate(terms_of(clauses))]
    return _cover_rank(F.sort_array(F.concat(*hits)), clauses) if hits else F.lit(0.0)


def _cover_rank(hits: Column, clauses: list[Clause]) -> Column:
    """The rank from (pos, term) of every hit, in order; terms are numbered from 1."""
    positive = [c for c in clauses if c.terms]
    if not positive:
        return F.lit(0.0)
    terms = terms_of(positive)
    number = {t: i for i, t in enumerate(terms)}

    def earliest(last: Column, clause: Clause) -> Column:
        places = [last[number[t]] for t in clause.terms]
        return F.least(*places) if len(places) > 1 else places[0]

    def step(state: Column, hit: Column) -> Column:
        at = (hit["term"] - 1).cast("int")
        last = F.transform(state["last"], lambda v, i: F.when(i == at, hit["pos"]).otherwise(v))
        order = F.transform(
            state["order"], lambda v, i: F.when(i == at, state["seen"] + 1).otherwise(v)
        )
        starts = [earliest(last, c) for c in positive]
        start = F.greatest(*starts) if len(starts) > 1 else starts[0]
        inside = state["seen"] + 1 - F.element_at(
            order, F.greatest(F.array_position(last, start), F.lit(1)).cast("int")
        )
        gain = TERM_WEIGHT / (F.lit(1) + (hit["pos"] - start) - inside)
        fresh = start > state["start"]
        return F.struct(
            last.alias("last"),
            order.alias("order"),
            (state["seen"] + 1).alias("seen"),
            F.when(fresh, start).otherwise(state["start"]).alias("start"),
            (state["rank"] + F.when(fresh, gain).otherwise(F.lit(0.0))).alias("rank"),
        )

    empty = F.array(*[F.lit(0)] * len(terms))
    start = F.struct(
        empty.alias("last"), empty.alias("order"), F.lit(0).alias("seen"), F.lit(0).alias("start"),
        F.lit(0.0).alias("rank"),
    )
    return F.aggregate(hits, start, step, lambda s: s["rank"])


def parse_tags(text: Column) -> Column:
    """Comma-separated tags, trimmed, without empties, first occurrence kept."""
    trimmed = F.transform(F.split(text, ","), lambda t: F.trim(t))
    return F.array_distinct(F.array_remove(trimmed, ""))


def clean_ocr(text: Column) -> Column:
    """Trimmed text; the answer "none" in any case means no text, and so does an empty reply."""
    trimmed = F.trim(text)
    return F.when((F.length(text) > 0) & (F.lower(trimmed) != "none"), trimmed)


def sanitise(text: Column) -> Column:
    spaced = F.translate(F.coalesce(text, F.lit("")), SPECIAL_CHARACTERS, " " * len(SPECIAL_CHARACTERS))
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def similarity_query(description: Column, tags: Column) -> Column:
    """Search text for "more like this": distinct words once, distinct lower-case tags twice."""
    clean = sanitise(description)
    words = F.array_distinct(F.array_remove(F.split(clean, " "), ""))
    lowered = F.array_distinct(
        F.array_remove(F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower), "")
    )
    text = F.array_join(F.concat(words, lowered, lowered), " ")
    return F.when(F.size(F.coalesce(tags, F.array().cast("array<string>"))) == 0, clean).otherwise(text)


def term_weights(query_text: str) -> dict[str, int]:
    """Analysed terms of a search text with their number of occurrences."""
    return dict(Counter(words_of(query_text)))
