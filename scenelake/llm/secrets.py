"""Secret scans: patterns of known secrets, and windows of high entropy in candidate strings.

A candidate is a run of at least `window` characters of the base-64 alphabets that holds a digit. A window
slides over it; counts of its characters, and with them the sum of c * log2(c) that gives Shannon's entropy,
change by one character in and one out. Each character class (hexadecimal, capitals and digits, base 64) has
its own limit. Sums are whole numbers (units of 2^-20 bits), so no rounding depends on an engine or an order.
What the allow-list matches, and '=' between two parts, cut a candidate to tokens. A window lies within one token,
and one over the limit makes the whole token a span.

All of it are expressions over one row: no shuffle, and no row leaves the JVM.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.llm.common import let, table, text_of

# The patterns asked for. Of an assignment, group 2 is the secret.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
HEX_PLACES = [ALPHABET.index(c) + 1 for c in "0123456789abcdefABCDEF"]
LOWER_PLACES = [ALPHABET.index(c) + 1 for c in "abcdefghijklmnopqrstuvwxyz"]
UPPER_PLACES = [ALPHABET.index(c) + 1 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]
DIGIT_PLACES = [ALPHABET.index(c) + 1 for c in "0123456789"]
SCALE = 1 << 20

# Fixed value: parts of a path that look like words, behind what is allowed of it.
WORD_PARTS = r"(?:(?<=/)(?:[A-Za-z_-]{1,19}[0-9]{0,3}(?:/|$))*)?"

SPAN = "struct<start:int,kind:int,end:int>"


@dataclass(frozen=True)
class EntropyRules:
    """`window`: characters in a window. The limits are bits a character, the least for a secret.
    `mixed_bits`: of windows with capitals, small letters and digits; 0.3 % of random ones lie below.
    `allowed`: what one of these patterns matches in a candidate is no secret; what stands beside it is judged."""

    window: int = 20
    hex_bits: float = 2.9
    upper_bits: float = 3.3
    base64_bits: float = 3.9
    allowed: tuple[str, ...] = (
        r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
        r"(?i)example|placeholder|x{6}|0123456789|abcdefghij",
        r"^/?([A-Za-z_-]{2,}/){3}",
    )
    mixed_bits: float = 3.55

    def most(self, bits: float) -> int:
        """Largest sum of c * log2(c) of a window with at least so many bits a character."""
        return math.floor(self.window * (math.log2(self.window) - bits) * SCALE)

    @property
    def cuts(self) -> str:
        """Pattern of what stands between the tokens of a candidate."""
        whole_first = sorted(self.allowed, key=lambda a: not a.startswith("^"))
        return "|".join([*(f"(?:{a}){WORD_PARTS}" for a in whole_first), "=(?=[^=])"])

    @property
    def gains(self) -> list[int]:
        """What the sum gains when the count of a character goes from i to i + 1."""
        sums = [round(c * math.log2(c) * SCALE) if c else 0 for c in range(self.window + 1)]
        return [b - a for a, b in zip(sums, sums[1:])]


BLOCK = 256
CHARS = 1024
PACKED = 12


def _no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _running(values: Column, combine) -> Column:
    """Of whole numbers from 0 up, each combined with all before it.

    A fold copies what it has gathered at each step, so it gathers blocks of bounded size, each from where the ones
    before it have come to.
    """

    def gathered(block: Column, first: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return let(combine(acc["at"], x), lambda v: F.struct(v.alias("at"), F.concat(acc["all"], F.array(v)).alias("all")))

        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(block, start, step, lambda acc: acc["all"])

    def of_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), combine))
        firsts = F.concat(F.array(F.lit(0)), gathered(totals, F.lit(0)))
        return F.flatten(F.zip_with(blocks, F.slice(firsts, 1, F.size(blocks)), gathered))

    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(BLOCK)), lambda i: F.slice(values, i + 1, F.lit(BLOCK)))
    return let(cut, of_blocks)


def _places(text: Column, pattern: str, found: Column, kind: int) -> Column:
    """Spans of the matches `found`: what stands between them is the text split by the same pattern."""
    lengths = F.transform(found, lambda x: F.length(x))
    steps = F.zip_with(F.transform(F.split(text, pattern, -1), lambda x: F.length(x)), lengths, lambda gap, n: gap + n)
    # What stands behind the last match has none beside it.
    ends = let(F.slice(steps, 1, F.size(found)), lambda v: _running(v, lambda a, x: a + x))
    spans = F.zip_with(
        ends, lengths, lambda end, n: F.struct((end - n).alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
    )
    return F.when(F.size(found) == 0, _no_spans()).otherwise(spans)


def _is_high(token: Column, rules: EntropyRules) -> Column:
    """Whether one of the token's windows is of high entropy."""
    w = rules.window
    gains = F.array(*map(F.lit, rules.gains))
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    # Counts are packed: five bits hold up to 31, twelve of them a number, so a step rewrites six numbers.
    word = lambda p: F.floor((p - 1) / PACKED).cast("int")
    shift = lambda p: (p - 1) % PACKED * 5
    moves = let(codes, lambda c: F.zip_with(
        c,
        F.slice(F.concat(F.array_repeat(F.lit(0), w), c), 1, F.size(c)),
        lambda a, b: F.struct(
            a.alias("came"), b.alias("left"), word(a).alias("came_word"), shift(a).alias("came_shift"),
            word(b).alias("left_word"), F.greatest(shift(b), F.lit(0)).alias("left_shift"),
        ),
    ))
    one, nought = F.lit(1).cast("long"), F.lit(0).cast("long")
    start = F.struct(
        F.array_repeat(nought, -(-len(ALPHABET) // PACKED)).alias("counts"), nought.alias("sum"),
        F.lit(0).alias("hex"), F.lit(0).alias("upper"), F.lit(0).alias("lower"), F.lit(0).alias("digits"),
        F.lit(0).alias("end"), F.lit(False).alias("high"),
    )

    def change(x: Column, places: list[int]) -> Column:
        return x["came"].isin(places).cast("int") - x["left"].isin(places).cast("int")

    def step(acc: Column, x: Column) -> Column:
        counts = acc["counts"]

        def held(which: str) -> Column:
            number = F.call_function("shiftright", F.get(counts, x[f"{which}_word"]), x[f"{which}_shift"])
            return number.bitwiseAND(31).cast("int")

        def unit(which: str, i: Column) -> Column:
            return F.when(i == x[f"{which}_word"], F.call_function("shiftleft", one, x[f"{which}_shift"])).otherwise(nought)

        gained = F.get(gains, held("came"))
        lost = F.when(x["left"] > 0, F.get(gains, held("left") - 1)).otherwise(0)
        moved = F.struct(
            F.transform(counts, lambda c, i: c + unit("came", i) - unit("left", i)).alias("counts"),
            (acc["sum"] + F.when(x["came"] == x["left"], 0).otherwise(gained - lost)).alias("sum"),
            (acc["hex"] + change(x, HEX_PLACES)).alias("hex"),
            (acc["upper"] + change(x, UPPER_PLACES)).alias("upper"),
            (acc["lower"] + change(x, LOWER_PLACES)).alias("lower"),
            (acc["digits"] + change(x, DIGIT_PLACES)).alias("digits"),
            (acc["end"] + 1).alias("end"),
        )

        def judged(m: Column) -> Column:
            most = (
                F.when(m["hex"] == w, rules.most(rules.hex_bits))
                .when(m["upper"] == w, rules.most(rules.upper_bits))
                .when((m["lower"] > 0) & (m["upper"] > m["digits"]), rules.most(rules.mixed_bits))
                .otherwise(rules.most(rules.base64_bits))
            )
            high = (m["end"] >= w) & (m["digits"] > 0) & (m["digits"] < w) & (m["sum"] <= most)
            return F.struct(
                m["counts"].alias("counts"), m["sum"].alias("sum"), m["hex"].alias("hex"), m["upper"].alias("upper"),
                m["lower"].alias("lower"), m["digits"].alias("digits"), m["end"].alias("end"),
                (acc["high"] | high).alias("high"),
            )

        return F.when(acc["high"], acc).otherwise(let(moved, judged))

    return F.aggregate(moves, start, step, lambda acc: acc["high"])


def _entropy_spans(text: Column, rules: EntropyRules) -> Column:
    pattern = f"[{ALPHABET.replace('-', '')}-]{{{rules.window},}}"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def of_found(matches: Column) -> Column:
        def tokens(s: Column, at: Column) -> Column:
            allowed = F.regexp_extract_all(s, F.lit(rules.cuts), F.lit(0))
            begins = F.concat(
                F.array(F.lit(0)),
                F.transform(_places(s, rules.cuts, allowed, KINDS.index("entropy")), lambda p: p["end"]),
            )
            return F.zip_with(
                F.split(s, rules.cuts, -1), begins, lambda x, b: F.struct(x.alias("s"), (at + b).alias("at"))
            )

        def wanted(s: Column) -> Column:
            return (F.length(s) >= rules.window) & s.rlike("[0-9]")

        placed = F.zip_with(
            matches, _places(text, pattern, matches, KINDS.index("entropy")),
            lambda s, p: F.struct(s.alias("s"), p["start"].alias("at")),
        )
        parts = F.flatten(F.transform(F.filter(placed, lambda x: wanted(x["s"])), lambda x: tokens(x["s"], x["at"])))
        inner = F.transform(
            F.filter(parts, lambda x: wanted(x["s"]) & _is_high(x["s"], rules)),
            lambda x: F.struct(
                x["at"].alias("start"), F.lit(KINDS.index("entropy")).alias("kind"),
                (x["at"] + F.length(x["s"])).alias("end"),
            ),
        )
        return F.when(F.size(matches) == 0, _no_spans()).otherwise(inner)

    return let(found, of_found)


def find_secrets(docs: DataFrame, text: str = "text", rules: EntropyRules = EntropyRules()) -> DataFrame:
    """`docs` with `secrets`, its spans (start, kind as a place in KINDS, end; code points, end exclusive)
    sorted by start and kind.

    Null and empty texts have none; every row and column is kept as it is, whatever it is called (a column
    `secrets` is replaced).
    """
    whole = text_of(docs, text)

    def assigned(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(0))
        values = F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2))
        placed = let(found, lambda m: F.zip_with(
            _places(t, ASSIGN, m, 0), values,
            lambda p, v: F.when(F.length(v) >= 6, p),
        ))
        # A match needs one of these two characters; without them the slow pattern has nothing to find.
        return F.when(
            t.contains(":") | t.contains("="), F.filter(placed, lambda p: p.isNotNull())
        ).otherwise(_no_spans())

    def fixed(t: Column, pattern: str, kind: int) -> Column:
        return let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda m: _places(t, pattern, m, kind))

    spans = let(whole, lambda t: F.sort_array(F.concat(
        assigned(t), fixed(t, ACCESS, 1), fixed(t, HEX, 2), _entropy_spans(t, rules)
    )))
    return docs.withColumn("secrets", spans)


def spans_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda p: F.concat_ws(":", F.get(names, p["kind"]), p["start"], p["end"])), ","
    )


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", rules: EntropyRules = EntropyRules()) -> DataFrame:
    """`docs` with every secret of the text replaced by `mark`; overlapping spans by one. Texts without a
    secret, null among them, stay as they are."""
    found = find_secrets(docs, text, rules)

    def merged(spans: Column) -> Column:
        """One span for each run of spans that touch: it begins beyond all ends before it."""

        def of_reach(reach: Column) -> Column:
            n = F.size(spans)
            starts = F.filter(spans, lambda x, i: (i == 0) | (x["start"] > F.get(reach, i - 1)))
            ends = F.filter(reach, lambda end, i: (i == n - 1) | (F.get(spans, i + 1)["start"] > end))
            return F.zip_with(starts, ends, lambda x, end: F.struct(x["start"].alias("start"), end.alias("end")))

        return let(_running(F.transform(spans, lambda x: x["end"]), lambda a, x: F.greatest(a, x)), of_reach)

    def rest(t: Column, spans: Column) -> Column:
        begins = F.concat(F.array(F.lit(0)), F.transform(spans, lambda p: p["end"]))
        ends = F.concat(F.transform(spans, lambda p: p["start"]), F.array(F.length(t)))
        # A substring is looked for from the beginning of its text, so the text is cut to blocks first.
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor(F.length(t) / CHARS).cast("int")), lambda i: F.substring(t, i * CHARS + 1, F.lit(CHARS))
        )

        def between(cut: Column, a: Column, b: Column) -> Column:
            first = F.floor(a / CHARS).cast("int")
            held = F.array_join(F.slice(cut, first + 1, F.floor(b / CHARS).cast("int") - first + 1), "")
            return F.substring(held, a - first * CHARS + 1, b - a)

        return let(blocks, lambda cut: F.array_join(F.zip_with(begins, ends, lambda a, b: between(cut, a, b)), mark))

    column = F.col(text)
    clean = F.when(F.size("secrets") == 0, column).otherwise(
        let(merged(F.col("secrets")), lambda spans: rest(column, spans))
    )
    return found.withColumn(text, clean).drop("secrets")


def op3_secret_scans(spark, sf_dir: str) -> DataFrame:
    docs = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    count = lambda k: F.size(F.filter("secrets", lambda p: p["kind"] == k)).cast("long")
    base = F.filter("secrets", lambda p: p["kind"] < KINDS.index("entropy"))
    return docs.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("secrets")).alias("spans"),
    )
