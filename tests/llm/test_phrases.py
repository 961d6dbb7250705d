"""Collocations against plain counting, at a low threshold, and the parsing."""

import random
import re
from collections import Counter

import oracle

from scenelake.llm import phrases as ph
from scenelake.llm.queries import ORACLES


def small(text):
    return "".join(c.lower() if c < "\x80" else c for c in text or "")


def brute(rows, p):
    f = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", small(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, p.longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang or "und", tuple(words[i : i + m])] += 1
    n = Counter()
    for (lang, w), count in f.items():
        n[lang] += count * (len(w) == 1)
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= p.least}
    found = {}
    for (lang, w), a in candidates.items():
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        held = any(
            o == lang and len(v) > len(w) and b >= a and any(v[i : i + len(w)] == w for i in range(len(v)))
            for (o, v), b in candidates.items()
        )
        if not held:
            found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], n[lang]))
    return {
        (lang, i + 1, x[2].decode(), -x[1], x[3], x[4], x[5], -x[0])
        for lang, all_ in found.items() for i, x in enumerate(sorted(all_)[: p.top])
    }


def texts(seed):
    rng = random.Random(seed)
    common = ["The", "of", "über", "ñ", "a-b", "x y", "\U0001f642", "new", "york", "city"]
    rows = []
    for i in range(120):
        words = [rng.choice(common) if rng.random() < 0.7 else f"w{rng.randrange(200)}" for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.4:
            words[len(words) // 2 : len(words) // 2] = "in New  York\tCity hall today".split(" ")
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "; ", "!?"]) for w in words)
        rows.append((("en", "fr", None, "und")[i % 4], text))
    rows += [("en", None), ("en", ""), ("fr", " \t\n.,"), ("en", "the the the the the the the " * 300), ("solo", "a b")]
    rows += [("fr", "one long line without any stop goes on " * 50)] * 3 + [rows[7]] * 5
    return rows


def frame(spark, rows):
    # Names that are used inside must not clash.
    return spark.createDataFrame([(a, b, 1, "c", True, "k") for a, b in rows], "lang string, text string, n int, chunk string, followed boolean, k string").repartition(4)


def test_against_plain_counts(spark):
    for seed, p in ((1, ph.PhraseParameters(least=5, every=3, words=200)), (2, ph.PhraseParameters(least=3, every=1, top=7))):
        rows = texts(seed)
        got = ph.collocations(frame(spark, rows), p=p).collect()
        assert {tuple(r) for r in got} == brute(rows, p) and len(got) > 10


def test_each_occurrence_is_owned_once(spark):
    rows = texts(3)
    for every in (1, 2, 50):
        p = ph.PhraseParameters(least=1, every=every)
        dictionary = ph.parsed(frame(spark, rows).selectExpr("coalesce(lang, 'und') as lang", "coalesce(text, '') as text"), p)
        counts = Counter()
        for lang, chunk, followed, n in dictionary.collect():
            words = chunk.split(" ")
            for i in range(len(words) - (p.overlap if followed else 0)):
                for m in range(1, p.longest + 1):
                    if i + m <= len(words):
                        counts[lang, tuple(words[i : i + m])] += n
        plain = Counter()
        for lang, text in rows:
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", small(text)):
                words = re.findall(r"[^\x20\x09]+", piece)
                for m in range(1, p.longest + 1):
                    for i in range(len(words) - m + 1):
                        plain[lang or "und", tuple(words[i : i + m])] += 1
        assert counts == plain


def test_repeated_passages_share_chunks(spark):
    rng = random.Random(9)
    passage = " ".join(f"w{rng.randrange(5000)}" for _ in range(2000))
    other = [" ".join(f"v{rng.randrange(5000)}" for _ in range(rng.randrange(1, 40))) for _ in range(20)]
    rows = frame(spark, [("en", f"{x} {passage} {x}") for x in other]).select("lang", "text")
    dictionary = ph.parsed(rows, ph.PhraseParameters()).collect()
    held = sum(len(r["chunk"].split(" ")) for r in dictionary)
    assert max(r["n"] for r in dictionary) == 20 and held < 2 * 2000 + 20 * 300


def test_saturated_filter_changes_nothing(spark):
    rows = texts(4)
    p = ph.PhraseParameters(least=4, filter_bits=64)
    assert {tuple(r) for r in ph.collocations(frame(spark, rows), p=p).collect()} == brute(rows, p)


def test_no_rows(spark):
    assert ph.collocations(frame(spark, [("en", "a b")]).where("false")).collect() == []
    assert ph.collocations(frame(spark, [(None, None), ("en", "a b a b")])).collect() == []


def test_counts_past_64_bits(spark):
    phrases = spark.createDataFrame([("en", "a b", 3 * 10**12, 2), ("en", "a", 3 * 10**12, 1), ("en", "b", 4 * 10**12, 1)], "lang string, phrase string, f long, k int")
    totals = spark.createDataFrame([("en", 10**15)], "lang string, n long")
    row = ph.scored(phrases, totals, ph.PhraseParameters()).first()
    assert row["score"] == 1000 * 3 * 10**12 * 10**15 // (3 * 10**12 * 4 * 10**12)


def test_oracle_on_a_fixture(spark, tmp_path):
    rows = [r for seed in (5, 6, 7) for r in texts(seed)] * 4
    frame(spark, rows).select("lang", "text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = ph.op11_phrases(spark, str(tmp_path))
    con = oracle.duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert oracle.compare(got, con, ORACLES["op11_phrases"]) == []
