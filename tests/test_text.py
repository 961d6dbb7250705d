import random

from pyspark.sql import functions as F

from scenelake.functions import frames, paths, text


def _ranks(spark, docs, query):
    clauses = text.parse_query(query)
    df = spark.createDataFrame(list(enumerate(docs)), "id int, txt string")
    rows = df.select("id", text.cover_rank(text.tokens(F.col("txt")), clauses).alias("r"),
                     text.matches(text.normalise(F.col("txt")), clauses).alias("m")).orderBy("id").collect()
    return [r["r"] for r in rows], [r["m"] for r in rows]


def _brute_rank(words, groups):
    """All minimal intervals holding every word of some group, scored one by one."""
    terms = {t for g in groups for t in g}
    full = []
    for i in range(len(words)):
        for j in range(i, len(words)):
            inside = set(words[i : j + 1])
            if any(set(g) <= inside for g in groups):
                full.append((i, j))
                break
    minimal = [s for s in full if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in full)]
    total = 0.0
    for i, j in minimal:
        held = sum(w in terms for w in words[i : j + 1])
        total += 0.1 / (1 + (j - i) - (held - 1))
    return total


def test_cover_rank_equals_brute_force(spark):
    rng = random.Random(7)
    docs = [" ".join(rng.choice("abcdxyz") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    for query, groups in (("b c", [["b", "c"]]), ("b", [["b"]]), ("b c x", [["b", "c", "x"]]),
                          ("b c or x y", [["b", "c"], ["x", "y"]]), ("b or c", [["b"], ["c"]])):
        ranks, _ = _ranks(spark, docs, query)
        for doc, rank in zip(docs, ranks):
            assert abs(rank - _brute_rank(doc.split(), groups)) < 1e-9


def test_close_words_rank_above_distant_ones(spark):
    ranks, found = _ranks(spark, ["man in blue shirt", "blue sky and far away a shirt", "blue only"], "blue shirt")
    assert found == [True, True, False]
    assert ranks[0] > ranks[1] > 0


def test_query_syntax():
    assert text.parse_query("") == [] and text.parse_query("the and") == []
    (clause,) = text.parse_query('The blue-shirt -"far away" -sky man')
    assert clause.words == ("man",)
    assert clause.phrases == (("blue", "shirt"),)
    assert clause.excluded == (("far", "away"), ("sky",))
    assert [c.words for c in text.parse_query("cat OR dog")] == [("cat",), ("dog",)]


def test_matching(spark):
    docs = ["A Blue shirt.", "shirt, blue", "no colour", None]
    assert _ranks(spark, docs, '"blue shirt"')[1] == [True, False, False, False]
    assert _ranks(spark, docs, "shirt -blue or colour")[1] == [False, False, True, False]


def test_similarity_query_doubles_tags(spark):
    row = spark.createDataFrame(
        [("red (balloon) red: sky", ["Sky", "sky", "Air"]), ("plain & simple!", None), ("", [])],
        "d string, t array<string>",
    ).select(text.similarity_query(F.col("d"), F.col("t")).alias("q")).collect()
    assert [r["q"] for r in row] == ["red balloon sky sky air sky air", "plain simple", ""]


def test_tags_and_ocr(spark):
    row = spark.range(1).select(
        text.parse_tags(F.lit(" a, b,,a , c ")).alias("t"), text.clean_ocr(F.lit(" None ")).alias("n"),
        text.clean_ocr(F.lit(" hi ")).alias("o"), text.clean_ocr(F.lit("")).alias("e"),
    ).first()
    assert row["t"] == ["a", "b", "c"] and row["n"] is None and row["o"] == "hi" and row["e"] is None


def test_common_subsequence_and_token_sets():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = row[:]
            for j, y in enumerate(b, 1):
                row[j] = prev[j - 1] + 1 if x == y else max(prev[j], row[j - 1])
        return row[-1]

    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 90))) for _ in range(2))
        assert frames.common_subsequence(a, b) == slow(a, b)
    assert frames.token_set_similarity("a b c", "c b a a") == 100.0
    assert frames.token_set_similarity("a b", "a b c d") == 100.0
    assert frames.token_set_similarity("", "a") == 0.0
    assert frames.token_set_similarity("fuzzy was a bear", "wuzzy had no hair") < 60


def test_sharpness(spark):
    import numpy as np

    flat = np.full((4, 5), 9, np.uint8)
    dot = np.zeros((5, 5), np.uint8)
    dot[2, 2] = 10
    df = spark.createDataFrame(
        [(1, flat.tobytes(), 5, 4), (2, dot.tobytes(), 5, 5)], "id int, grey binary, width int, height int"
    )
    got = {r["id"]: r["sharpness"] for r in frames.with_sharpness(df).collect()}
    assert got[1] == 0.0
    values = [10.0 if (i, j) in ((1, 2), (3, 2), (2, 1), (2, 3)) else -40.0 if (i, j) == (2, 2) else 0.0
              for i in range(5) for j in range(5)]
    assert abs(got[2] - np.var(values)) < 1e-9
    assert frames.laplacian_variance(dot, 3) != got[2]


def test_phash_distance(spark):
    a, b = "0" * 64, "f" * 8 + "0" * 55 + "3"
    assert spark.range(1).select(frames.phash_distance(F.lit(a), F.lit(b))).first()[0] == 34


def test_paths(spark):
    rows = spark.createDataFrame(
        [("a/B.JPG",), ("x/clip.MoV",), ("noext",), (".hidden",), ("a.tar.gz",)], "p string"
    )
    stem, ext = paths.stem_and_ext(paths.base_name(F.col("p")))
    got = rows.select(paths.suffix(F.col("p")), paths.asset_type(F.col("p")), stem, ext).collect()
    assert [tuple(r) for r in got] == [
        ("jpg", "image", "B", ".JPG"), ("mov", "video", "clip", ".MoV"), ("", "image", "noext", ""),
        ("hidden", "image", ".hidden", ""), ("gz", "image", "a.tar", ".gz"),
    ]
    times = spark.createDataFrame([(0.0,), (61.9,), (-3.0,), (None,)], "s double").select(paths.mm_ss(F.col("s")), paths.mm_ss(F.col("s"), False))
    assert [tuple(r) for r in times.collect()] == [("00:00", "0:00"), ("01:01", "1:01"), ("00:00", "0:00"), (None, None)]
    assert paths.parse_duration("5m") == 300.0
