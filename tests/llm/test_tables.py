"""Operators on whole tables against brute force."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from scenelake.llm import langid, mixing, ngram_join, urls, vectors, warc

SF = "/root/testdata/sf0.001"


# Mixing ---------------------------------------------------------------------------------------

TARGET = mixing.MixTarget(weights={"domain": {"a": 3.0}, "lang": {"x": 2.0}}, max_epochs=2, digits=1)


def shares(total, most, weight):
    """Water filling by bisection."""
    low, high = 0.0, 1e12
    for _ in range(200):
        rate = (low + high) / 2
        low, high = (rate, high) if sum(min(m, weight[c] * rate) for c, m in most.items()) < total else (low, rate)
    return {c: min(m, weight[c] * low) for c, m in most.items()}


def budgets(supply, target):
    def most(prefix):
        return sum(n for leaf, n in supply.items() if leaf[: len(prefix)] == prefix) * target.max_epochs

    given = {(): min(sum(supply.values()) * target.budget_percent / 100, most(()))}
    for depth, level in enumerate(mixing.LEVELS):
        for parent in [p for p in list(given) if len(p) == depth]:
            own = {leaf[: depth + 1] for leaf in supply if leaf[:depth] == parent}
            weight = {c: target.weights.get(level, {}).get(c[-1], 1.0) for c in own}
            given |= shares(given[parent], {c: most(c) for c in own}, weight)
    return {leaf: given[leaf] for leaf in supply}


@pytest.fixture(scope="module")
def mixed_rows():
    rng = random.Random(3)
    rows = [
        (i, rng.choice("ab"), rng.choice(["x", "y", None]), rng.choice("pq"), rng.randint(0, 50)) for i in range(300)
    ]
    # One small leaf that can't give its share, one hot leaf, a repeated key.
    return rows + [(1000, "a", "z", "p", 3)] + [(2000 + i, "b", "y", "q", 9) for i in range(200)] + [rows[7]]


def test_mixing_equals_brute_force(spark, mixed_rows):
    df = spark.createDataFrame(mixed_rows, "doc_id long, d string, l string, s string, tokens int")
    levels = {"domain": F.col("d"), "lang": F.col("l"), "source": F.col("s")}
    got = mixing.draw(df, "doc_id", levels, F.col("tokens"), TARGET).collect()
    assert len(got) == len(mixed_rows)
    leaves = collections.defaultdict(list)
    for i, d, la, s, n in mixed_rows:
        leaves[d, la or "unknown", s].append((i, n))
    supply = {leaf: sum(n for _, n in rows) for leaf, rows in leaves.items() if sum(n for _, n in rows)}
    want = collections.Counter()
    for leaf, share in budgets(supply, TARGET).items():
        budget = int(share + 1e-3)
        epochs, rest = divmod(budget, supply[leaf])
        order = sorted(leaves[leaf], key=lambda r: (hashlib.md5(f"17:{epochs}:{r[0]}".encode()).hexdigest(), r))
        upto = 0
        for i, n in order:
            upto += n
            want[i] += epochs + (upto <= rest)
    have = collections.Counter()
    for r in got:
        have[r["doc_id"]] += r["copies"]
    assert have == want


def test_shortage_goes_to_siblings_first(spark):
    rows = [(1, "a", "x", "p", 10), (2, "a", "y", "p", 1000), (3, "b", "x", "p", 1000)]
    sizes = spark.createDataFrame(rows, "i long, domain string, lang string, source string, tokens long")
    target = mixing.MixTarget(max_epochs=1, budget_percent=50)
    got = {(r["domain"], r["lang"]): r["budget"] for r in mixing.leaf_budgets(sizes, target).collect()}
    # Both domains get 502; of a's, x can give 10 only, and y takes the rest, not b.
    assert got == {("a", "x"): 10, ("a", "y"): 492, ("b", "x"): 502}


def test_mixing_edges(docs, no_docs):
    got = mixing.mix_documents(docs)
    assert got.count() == docs.count() and got.where("copies is null or copies < 0").isEmpty()
    assert mixing.mix_documents(no_docs).count() == 0 and mixing.take_mix(no_docs).count() == 0
    assert mixing.take_mix(docs).columns == docs.columns
    # Rows without a key are taken as often as the mix draws their text.
    everything = mixing.MixTarget(budget_percent=1000, max_epochs=3)
    taken = [r["text"] for r in mixing.take_mix(docs, everything).where("doc_id is null").collect()]
    assert sorted(taken, key=str) == [None] * 3 + ["no key here"] * 3


# URLs -----------------------------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://", "http://A.Example.ORG/es/x?y#z", "https://example.org/en/1", "x://org/",
    "http://notexample.org/es/1", "http://a.com/fr/1", "http://a.com/de?x", "http://com/de/", "http://a.net/#/fr/",
    "http://b.com?u=http://c.org/", "http://É.com/fr/", "http://a.org", "ftp://m.example.org/en/17.html",
]


def judged(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if c < "\x80" else c for c in found[1]) if found else ""
    path = found[2] if found else ""
    fits = [
        (len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[1], best and best[2]


def test_urls_equal_brute_force(spark):
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(URLS)], "page_id long, url string, host int")
    model = urls.UrlModel(steps=3)
    weights, bias = urls.train(urls.labelled_urls(pages, "url", model), model)
    for r in urls.judge_urls(pages, weights, bias, model=model).collect():
        host, path, rule, verdict = judged(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["score"] >= 0.5 else "allow"))
    nothing = pages.where("false")
    weights, bias = urls.train(urls.labelled_urls(nothing, "url", model), model)
    assert urls.judge_urls(nothing, weights, bias).count() == 0
    assert {r["verdict"] for r in urls.judge_urls(pages, weights, bias).where("rule is null").collect()} == {"allow"}


def test_regression_learns(spark):
    rows = [(f"http://h{i}.net/{'bad/casino' if i % 2 else 'good/news'}/{i}", i % 2) for i in range(200)]
    model = urls.UrlModel()
    weights, bias = urls.train(spark.createDataFrame(rows, "url string, label int"), model)
    asked = spark.createDataFrame([(1, "http://x.net/bad/casino/x"), (2, "http://y.net/good/news/y")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(asked, weights, bias, model=model).collect()}
    assert got == {1: "block", 2: "allow"}


# WARC -----------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a", "x"), (2, "http://b", "x"), (3, None, None), (-4, "http://b\nq", "é🙂\r\n\r\n"), (5, "u", "")]
    rows += [(10 + i, "http://hot", "copy") for i in range(50)] + [(90, "http://long", "long " * 100_000)] + [rows[0]]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, offset int")
    folder, settings = str(tmp_path / "w"), warc.WarcSettings(rows=20)
    index = warc.write_archives(pages.repartition(3), folder, settings=settings)
    largest = {}
    for key, _, html in rows:
        largest[html or ""] = max(key, largest.get(html or "", key))
    want = collections.Counter()
    for key, _, html in rows:
        data = html or ""
        sha1 = base64.b32encode(hashlib.sha1(data.encode()).digest()).decode()
        first = largest[data] == key
        want[key, sha1, "response" if first else "revisit", None if first else largest[data], data.encode() if first else None] += 1
    got = collections.Counter(
        (r["key"], r["digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"]))
        for r in warc.read_records(index, folder, settings).collect()
    )
    assert got == want
    some = warc.read_records(index.where("key in (2, -4, 90)"), folder, settings).collect()
    assert sorted(r["key"] for r in some) == [-4, 2, 90]


def test_warc_of_nothing(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    index = warc.write_archives(pages, str(tmp_path / "w"))
    assert index.count() == 0 and warc.read_records(index, str(tmp_path / "w")).count() == 0


# Vectors --------------------------------------------------------------------------------------


def best_of(rows, k):
    out = []
    good = [(i, v) for i, v in rows if i is not None and v is not None]
    for q, v in good:
        if q % 10 == 0:
            hits = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(hits[:k])]
    return sorted(out)


@pytest.mark.parametrize("rows_per_shard,block", [(16, 4), (10_000, 4096)])
def test_top_k_equals_brute_force(spark, rows_per_shard, block):
    rng = random.Random(1)
    rows = [(i, [rng.randint(-9, 9) for _ in range(5)]) for i in range(120)]
    rows += [(200 + i, [3, -3, 3, -3, 3]) for i in range(60)] + [(300, None), (310, [1, 2]), (311, [5, 5]), (None, [1, 2])]
    rows += [(320, [2**31, 0, 0, 0, 1])]
    df = spark.createDataFrame(rows, "id long, v array<bigint>")
    p = vectors.SearchParameters(k=7, shard_rows=rows_per_shard, leaf_rows=4, block_rows=block)
    got = vectors.top_k(df, df.where("id % 10 = 0"), p).collect()
    assert sorted(tuple(r) for r in got) == best_of(rows, 7)
    assert vectors.top_k(df.where("false"), df.where("false"), p).count() == 0


def test_top_k_of_large_and_repeated(spark):
    rows = [(100, [1e300, 2.0]), (1, [1e300, 1.0]), (2, [-1e300, 1.0]), (3, [0.5, 0.5]), (3, [0.25, 0.5]), (200, [1.0, 1.0]), (200, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").select("id", vectors.whole_numbers(F.col("v")).alias("v"))
    got = vectors.top_k(df, df.where("id % 100 = 0")).collect()
    of = lambda q: [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]
    assert of(100)[0] == (1, 2**63 - 1) and of(100)[-1] == (2, -(2**63)) and len(of(100)) == 6
    assert {i for i, _ in of(200)} == {100, 1, 2, 3} and all(s == sorted(s, reverse=True) for s in [[x for _, x in of(200)]])


def test_whole_numbers(spark):
    df = spark.createDataFrame(
        [([0.5, -0.0001],), ([float("nan"), 1.0],), ([None, 1.0],), (None,), ([float("inf"), 1.0],), ([],)], "v array<float>"
    )
    got = [r[0] for r in df.select(vectors.whole_numbers(F.col("v"))).collect()]
    assert got == [[512, -1], None, None, None, None, []]


# Language -------------------------------------------------------------------------------------


def test_language_evidence(spark):
    model = langid.LanguageModel(per_language=50)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    likelihood = langid.train_likelihood(langid.training_texts(docs, model), model)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = langid.identify(pages, likelihood, model=model).collect()
    declared = {r["page_id"]: langid.declared_language(r["html"]) for r in pages.collect()}
    assert len(got) == len(declared)
    assert sum(r["lang"] == declared[r["page_id"]] for r in got) >= 0.95 * len(got)
    odd = spark.createDataFrame(
        [(1, None, None, 1), (2, "http://a.de/", "", 1), (3, "x", "<html lang=fr><p>", 1), (3, "x", "<html lang=fr><p>", 1), (None, "", "<b>" * 9999, 1)],
        "page_id long, url string, html string, host int",
    )
    rows = langid.identify(odd, likelihood, model=model).collect()
    assert len(rows) == 5 and all(r["lang"] in model.languages for r in rows)
    assert {r["page_id"]: r["suffix_lang"] for r in rows}[2] == "de"
    assert langid.identify(odd.where("false"), likelihood, model=model).count() == 0


def fused(pages, likelihood, model):
    """The definition of `identify` in plain Python, over (url, html)."""
    names, n, facts = list(model.languages), len(model.languages), []
    for url, html in pages:
        found = re.search(r"://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
        host = found[1].lower() if found else ""
        grams = langid._grams(langid.visible_text(html), model.buckets)
        score = [sum(likelihood[g][i] for g in grams) / len(grams) * min(model.most_grams, len(grams)) for i in range(n)] if len(grams) else [0.0] * n
        evidence = [round(x - max(score), 6) for x in score]
        weights = [math.exp(x) for x in evidence]
        site, suffix = re.search(r"([^.]+\.[^.]+)$", host), langid.SUFFIXES.get(host.rpartition(".")[2], "none") if host else "none"
        said = langid.declared_language(html)
        facts.append((evidence, [w / sum(weights) for w in weights], host, site[1] if site else "", "none" if said is None else said if said in names else "other", suffix))

    def sums(key):
        out = collections.defaultdict(lambda: [0.0] * n)
        for f in facts:
            out[key(f)] = [a + b for a, b in zip(out[key(f)], f[1])]
        return out

    def chance(at):
        counts, values = sums(lambda f: f[at]), [*names, "none", "other"]
        whole = [sum(c[i] for c in counts.values()) for i in range(n)]
        return {v: [(counts[v][i] + model.smoothing) / (whole[i] + model.smoothing * len(values)) for i in range(n)] for v in values}

    whole = sums(lambda f: 0)[0]
    shares = [(x + 1) / (sum(whole) + n) for x in whole]
    tables, levels, out = (chance(4), chance(5)), (sums(lambda f: f[3]), sums(lambda f: f[2])), []
    for f in facts:
        prior = shares
        for level, at in zip(levels, (3, 2)):
            counts = [max(0.0, a - b) for a, b in zip(level[f[at]], f[1])]
            prior = [(c + model.strength * q) / (sum(counts) + model.strength) for c, q in zip(counts, prior)]
        logs = [f[0][i] + math.log(tables[0][f[4]][i]) + math.log(tables[1][f[5]][i]) + math.log(prior[i]) for i in range(n)]
        odds = [math.exp(x - max(logs)) for x in logs]
        out.append([x / sum(odds) for x in odds])
    return out


def test_language_equals_brute_force(spark):
    model = langid.LanguageModel(per_language=30)
    likelihood = langid.train_likelihood(langid.training_texts(spark.read.parquet(f"{SF}/documents.parquet"), model), model)
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").limit(120).collect()]
    rows += [(10_000, None, None), (10_001, "http://u@A.de:80/x", "<html lang=xx>der und die"), (10_002, "https://b.a.de", "<p>le la"), (10_003, "x", ""), (10_003, "x", "")]
    got = langid.identify(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), likelihood, model=model).collect()
    want = sorted((i, [round(x, 4) for x in p]) for (i, _, _), p in zip(rows, fused([r[1:] for r in rows], likelihood, model)))
    have = sorted((r["page_id"], list(r["posterior"])) for r in got)
    assert [i for i, _ in have] == [i for i, _ in want]
    assert all(abs(a - b) < 2e-4 for (_, x), (_, y) in zip(have, want) for a, b in zip(x, y))


def test_driver_gets_a_row_per_bucket(spark, monkeypatch):
    texts = spark.read.parquet(f"{SF}/documents.parquet").limit(400).select("lang", "text")
    sizes, collect = [], type(texts).collect

    def measured(df):
        rows = collect(df)
        sizes.append(sum(len(v) if isinstance(v, (bytes, bytearray)) else 8 for r in rows for v in r))
        return rows

    monkeypatch.setattr(type(texts), "collect", measured)
    few, many = (langid.train_likelihood(texts.repartition(n)) for n in (1, 12))
    assert (few == many).all() and sizes[0] == sizes[1] < 2_000_000


def test_language_without_its_declaration(spark):
    """What pages declare is taken out of them and kept as the truth."""
    docs, pages = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "pages"))
    likelihood = langid.train_likelihood(langid.training_texts(docs))
    said = {r["page_id"]: langid.declared_language(r["html"]) for r in pages.collect()}
    bare = pages.withColumn("html", F.regexp_replace("html", r"(?i)(<html\b[^>]*?)\slang\s*=\s*[\"']?[a-z-]+[\"']?", "$1"))
    got = [r for r in langid.identify(bare, likelihood).collect() if said[r["page_id"]] in langid.LANGUAGES]
    assert {r["declared_lang"] for r in got} == {None}
    assert len(got) >= 50 and sum(r["lang"] == said[r["page_id"]] for r in got) > 0.9 * len(got)


def test_hostile_pages_take_linear_time():
    begin = time.time()
    for html in ("<html " * 300_000, "<" * 2_000_000, "<html lang" * 200_000, "<!--" * 500_000, "<script " * 200_000):
        langid.visible_text(html)
        langid.declared_language(html)
    assert time.time() - begin < 20


def test_visible_text():
    html = "<html lang='EN-us'><script>var x='</p>'</script><!-- no --><p>a&amp;b<br>c</p><style>q"
    assert langid.visible_text(html).split() == ["a&b", "c"] and langid.declared_language(html) == "en"


# Near duplicates ------------------------------------------------------------------------------


def sets_of(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def grouped(rows, p):
    sets = {i: sets_of(t, p.words) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= p.percent * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("p", [
    ngram_join.JoinParameters(), ngram_join.JoinParameters(words=5, percent=80, block=3, parts=2, filter_bits=64),
])
def test_near_duplicates_equal_brute_force(spark, docs, p):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(50)] + ["Über", "É"]
    rows = []
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 9, 40, 150, 600]))]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                copy = copy[: int(len(copy) * rng.uniform(0.8, 1))]
            rows.append((1000 + len(rows), " ".join(copy).upper() if rng.random() < 0.2 else "\n".join(copy)))
    rows += [(i, t) for i, t in enumerate(["", None, " ", "one", "ONE", "two words"])]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), p=p).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == grouped(rows, p) and len(got) == len(rows)


def test_every_link_is_counted(spark, docs, no_docs):
    p = ngram_join.JoinParameters(block=3, block_grams=100, filter_bits=64)
    rng = random.Random(12)
    rows = []
    for n in (3, 90, 300, 600):
        base = [f"w{rng.randrange(50)}" for _ in range(n)]
        for _ in range(10):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + n // 200)):
                copy[rng.randrange(n)] = "other"
            rows.append((len(rows), " ".join(copy)))
    rows += [(100, ""), (101, None), (102, rows[0][1]), (103, rows[15][1].upper())]
    sets = {i: sets_of(t, p.words) for i, t in rows}
    links = {
        (a, b): len(sets[a] & sets[b]) for a, b in itertools.combinations(sets, 2)
        if sets[a] and 100 * len(sets[a] & sets[b]) >= p.percent * len(sets[a] | sets[b])
    }
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.near_duplicate_counts(df, p=p).collect()
    components = {i: c for i, (_, c) in grouped(rows, p).items()}
    assert len(got) == len(rows)
    for r in got:
        assert (r["component_id"], r["n_links"]) == (components[r["doc_id"]], sum(r["doc_id"] in x for x in links))
    pairs, members = ngram_join.near_duplicate_links(df, p=p)
    node = {r["doc_id"]: r["node"] for r in members.collect()}
    want = {(min(node[a], node[b]), max(node[a], node[b]), c) for (a, b), c in links.items() if node[a] != node[b]}
    found = [tuple(r) for r in pairs.collect()]
    assert set(found) == want and len(found) == len(want) > 20
    assert {r["n_links"] for r in ngram_join.near_duplicate_counts(docs).where("doc_id is null").collect()} == {None}
    assert ngram_join.near_duplicate_counts(no_docs).count() == 0


def test_near_duplicates_edges(docs, no_docs):
    got = ngram_join.near_duplicates(docs).collect()
    known = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    want = grouped(list(known.items()), ngram_join.JoinParameters())
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    kept = [r["doc_id"] for r in ngram_join.keep_one(docs).collect()]
    firsts = sorted(i for i, (_, c) in want.items() if i == c)
    assert sorted(i for i in kept if i is not None) == firsts and kept.count(None) == 2
    assert ngram_join.near_duplicates(no_docs).count() == 0


def near_copies(n, seed=3):
    """Sets of which neighbours link and few others do, so that one hub can't connect them."""
    rng = random.Random(seed)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(n):
        base = list(base)
        base[rng.randrange(120)] = f"v{i}"
        rows.append((i, " ".join(base)))
    return rows


def test_long_chains_in_small_blocks(spark):
    p = ngram_join.JoinParameters(words=1, percent=90, block=4, parts=2)
    rows = near_copies(60) + [(100 + i, t + " end") for i, t in near_copies(40, 8)]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), p=p).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == grouped(rows, p)


def test_edges_not_pairs(spark):
    """What comes out of the cells of one segment grows with its rows, not with their pairs."""
    p = ngram_join.JoinParameters(block=16)
    empty = spark.createDataFrame([], "node long, component long")
    made = {}
    for n in (64, 128):
        multi = spark.createDataFrame([(7, i) for i in range(n)], "key long, node long")
        nodes = spark.createDataFrame([(i, 50, b"\0" * 16) for i in range(n)], "node long, n long, bits binary")
        edges = ngram_join._may_connect(ngram_join._open_rows(multi, empty), nodes, p)
        found = edges.collect()
        made[n] = len(found)
        assert {r["component"] for r in ngram_join.components(edges).collect()} == {0}
    # Less than a row each, and one edge for each two blocks.
    assert made[64] < 64 + 8 * 7 / 2 and made[128] < 128 + 16 * 15 / 2


def test_one_key_for_several_texts(spark):
    words = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"x{i}" for i in range(60))
    third = " ".join(f"y{i}" for i in range(60))
    rows = [(1, words, "a"), (1, other, "b"), (1, third, "c"), (2, other + " end", "d"), (3, third, "e"), (1, words, "f"), (4, "", "g"), (4, None, "h"), (None, words, "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string").repartition(3)
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    texts = sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    assert texts == sorted([(1, words), (1, other), (1, third), (4, ""), (0, words)])
    got = ngram_join.near_duplicates(df, links=True).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["n_links"] or 0) for r in got) == sorted(
        [(1, 1, 0), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (1, 1, 0), (4, 4, 0), (4, 4, 0), (0, 0, 0)]
    )


def test_most_difference_is_tight():
    for percent in (80, 85):
        p = ngram_join.JoinParameters(percent=percent)
        for n in range(1, 90):
            best = max(
                (n + m - 2 * i for m in range(1, 200) for i in range(min(n, m) + 1) if 100 * i >= percent * (n + m - i)),
                default=-1,
            )
            assert p.most_difference(n) == best
