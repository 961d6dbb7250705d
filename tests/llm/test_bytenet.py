"""The byte network against loops in plain Python, numeric gradients and held-out labels."""

import dataclasses
import math
import zlib

import numpy as np
import pytest

from scenelake.llm import bytenet as b
from scenelake.llm.common import table

SMALL = b.QualityNet(chunk=12, width=3, size=2, filters=4, hidden=3, rows=4)


def plain_score(w, text, net):
    data = list(text.encode("utf-8", "replace"))
    n = len(data)
    starts = [0] if n <= net.chunk else [*range(0, n - net.chunk, net.chunk - net.width + 1), n - net.chunk]
    seen = []
    for s in starts:
        codes = (data[s : s + net.chunk] + [b.PAD] * net.chunk)[: net.chunk]
        rows = [w["embed"][c] for c in codes]
        tops = []
        for f in range(net.filters):
            answers = [
                sum(float(rows[i + j][d]) * float(w["filters"][j * net.size + d, f]) for j in range(net.width) for d in range(net.size))
                for i in range(net.chunk - net.width + 1)
            ]
            tops.append(max(0.0, max(answers) + float(w["bias"][f])))
        tops.append(sum(c != b.PAD for c in codes) / net.chunk)
        seen.append([
            max(0.0, sum(t * float(w["hidden"][i, h]) for i, t in enumerate(tops)) + float(w["hidden_bias"][h]))
            for h in range(net.hidden)
        ])
    whole = [sum(c) / len(seen) for c in zip(*seen)] + [max(c) for c in zip(*seen)]
    return 1 / (1 + math.exp(-sum(x * float(o) for x, o in zip(whole, w["out"])) - float(w["out_bias"][0])))


def test_scores_equal_loops():
    texts = ["", "a", "short one", "exactly 12ch", "thirteen char", "ünïcode \U0001f642 " * 9, "x" * 200, "long " * 60]
    network = b.Network.fresh(SMALL)
    network.w["bias"] += 0.05
    expected = [plain_score(network.w, t, SMALL) for t in texts]
    assert network.scores(texts) == pytest.approx(expected, abs=1e-5)
    assert [network.score(t) for t in texts] == pytest.approx(expected, abs=1e-5)


def test_chunks_cover_every_window():
    for n in (0, 1, 12, 13, 22, 23, 24, 100, 101):
        starts = b.chunk_starts(n, SMALL).tolist()
        windows = {i for s in starts for i in range(s, s + SMALL.places)}
        assert set(range(max(0, n - SMALL.width + 1))) <= windows
        assert starts == sorted(set(starts)) and (n <= 12 or starts[-1] == n - 12)


def test_gradients_are_slopes():
    texts, marks = ["abcabcabc def", "zzzz zzzz zzzz zzzz zzzz", "q"], np.array([1, 0, 1], np.float32)
    network = b.Network({k: v.astype(np.float64) for k, v in b.Network.fresh(SMALL).w.items()}, SMALL)
    network.w["hidden_bias"] += 0.3
    # Twice the same chunk would make two largest answers, at which there is no slope.
    chunks = [b.cut(b.bytes_of(t), np.unique(b.chunk_starts(len(t), SMALL))[:1], SMALL) for t in texts]
    weight = np.array([0.5, 1.0, 0.25], np.float32)

    def loss():
        out = []
        for c in chunks:
            seen = network.seen(network.pooled(c.astype(np.int16))[0].astype(np.float64))
            p = b._sigmoid(np.concatenate([seen.mean(axis=0), seen.max(axis=0)]) @ network.w["out"] + network.w["out_bias"][0])
            out.append(p)
        p = np.array(out)
        return -(weight * (marks * np.log(p) + (1 - marks) * np.log(1 - p))).sum()

    # The window view steps by 4 bytes a number, so the answers themselves are in single precision.
    network.w["embed"] = network.w["embed"].astype(np.float32)
    g = network.gradients(np.concatenate(chunks), np.ones(3, int), marks, weight)
    rng = np.random.default_rng(0)
    for name in ("out", "out_bias", "hidden", "hidden_bias", "bias", "filters"):
        values = network.w[name]
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in values.shape)
            old, step = values[at], 1e-4
            values[at] = old + step
            up = loss()
            values[at] = old - step
            down = loss()
            values[at] = old
            assert g[name][at] == pytest.approx((up - down) / (2 * step), abs=2e-3), name


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    rows = b.op13_bytenet(spark, sf).collect()
    assert len(rows) == table(spark, sf, "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    found = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, poor = [p for y, p in found if y], [p for y, p in found if not y]
    assert sum(good) / len(good) > 0.985 and sum(poor) / len(poor) < 0.05


def test_edge_cases(spark, docs, no_docs):
    quick = dataclasses.replace(b.QualityNet(), epochs=2, per_label=3)
    labels = spark.createDataFrame([(5, 1), (6, 0), (9, 0), (10, 1), (None, 1), (3, None)], "doc_id long, quality int")
    model = b.fit_quality(docs, labels, net=quick)
    got = b.score_quality(docs, model, net=quick)
    assert got.columns == ["doc_id", "score", "predicted"] and got.count() == docs.count()
    rows = got.collect()
    assert all(0 <= r["score"] <= 1 for r in rows) and len({r["score"] for r in rows if r["doc_id"] in (0, 1)}) == 1
    # The same sample gives the same network, wherever its rows lie.
    assert b.fit_quality(docs.repartition(5), labels, net=quick) == model or b.score_quality(
        docs, b.fit_quality(docs.repartition(5), labels, net=quick), net=quick
    ).exceptAll(got).count() == 0
    assert b.score_quality(no_docs, model, net=quick).collect() == []
    one_sided = b.fit_quality(docs, labels.where("quality = 1"), net=quick)
    assert len({r["score"] for r in b.score_quality(docs, one_sided, net=quick).collect()}) == 1
    nothing = b.fit_quality(no_docs, labels.where("false"), net=quick)
    assert {r["score"] for r in b.score_quality(docs, nothing, net=quick).collect()} == {0.5}
