"""The pipeline's stages, one by one, against what each is to do."""

import itertools
import re
import struct

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from scenelake.llm import bpe
from scenelake.llm.common import ARROW_BYTES, table
from scenelake.llm.ngram_join import keep_one, near_duplicates
from scenelake.llm.toxicity import reject_toxic

SF = "/root/testdata/sf0.001"


def five_word_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, at = docs.columns, [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        at.append(docs.collect())
        if name != "byte_bpe":
            assert docs.columns == columns
    source, clean, single, safe, mix, coded = at
    toxic = {r["doc_id"]: r["toxic"] for r in table(spark, SF, "labels").collect()}
    gone = {r["doc_id"] for r in source} - {r["doc_id"] for r in clean}
    assert sum(toxic.get(i, 1) == 0 for i in gone) <= 2
    sets = {r["doc_id"]: five_word_set(r["text"]) for r in clean}
    kept = {r["doc_id"] for r in single}
    links = [
        (a, b) for a, b in itertools.combinations(sorted(sets), 2)
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    # Of linked texts at most one stays, and what goes has been linked to a smaller doc_id, by steps.
    assert not any(a in kept and b in kept for a, b in links)
    assert {b for _, b in links} == set(sets) - kept
    assert [r["doc_id"] for r in sorted(safe)] == [r["doc_id"] for r in sorted(single)]
    assert not any(re.search(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}", r["text"] or "") for r in safe)
    assert {r["doc_id"] for r in mix} <= kept and {r["source"] for r in mix} == {r["source"] for r in safe}
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.RANKS))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in mix}
    assert sorted(r["doc_id"] for r in coded) == sorted(r["doc_id"] for r in mix)
    for r in coded:
        ids = struct.unpack(f"<{r['n_tokens']}I", bytes(r["ids"]))
        assert list(ids) == library.encode_ordinary(texts[r["doc_id"]]) and r["decodes"]


def test_python_gets_a_few_mb_at_a_time(spark):
    """Stages that hand whole texts to Python bound the bytes of a batch, not only its rows."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 500).alias("text")).coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["size"])

    def largest():
        return docs.mapInArrow(sizes, "size bigint").agg(F.max("size")).first()[0]

    before = spark.conf.get(limit)
    try:
        for use in (keep_one, lambda d: reject_toxic(d, b""), bpe.encode, near_duplicates):
            spark.conf.set(limit, str(64 << 20))
            use(docs)
            assert largest() <= 1.25 * ARROW_BYTES
        spark.conf.set(limit, str(1 << 20))
        bpe.encode(docs)
        assert largest() <= 1.25 * (1 << 20)
    finally:
        spark.conf.set(limit, before)
