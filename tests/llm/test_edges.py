"""Cases at the edges of the operators for training text: shared marks, largest and null keys, hot buckets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import EMPTY, brute_links, frame, got, near_copies
from tilecairn.llm import common, exact_dedup, fingerprint, jaccard_join, substring_dedup

LARGEST = (1 << 63) - 1


def test_blocks_of_one_mark_and_the_pad_keep_names_apart(spark):
    texts = ["pqr", "pqrb", "pq", "p", "", "pqrbb", "bpqr", "p q r", "rrr", "rrrr"]
    found = got(exact_dedup.dedup_exact(frame(spark, list(enumerate(texts))), block_bytes=1, mark_bits=1))
    want = {i: 7 if t in ("pqr", "p q r") else i for i, t in enumerate(texts)}
    assert {i: x.keep_id for i, x in found.items()} == want


def test_largest_and_null_keys(spark):
    t, other = (" ".join(f"{c}{i}" for i in range(20)) for c in "to")
    rows = [(5, t), (LARGEST, t), (None, t), (LARGEST - 1, other), (LARGEST, other + " x"), (None, "y " + other)]
    cut = substring_dedup.dedup_passages(frame(spark, rows)).collect()
    assert sorted((str(x.doc_id), x.n_removed) for x in cut) == sorted([("5", 0), (str(LARGEST), 20), ("None", 20), (str(LARGEST - 1), 0), (str(LARGEST), 20), ("None", 20)])
    kept = substring_dedup.without_passages(frame(spark, rows, extra=True)).collect()
    assert sorted((str(x.doc_id), x.text) for x in kept) == sorted([("5", t), (str(LARGEST), ""), ("None", ""), (str(LARGEST - 1), other), (str(LARGEST), "x"), ("None", "y")])
    linked = jaccard_join.link_documents(frame(spark, [(LARGEST, t), (None, t), (None, other), (None, other), (None, None), (LARGEST, "")]), marks=True).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.class_id), str(x.component_id), x.first) for x in linked) == sorted(
        [(str(LARGEST), 18, str(LARGEST), str(LARGEST), True), ("None", 18, str(LARGEST), str(LARGEST), False), *[("None", 18, "None", "None", True)] * 2, ("None", 0, "None", "None", True), (str(LARGEST), 0, str(LARGEST), str(LARGEST), True)]
    )


def test_keys_that_are_no_integers_are_refused(spark):
    docs = frame(spark, [(1, "a b c")]).withColumn("doc_id", F.lit("k"))
    for run in (jaccard_join.link_documents, substring_dedup.dedup_passages, substring_dedup.without_passages, fingerprint.fingerprint_documents):
        with pytest.raises(TypeError):
            run(docs)
    few = frame(spark, [(1, "a b c d"), (2, "a b c d")]).withColumn("doc_id", F.col("doc_id").cast("int"))
    assert sorted((x.doc_id, x.component_id) for x in jaccard_join.link_documents(few).collect()) == [(1, 1), (2, 1)]


def test_repeated_rows_in_many_partitions(spark):
    t = " ".join(f"a{i}" for i in range(30))
    rows = [(1, t + " z")] + [(2, t)] * 40 + [(3, "b " + t)]
    out = jaccard_join.link_documents(frame(spark, rows, 20)).collect()
    assert len(out) == 42 and {x.component_id for x in out} == {1}
    cut = substring_dedup.dedup_passages(frame(spark, rows, 20)).collect()
    assert sorted((x.doc_id, x.n_removed) for x in cut) == [(1, 0)] + [(2, 30)] * 40 + [(3, 30)]


def test_long_texts_link(spark):
    r = random.Random(3)
    base = [f"v{r.randrange(30_000)}" for _ in range(20_000)]
    edit = lambda k: [w if r.random() > k else "new" + w for w in base]
    rows = [(1, " ".join(base)), (2, " ".join(edit(0.005))), (3, " ".join(edit(0.2))), (4, " ".join(edit(0.005)[:18_900])), (5, "v1 v2")]
    assert {i: (x.n_shingles, x.component_id) for i, x in got(jaccard_join.link_documents(frame(spark, rows))).items()} == brute_links(rows)


def hot_bucket(spark, n, seed=1):
    """Random sets that share one key, a tenth of them with a near copy; each its own component but for a third in one."""
    r = random.Random(seed)
    tokens = [[r.randrange(1 << 62) for _ in range(40)] for _ in range(n)]
    for i in range(0, n, 10):
        tokens[i + 1] = tokens[i][:-1] + [r.randrange(1 << 62)]
    rows, like = [], jaccard_join.Similarity(90)
    for rep, t in enumerate(tokens):
        h = np.array(sorted(t), np.uint64)
        none = np.zeros(len(h), bool)
        band = like.band(len(h))
        found = [jaccard_join.segment_keys(h, none, k, *like.plan(k)) for k in (band, band - 1)]
        rows.append((rep, len(h), 0, h.astype(np.int64).tolist(), bytearray(np.packbits(none).tobytes()), bytearray(jaccard_join.sketch(h)), np.concatenate([x[0] for x in found]).tolist(), np.concatenate([x[1] for x in found]).tolist()))
    sets = spark.createDataFrame(rows, jaccard_join.SETS)
    shared = sets.select(F.lit(7).cast("long").alias("key"), "rep", F.lit(False).alias("partial"))
    component = spark.createDataFrame([(i, 0) for i in range(n) if i % 30 == 5], "node long, component long")
    return tokens, sets, shared, component


@pytest.mark.parametrize("direct", [8, 1000])
def test_hot_bucket_loses_no_pair(spark, monkeypatch, direct):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "DIRECT", direct)
    tokens, sets, shared, component = hot_bucket(spark, 200)
    found = {(x.a, x.b) for x in jaccard_join._open_pairs(shared, sets, component, 90, common.Scratch(spark)).collect()}
    assert found >= {(i, i + 1) for i in range(0, 200, 10)} and len(found) < 60


def test_rows_of_a_hot_bucket_grow_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "DIRECT", 32)
    placed, counts = jaccard_join._placed, []
    monkeypatch.setattr(jaccard_join, "_placed", lambda *a: (counts.append(placed(*a).count()), placed(*a))[1])
    rows = []
    for n in (500, 2000):
        _, sets, shared, component = hot_bucket(spark, n)
        jaccard_join._open_pairs(shared, sets, component, 90, common.Scratch(spark)).count()
        rows.append(sum(counts))
        counts.clear()
    assert rows[1] < 6 * rows[0] + 2000  # four times the members


def test_one_stray_does_not_open_a_bucket_for_all(spark):
    _, sets, shared, _ = hot_bucket(spark, 600)
    whole = shared.withColumn("component", F.when(F.col("rep") == 599, 599).otherwise(0).cast("long")).withColumns({"top": F.lit(0).cast("long"), "most": F.lit(599).cast("long"), "apart": F.lit(1).cast("long")})
    assert jaccard_join._placed(whole, sets).count() == 599 + 1 + 2


def test_scratch_folder_has_to_be_shared_on_a_cluster(monkeypatch):
    class Sc:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Sc()

    with pytest.raises(RuntimeError):
        common.scratch_root(Session())


def test_near_copies_by_five_words(spark):
    rows = near_copies(7, 60)
    out = got(jaccard_join.link_documents(frame(spark, rows), width=5, percent=80))
    assert {i: (x.n_shingles, x.component_id) for i, x in out.items()} == brute_links(rows, 5, 80)
    assert jaccard_join.link_documents(frame(spark, EMPTY), width=5, percent=80).count() == 0
