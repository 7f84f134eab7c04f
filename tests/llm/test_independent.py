"""Fingerprints, slot tables and odd tables against computations of their own."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import xxhash
from pyspark.sql import functions as F

from tests.llm.test_llm import EMPTY, frame, got, toxic_tables
from tilecairn.llm import bpe, fingerprint, packing, sharding, toxicity


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def chain(values):
    """The hash of longs in a row, each seeded by the one before."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(int(v).to_bytes(8, "little", signed=True), seed=h)
    return signed(h)


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return ""
    h = [signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in words]
    mask = (1 << 63) - 1
    runs = {chain(h[i : i + 5]) & mask for i in range(len(h) - 4)} if len(h) >= 5 else {chain(h) & mask}
    bins = {}
    for x in runs:
        b = x >> 56
        bins[b] = min(x, bins.get(b, x))
    out = []
    for i in range(128):
        if i in bins:
            out.append(bins[i] & 255)
        else:
            out.append(min(chain([i, b]) & ~255 | x & 255 for b, x in bins.items()) & 255)
    return bytes(out).hex()


def test_fingerprints_bin_by_bin(spark):
    r = random.Random(8)
    rows = [(i, " ".join(f"w{r.randrange(60)}é" for _ in range(n))) for i, n in enumerate((0, 1, 3, 5, 6, 9, 40, 300, 2000))] + [(50, None), (51, "a  b\tc\nd e f")]
    found = got(fingerprint.fingerprint_documents(frame(spark, rows)))
    text = {i: t or "" for i, t in rows}
    order = sorted(text, reverse=True)
    values = lambda s: np.frombuffer(bytes.fromhex(s), np.uint8)

    def like(a, b):
        a, b = values(a), values(b)
        if not len(a) or not len(b):
            return float(len(a) == len(b))
        return max(0.0, ((a == b).mean() - 1 / 256) / (1 - 1 / 256))

    for n, i in enumerate(order):
        t, after = text[i], text[order[(n + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        x = found[i]
        assert (x.fingerprint, x.edited_fingerprint) == (brute_fingerprint(t), brute_fingerprint(edited))
        assert abs(x.near_edited - like(brute_fingerprint(t), brute_fingerprint(edited))) < 1e-12 and abs(x.near_next - like(brute_fingerprint(t), brute_fingerprint(after))) < 1e-12


def test_slots_by_whole_orders_of_preference():
    for shards, size in ((["a", "b", "c"], 13), ([f"s{i}" for i in range(9)], 211), (["only"], 7)):
        orders = []
        for s in shards:
            d = hashlib.sha256(s.encode()).digest()
            offset, step = int.from_bytes(d[:8], "big") % size, int.from_bytes(d[8:16], "big") % (size - 1) + 1
            orders.append([(offset + k * step) % size for k in range(size)])
            assert sorted(orders[-1]) == list(range(size))
        table = [None] * size
        turn = 0
        while None in table:
            slot = next(s for s in orders[turn % len(shards)] if table[s] is None)
            table[slot] = turn % len(shards)
            turn += 1
        assert sharding.lookup_table(shards, size).tolist() == table


def test_null_keys_and_repeated_rows(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = [(None, "a b"), (None, None), (1, "a b"), (1, "a b")]
    out = bpe.encode_texts(frame(spark, rows, extra=True), path, public_tokenizers.PATTERN).collect()
    n = len(bpe.rank_encoding(path, public_tokenizers.PATTERN).encode_ordinary("a b"))
    assert sorted((str(x.doc_id), x.n_tokens) for x in out) == [("1", n), ("1", n), ("None", 0), ("None", n)]
    packed = packing.pack(frame(spark, rows, extra=True), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).collect()
    assert sorted(str(x.doc_id) for x in packed) == ["1", "1", "None", "None"] and sum(x.length for x in packed) == sum(x.doc_tokens for x in packed)


def test_toxicity_of_repeated_rows_and_clashing_columns(spark):
    docs, labels = toxic_tables(spark)
    more = docs.unionByName(docs.where("doc_id < 20")).withColumns({"score": F.lit("x"), "toxic": F.lit(9), "predicted": F.lit(0), "_key": F.lit(1)})
    out = toxicity.detect_toxic(more, labels).collect()
    seen: dict = {}
    for x in out:
        assert seen.setdefault(x.doc_id, x.score) == x.score
    assert len(out) == 625 and all(x.toxic == 9 and 0 <= x.score <= 1 for x in out)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as p

    frame(spark, EMPTY).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0
