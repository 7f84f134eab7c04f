"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import json
import re
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tilecairn.llm.common import modest_batches

#: A place where a text can be cut without changing its matches: a match of the pattern holds white
#: space only at its start, so one that ends in these characters never goes on over white space.
SAFE_CUT = re.compile(r"(?<=[0-9A-Za-z.,;:!?])[ \n]")
CHUNK = 1 << 16


@lru_cache(maxsize=4)
def rank_encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file (lines of a base64 token and its rank), without special tokens."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves,
    the others for code points from 256 on, in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {chr(b): b for b in plain}
    return letters | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


class JsonEncoding:
    """A byte-level BPE file of the tokenizers library, encoded by tiktoken where that gives the same ids.

    tiktoken merges the pair whose result has the lowest rank, tokenizers the pair that comes first in
    the list of merges: the same if the results' ids rise along that list, which is checked. Added
    tokens are matched first in a text, as that library does, and get their own ids.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if merged != sorted(merged) or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} is not a byte-level BPE whose merges are in the order of their ids")
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in self.added}
        self.plain = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def encode(self, text: str) -> np.ndarray:
        if self.split is None or not any(x in text for x in self.added):
            return encode(self.plain, text)
        parts = [np.array([self.added[x]], np.uint32) if x in self.added else encode(self.plain, x) for x in self.split.split(text) if x]
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)


@lru_cache(maxsize=2)
def json_encoding(path: str, pattern: str) -> JsonEncoding:
    return JsonEncoding(path, pattern)


def safe_pieces(text: str, size: int = CHUNK) -> list[str]:
    """The text in pieces of about ``size`` characters whose encodings, joined, are that of the text."""
    pieces, start = [], 0
    while len(text) - start > size and (cut := SAFE_CUT.search(text, start + size)):
        pieces.append(text[start : cut.start()])
        start = cut.start()
    pieces.append(text[start:])
    return pieces


def encode(encoding: tiktoken.Encoding, text: str, size: int = CHUNK) -> np.ndarray:
    """Ids of a text, each match of the pattern encoded separately."""
    if len(text) <= size:
        return encoding.encode_to_numpy(text, disallowed_special=())
    return np.concatenate([encoding.encode_to_numpy(p, disallowed_special=()) for p in safe_pieces(text, size)])


def decode(encoding: tiktoken.Encoding, ids: np.ndarray) -> bytes:
    """The bytes of the ids, which need not be whole characters."""
    return encoding.decode_bytes(ids.tolist())


def _encode_batches(batches, path: str, pattern: str, keep: bool):
    encoding = rank_encoding(path, pattern)
    for batch in batches:
        n, ids_sha, decoded_sha, kept = [], [], [], []
        for text in batch.column(1).to_pylist():
            ids = encode(encoding, text or "").astype("<u4", copy=False)
            raw = ids.tobytes()
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(raw).hexdigest())
            decoded_sha.append(hashlib.sha256(decode(encoding, ids)).hexdigest())
            if keep:
                kept.append(raw)
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
        names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"]
        yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * keep, names + ["ids"] * keep)


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per row of docs: the key, n_tokens, ids_sha256, decoded_sha256, and with ``keep_ids`` also
    ids (little-endian unsigned 32-bit). The rank file must be at that path on every executor.

    A narrow job: no shuffle, one row in memory at a time beyond its Arrow batch. A null text is
    encoded as the empty one (no ids, the hash of no bytes); a null key stays null; repeated rows give
    repeated rows; further columns of docs are not read; an empty table gives an empty table.
    """
    modest_batches(docs.sparkSession)
    fields = [T.StructField("key", docs.schema[key].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * keep_ids)
    out = docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(partial(_encode_batches, path=ranks_path, pattern=pattern, keep=keep_ids), schema)
    return out.withColumnRenamed("key", key)
