"""Byte-level BPE over whole documents by overlapping chunks.

A text longer than one chunk is cut into overlapping chunks that are pre-tokenised in
parallel, each from its own start. A pre-token pattern without look-behind has no memory:
once two chunks share a boundary they agree from there on. Neighbours are therefore
stitched at their first common boundary; the stretch between two stitches is a piece, and
pieces are encoded pre-token by pre-token. Where an overlap holds no common boundary (one
pre-token longer than the overlap), the pattern runs on sequentially from the last certain
boundary, so the result is that of one pass in every case.

Null texts count as empty and have no tokens. Rows are independent: repeated rows give
repeated results and a null doc_id stays null. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import in_batches, whole_text

CHUNK = 32_768
OVERLAP = 1_024
#: Pre-tokens whose ids a worker remembers; the memory is emptied when full.
REMEMBERED = 400_000
RESULT = "doc_id long, n_tokens long, ids binary, decoded binary"


class _Ids(dict):
    """Pre-token to the bytes of its ids, filled on demand."""

    def __init__(self, merge):
        super().__init__()
        self.merge = merge

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.merge(piece.encode()), "<u4").tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder for one rank file and one pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        merges = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.ids = _Ids(merges._core_bpe.encode_single_piece)
        self.bytes_of = {i: b for b, i in ranks.items()}

    def boundaries(self, text: str) -> list[int]:
        return [m.end() for m in self.pattern.finditer(text)]

    def encode(self, text: str) -> bytes:
        ids = self.ids
        return b"".join([ids[p] for p in self.pattern.findall(text)])

    def encode_pieces(self, text: str, ends: Iterable[int]) -> bytes:
        ids, out, at = self.ids, [], 0
        for end in ends:
            out.append(ids[text[at:end]])
            at = end
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def cut(text: str, chunk: int, overlap: int) -> list[str]:
    """Chunks that start ``chunk`` apart and reach ``overlap`` into the next."""
    return [text[at:at + chunk + overlap] for at in range(0, max(1, len(text) - overlap), chunk)]


def stitch(chunks: list[str], ends: list[list[int]], chunk: int, c: Codec) -> tuple[str, list[int]]:
    """The text and its pre-token boundaries from the chunks and their own boundaries."""
    text = "".join(x[:chunk] for x in chunks[:-1]) + chunks[-1]
    known = list(ends[0]) if len(chunks) == 1 else list(ends[0][:-1])
    for k in range(1, len(chunks)):
        start = k * chunk
        own = [start] + [start + e for e in (ends[k] if k == len(chunks) - 1 else ends[k][:-1])]
        first = next(iter(sorted(set(own) & {x for x in known if x >= start})), None)
        if first is None:
            last = known[-1] if known else 0
            return text, known + [last + e for e in c.boundaries(text[last:])]
        known = [x for x in known if x <= first] + [x for x in own if x > first]
    return text, known


def encode_documents(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the bytes decoded from them."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    size = F.length("text")

    def result(doc_ids: list, ids: list[bytes]) -> dict:
        c = codec(path, pattern)
        return {"doc_id": doc_ids, "n_tokens": [len(x) // 4 for x in ids], "ids": ids, "decoded": [c.decode(x) for x in ids]}

    def encode(batch: pa.RecordBatch) -> dict:
        c = codec(path, pattern)
        return result(batch.column(0).to_pylist(), [c.encode(t) for t in batch.column(1).to_pylist()])

    def chunks(batch: pa.RecordBatch) -> dict:
        out: dict = {"doc_id": [], "key": [], "k": [], "part": []}
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            key = hashlib.blake2b(text.encode(), digest_size=16).digest()
            for k, part in enumerate(cut(text, chunk, overlap)):
                for name, value in (("doc_id", doc_id), ("key", key), ("k", k), ("part", part)):
                    out[name].append(value)
        return out

    def split(batch: pa.RecordBatch) -> dict:
        c = codec(path, pattern)
        parts = batch.column("part").to_pylist()
        return {n: batch.column(n) for n in ("doc_id", "key", "k", "part")} | {"ends": [c.boundaries(x) for x in parts]}

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k", kind="stable")
        copies = int((rows["k"] == 0).sum())  # rows that repeat both id and text
        own = rows.drop_duplicates("k")
        c = codec(path, pattern)
        text, ends = stitch(list(own["part"]), [list(e) for e in own["ends"]], chunk, c)
        doc_id = own["doc_id"].iloc[0]
        doc_id = None if pd.isna(doc_id) else int(doc_id)
        return pd.DataFrame(result([doc_id] * copies, [c.encode_pieces(text, ends)] * copies)).astype({"doc_id": "Int64"})

    short = in_batches(texts.filter(size <= chunk + overlap), RESULT, encode)
    cut_up = in_batches(texts.filter(size > chunk + overlap), "doc_id long, key binary, k int, part string", chunks)
    spread = in_batches(cut_up.repartition("key", "k"), "doc_id long, key binary, k int, part string, ends array<int>", split)
    return short.unionByName(spread.groupBy("doc_id", "key").applyInPandas(join, RESULT))


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
