"""Exact removal of repeated byte strings with suffix arrays.

Every byte covered by a ``length``-byte string that also starts earlier (in a document with
a smaller id, or earlier in the same one) is removed.

* **Candidates.** A string's anchor is the smallest hash among its ``gram``-byte pieces.
  Equal strings have equal anchors, and neighbouring strings with the same anchor form one
  stretch of text. So only stretches whose anchor occurs again can hold repeats: in another
  stretch, or at two places of the same.
* **Shards.** Stretches are dealt by anchor, so equal strings meet. Each shard builds the
  suffix array of its distinct stretches by Larsson-Sadakane refinement (prefix doubling of
  the groups that are still unsorted), and the common prefixes of neighbours by Kasai's
  algorithm, many text positions at a time. Neighbours that share ``length`` bytes are
  one class; all but the earliest start of a class repeat.
* **Merging.** The stretches of a frequent anchor are dealt over several shards. Each of
  these reports the earliest start of its classes in sorted order; the runs are merged by
  binary search, and all but the earliest start of a class repeat.

Null texts are empty. Rows that repeat both doc_id and text count as one document and get
equal results; rows that share only the doc_id are ordered by a hash of the text; rows
without doc_id come last. Texts shorter than ``length`` bytes are never touched. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..storage import written
from .common import arrow_schema, in_batches, keyed

LENGTH = 100
GRAM = 16
#: Bytes hashed at a time.
BLOCK = 1 << 17  # small enough that the arrays of hashes stay in the cache
#: Stretches a shard holds about, and the most of one anchor that go to one shard.
SHARD = 16_384
#: Stretches per byte of text that winnowing yields on average: two per window of grams.
DENSITY = 2.0 / (LENGTH - GRAM + 2)

#: Anchors travel with 48 bits: at 10^12 of them under half a percent meet another by chance, and these only
#: send some stretches to a shard in vain.
SHORT = np.uint64(16)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_BYTES = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


# ---------------------------------------------------------------- stretches

def gram_hashes(text: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the ``gram`` bytes from every position, by doubling."""
    block, power, size, out, done = _BYTES[text], _BASE, 1, None, 0
    with np.errstate(over="ignore"):
        while size <= gram:
            if gram & size:
                if out is None:
                    out, done = block, size
                else:
                    n = min(len(out) - size, len(block))
                    out, done = block[:n] * _power(done) + out[size:size + n], done + size
            if 2 * size <= gram:
                block = block[:-size] * power + block[size:]
                power = power * power
            size *= 2
        out = out * _MIX
        return (out ^ (out >> np.uint64(31))) * _BASE


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def sliding_min(x: np.ndarray, window: int) -> np.ndarray:
    size = 1
    while 2 * size <= window:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    rest = window - size
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


def stretches_of(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, first start, number of starts and anchor of every stretch. The number is negative
    if the anchor is at several places of the stretch."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    sizes = np.array([len(t) for t in texts], np.int64)
    text = np.frombuffer(b"".join(texts), np.uint8)
    if len(text) < length:
        return none
    hashes = gram_hashes(text, gram)
    low32 = np.uint64((1 << 32) - 1)  # the last place of the smallest hash, judged by its upper half
    ranked = (hashes & ~low32) | (low32 - np.arange(len(hashes), dtype=np.uint64))
    place = (low32 - (sliding_min(ranked, length - gram + 1) & low32)).astype(np.int64)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)[:len(place)]
    start = np.flatnonzero(ends[doc] - np.arange(len(place)) >= length)
    if not len(start):
        return none
    anchor, moved = hashes[place[start]], np.diff(place[start]) != 0
    cut = (np.diff(start) != 1) | (anchor[1:] != anchor[:-1])
    first = np.concatenate([[0], np.flatnonzero(cut) + 1])
    count = np.diff(np.concatenate([first, [len(start)]]))
    several = np.add.reduceat(np.concatenate([[False], moved & ~cut]).astype(np.int64), first) > 0
    at = start[first]
    return doc[at], at - (ends - sizes)[doc[at]], np.where(several, -count, count), (anchor[first] >> SHORT).astype(np.int64)


def _blocks(texts: list[bytes]):
    """Runs of texts of about ``BLOCK`` bytes, with the place of their first."""
    run, size, first = [], 0, 0
    for i, t in enumerate(texts):
        run.append(t)
        size += len(t)
        if size >= BLOCK:
            yield first, run
            run, size, first = [], 0, i + 1
    if run:
        yield first, run


def packed_place(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """First start and signed number of starts in one number, which halves what the shuffles carry of them."""
    return (lo.astype(np.int64) << 32) | n.astype(np.int32).view(np.uint32).astype(np.int64)


def unpacked_place(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First start and number of starts without its sign."""
    return at >> 32, np.abs((at & 0xFFFFFFFF).astype(np.uint32).view(np.int32)).astype(np.int64)


# ---------------------------------------------------------------- suffix arrays

def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as a big-endian number; zeros follow the text."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    n = len(text)
    out = np.zeros(n, np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k:k + n]
    return out


def suffix_array(words: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes.

    Larsson-Sadakane: positions that agree on h bytes are a group, numbered by its first place;
    a group is refined by the group numbers h positions on, which doubles h. Groups of one are
    done and take no further part."""
    n = len(words)
    order = np.argsort(words)
    place = np.arange(n)
    new = np.concatenate([[True], words[order[1:]] != words[order[:-1]]]) if n else np.zeros(0, bool)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1  # beyond the text
    h = 8
    rank[order] = np.maximum.accumulate(np.where(new, place, 0)) if n else 0
    while h < n:
        single = new & np.concatenate([new[1:], [True]])
        keep = ~single
        if not keep.any():
            break
        place, sub = place[keep], order[place[keep]]
        key = rank[sub] * np.int64(n + 2) + rank[np.minimum(sub + h, n)] + 1
        by = np.argsort(key)
        sub, key = sub[by], key[by]
        order[place] = sub
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[sub] = place[np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))]
        h *= 2
    return order


def common_prefixes(words: np.ndarray, order: np.ndarray, most: int, lanes: int = 1 << 15) -> np.ndarray:
    """Common prefix, up to ``most`` bytes or a little over, of every entry of the suffix array with
    the one before. Kasai's walk in text order, where a prefix shrinks by one byte at most from a
    position to the next; ``lanes`` stretches of the text are walked side by side."""
    n = len(words)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    lanes = max(1, min(lanes, n // 48))  # long enough that the full comparison at a lane's start does not count
    step = -(-n // lanes)
    i = np.arange(lanes) * step
    end = np.minimum(i + step, n)
    size = np.zeros(lanes, np.int64)
    for _ in range(step):
        live = i < end
        if not live.all():
            i, end, size = i[live], end[live], size[live]
            if not len(i):
                break
        at = inverse[i]
        j = order[at - 1]  # of the first entry: any, it is reset below
        size = np.maximum(size - 1, 0)
        grow = np.flatnonzero(size < most)
        while len(grow):
            a, b = i[grow] + size[grow], j[grow] + size[grow]
            inside = (a < n) & (b < n)
            x = words[np.minimum(a, n - 1)] ^ words[np.minimum(b, n - 1)]
            # the highest differing bit, kept from rounding up by clearing the bits right below a set one
            same = (64 - np.frexp((x & ~(x >> np.uint64(1))).astype(float))[1]) >> 3
            size[grow] += np.where(inside, same, 0)
            grow = grow[inside & (same == 8) & (size[grow] < most)]
        size = np.minimum(size, n - np.maximum(i, j))
        size[at == 0] = 0
        lcp[at] = size
        i = i + 1
    return lcp


# ---------------------------------------------------------------- shards

def _runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flag.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def repeats(doc: np.ndarray, lo: np.ndarray, piece: list[bytes], length: int = LENGTH, report: bool = False):
    """Spans (doc, start, end) of the strings in the given stretches that start earlier in another
    of them; with ``report`` also the classes' earliest starts as (key, doc, start), in key order."""
    order = np.lexsort((lo, doc))
    doc, lo, piece = doc[order], lo[order], [piece[i] for i in order]
    first: dict[bytes, int] = {}
    owner = np.array([first.setdefault(p, i) for i, p in enumerate(piece)])
    again = (owner != np.arange(len(piece))) & ((doc != doc[owner]) | (lo != lo[owner]))
    size = np.array([len(p) for p in piece], np.int64)
    spans = [(doc[again], lo[again], lo[again] + size[again])]
    # distinct stretches, at their earliest places, in an order that puts no two neighbours of a
    # document side by side: common strings then end with the stretches
    own = np.array(sorted(first.values(), key=lambda i: (crc32(piece[i]), i)), np.int64)
    text = np.frombuffer(b"".join([piece[i] for i in own]), np.uint8)
    words = words_at(text)
    sa = suffix_array(words)
    lcp = common_prefixes(words, sa, length)
    which = np.repeat(np.arange(len(own)), size[own])
    offset = np.arange(len(text)) - (np.cumsum(size[own]) - size[own])[which]
    starts_here = offset <= size[own][which] - length
    names, code = np.unique(doc[own], return_inverse=True)
    when = (code[which].astype(np.int64) << 40) + lo[own][which] + offset
    when[~starts_here] = np.iinfo(np.int64).max
    begin = np.flatnonzero(np.concatenate([[True], lcp[1:] < length]))
    low = np.minimum.reduceat(when[sa], begin)
    least = np.empty(len(text), np.int64)
    least[sa] = np.repeat(low, np.diff(np.concatenate([begin, [len(text)]])))
    later = starts_here & (when > least)
    a, b = _runs(later)  # runs end before the next stretch: its last starts are not starts_here
    spans.append((doc[own][which[a]], lo[own][which[a]] + offset[a], lo[own][which[a]] + offset[b - 1] + length))
    found = tuple(np.concatenate(x) for x in zip(*spans))
    if not report:
        return found, None
    at = np.flatnonzero(starts_here & (when == least))
    raw = text.tobytes()
    keys = [hashlib.blake2b(raw[i:i + length], digest_size=16).digest() for i in at]
    by = sorted(range(len(at)), key=keys.__getitem__)
    return found, ([keys[i] for i in by], doc[own][which[at]][by], (lo[own][which[at]] + offset[at])[by])


def merged(runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the starts that another run knows earlier. A run is (keys in order, doc, start)."""
    keys = np.unique(np.concatenate([k for k, _, _ in runs]))
    docs = np.unique(np.concatenate([d for _, d, _ in runs]))
    least = np.full(len(keys), np.iinfo(np.int64).max)
    placed = []
    for k, d, s in runs:
        at = np.searchsorted(keys, k)
        when = (np.searchsorted(docs, d) << 40) + s
        np.minimum.at(least, at, when)
        placed.append((at, when))
    late = [when > least[at] for at, when in placed]
    doc = np.concatenate([d[x] for (_, d, _), x in zip(runs, late)])
    start = np.concatenate([s[x] for (_, _, s), x in zip(runs, late)])
    return doc, start, start + length


# ---------------------------------------------------------------- the job

def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """doc, spans (array of start, end) for every document of ``texts`` (doc, text) with repeats."""
    spark = texts.sparkSession
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, int(total * DENSITY / shard))

    def winnow(batch: pa.RecordBatch) -> dict:
        doc = batch.column("doc").to_numpy()
        raw = [t.encode() for t in batch.column("text").to_pylist()]
        parts = [(first, stretches_of(run, length, gram)) for first, run in _blocks(raw)]
        return {"anchor": np.concatenate([p[3] for _, p in parts]), "doc": np.concatenate([doc[p[0] + first] for first, p in parts]),
                "at": np.concatenate([packed_place(p[1], p[2]) for _, p in parts])}

    found = in_batches(texts.select("doc", "text"), "anchor long, doc long, at long", winnow)
    times = found.groupBy("anchor").agg(F.sum(F.when(F.shiftleft("at", 32) < 0, 2).otherwise(1)).alias("times")).filter("times > 1")
    shared = written(times, "shared-anchors")  # a table of its own, so that the join below can split a frequent anchor
    salt = F.pmod(F.xxhash64("doc", "anchor"), F.ceil(F.col("times") / shard))
    # shards of a part of a frequent anchor have negative numbers
    part = -1 - F.shiftrightunsigned(F.xxhash64("anchor", salt), 2)
    dealt = found.join(shared, "anchor").select(
        "doc", "at", F.when(F.col("times") <= shard, F.pmod("anchor", F.lit(shards))).otherwise(part).alias("shard"))
    lists = dealt.groupBy("doc").agg(F.collect_list(F.struct("at", "shard")).alias("at"))

    def cut(batch: pa.RecordBatch) -> dict:
        at = batch.column("at")
        items = at.flatten()
        field = lambda name: items.field(name).to_numpy(zero_copy_only=False)
        lo, n = unpacked_place(field("at"))
        sizes = np.diff(at.offsets.to_numpy())
        owner = np.repeat(np.arange(batch.num_rows), sizes)
        raw = [t.encode() for t in batch.column("text").to_pylist()]
        piece = [raw[o][a:a + k + length - 1] for o, a, k in zip(owner.tolist(), lo.tolist(), n.tolist())]
        return {"shard": field("shard"), "doc": batch.column("doc").to_numpy()[owner], "lo": lo.astype(np.int32), "piece": piece}

    pieces = in_batches(texts.join(lists, "doc").select("doc", "text", "at"), "shard long, doc long, lo int, piece binary", cut)
    span_type = arrow_schema(spark, "key binary, shard long, doc long, start int, end int")

    def in_shard(table: pa.Table) -> pa.Table:
        name = table.column("shard")[0].as_py()
        (doc, a, b), runs = repeats(table.column("doc").to_numpy(), table.column("lo").to_numpy().astype(np.int64),
                                    table.column("piece").to_pylist(), length, name < 0)
        keys, doc2, start2 = runs if runs else ([], np.zeros(0, np.int64), np.zeros(0, np.int64))
        return pa.Table.from_arrays([
            pa.array([None] * len(doc) + keys, span_type[0].type), pa.array([None] * len(doc) + [name] * len(keys), span_type[1].type),
            pa.array(np.concatenate([doc, doc2]), span_type[2].type), pa.array(np.concatenate([a, start2]).astype(np.int32), span_type[3].type),
            pa.array(np.concatenate([b, start2 + length]).astype(np.int32), span_type[4].type)], schema=span_type)

    out = pieces.groupBy("shard").applyInArrow(in_shard, "key binary, shard long, doc long, start int, end int")
    place = F.when(F.col("key").isNull(), F.pmod(F.xxhash64("doc"), F.lit(shards))).otherwise(F.pmod(F.xxhash64("key"), F.lit(shards)))
    done_type = arrow_schema(spark, "doc long, start int, end int")

    def merge(table: pa.Table) -> pa.Table:
        key, name = table.column("key").to_pylist(), np.array([x or 0 for x in table.column("shard").to_pylist()], np.int64)
        doc, start, end = (table.column(c).to_numpy() for c in ("doc", "start", "end"))
        open_rows = np.array([k is not None for k in key], bool)
        cols = [(doc[~open_rows], start[~open_rows], end[~open_rows])]
        if open_rows.any():
            keys = np.array([k for k in key if k is not None], dtype=object)
            name, doc, start = name[open_rows], doc[open_rows], start[open_rows].astype(np.int64)
            runs = []
            for s in np.unique(name):
                own = np.flatnonzero(name == s)
                own = own[np.argsort(keys[own], kind="stable")]
                runs.append((keys[own], doc[own], start[own]))
            cols.append(merged(runs, length))
        flat = [np.concatenate(x) for x in zip(*cols)]
        return pa.Table.from_arrays([pa.array(x.astype(t.type.to_pandas_dtype()), t.type) for x, t in zip(flat, done_type)], schema=done_type)

    spans = out.withColumn("place", place).groupBy("place").applyInArrow(merge, "doc long, start int, end int")
    return spans.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the remaining bytes of every row."""
    texts, ids = keyed(docs)
    # both joins with the texts deal out the same columns, so Spark does it once
    joined = texts.join(repeated_spans(texts, length, gram, shard), "doc", "left").select("doc", "text", "spans")

    def remove(batch: pa.RecordBatch) -> dict:
        out: dict = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            raw = text.encode()
            if spans:
                edge = np.zeros(len(raw) + 1, np.int32)
                np.add.at(edge, [s["start"] for s in spans], 1)
                np.add.at(edge, [s["end"] for s in spans], -1)
                gone = np.cumsum(edge[:-1]) > 0
                runs, n = len(_runs(gone)[0]), int(gone.sum())
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            else:
                runs, n, kept = 0, 0, raw
            for name, value in zip(out, (len(raw), n, runs, kept)):
                out[name].append(value)
        return {"doc": batch.column("doc")} | out

    done = in_batches(joined, "doc long, n_bytes long, n_removed long, n_spans long, kept binary", remove)
    named = done.withColumn("doc_id", F.col("doc")) if ids is None else done.join(ids, "doc")
    return named.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept")


def digests(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
