"""Fill-in-the-middle transformation on piece tables.

A document is a list of descriptors (buffer, start, length) over two immutable buffers: its
own UTF-8 bytes and the three sentinels. Cutting splits descriptors, an arrangement permutes
prefix, middle and suffix and puts a sentinel before each, and the inverse permutation puts
them back. No byte is copied before a text is rendered, and digests run over the descriptors.

Cuts lie after whole lines; where, and in which form, follows from the digest of the seed and
the document's id, so every run gives the same. ``plain`` texts stay as they are: empty ones,
those that hold a sentinel already, and the share that ``rate`` leaves out.

Null texts count as empty. A null doc_id stands for an empty number in the digest and is
kept. Repeated rows give repeated results. Extra columns are ignored, an empty table gives no
rows. A text of any length is one row: its buffer, nine descriptors at most, and one rendered
copy are in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import in_batches, whole_text

# Sentinels of prefix, suffix and middle, and the parts in the order of each form.
MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
FORMS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
PLAIN = "plain"
SEED = 7
#: Percent of the documents that are transformed, and of those, percent in the form spm.
RATE, SPM = 100, 50

PARTS = ("prefix", "middle", "suffix")
SENTINELS = b"".join(MARKS.values())
TEXT, MARK = 0, 1
PIECES = "array<struct<buffer:int,start:long,length:long>>"


@dataclass(frozen=True)
class PieceTable:
    """Descriptors over ``buffers``; every operation gives a new list over the same buffers."""

    buffers: tuple[bytes, bytes]
    pieces: tuple[tuple[int, int, int], ...]

    @staticmethod
    def of(text: bytes) -> PieceTable:
        return PieceTable((text, SENTINELS), ((TEXT, 0, len(text)),))

    def __len__(self) -> int:
        return sum(n for _, _, n in self.pieces)

    def cut(self, *offsets: int) -> list[PieceTable]:
        """The stretches between rising ``offsets``; a descriptor with a cut inside is split."""
        out, rest = [], list(self.pieces)
        before = 0
        for at in offsets:
            room, taken = at - before, []
            while rest and room >= rest[0][2]:
                room -= rest[0][2]
                taken.append(rest.pop(0))
            if room:
                buffer, start, n = rest[0]
                taken.append((buffer, start, room))
                rest[0] = (buffer, start + room, n - room)
            out.append(PieceTable(self.buffers, tuple(taken)))
            before = at
        return [*out, PieceTable(self.buffers, tuple(rest))]

    @staticmethod
    def joined(tables: list[PieceTable]) -> PieceTable:
        pieces = [p for t in tables for p in t.pieces if p[2]]
        return PieceTable(tables[0].buffers, tuple(pieces))

    def stream(self) -> Iterator[memoryview]:
        views = [memoryview(b) for b in self.buffers]
        for buffer, start, n in self.pieces:
            yield views[buffer][start:start + n]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for view in self.stream():
            digest.update(view)
        return digest.hexdigest()

    def render(self) -> bytes:
        return b"".join(self.stream())

    def chars(self) -> int:
        """Code points: the bytes that do not continue one."""
        return sum(int(np.count_nonzero(np.frombuffer(v, np.uint8) & 0xC0 != 0x80)) for v in self.stream())


def line_ends(text: bytes) -> np.ndarray:
    """Offsets after each line; a last line without a line feed counts too."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return ends if not text or text.endswith(b"\n") else np.append(ends, len(text))


def draws(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]


def form_of(text: bytes, h: list[int], rate: int, spm: int) -> str:
    if not text or any(m in text for m in MARKS.values()) or h[2] % 100 >= rate:
        return PLAIN
    return "spm" if h[3] % 100 < spm else "psm"


def parts_of(text: bytes, h: list[int]) -> tuple[int, dict[str, PieceTable]]:
    """Number of lines, and the descriptors of the three parts."""
    ends = line_ends(text)
    n = len(ends)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    at = [0 if k == 0 else int(ends[k - 1]) for k in (low, high)]
    return n, dict(zip(PARTS, PieceTable.of(text).cut(*at)))


def arranged(parts: dict[str, PieceTable], form: str) -> PieceTable:
    out = []
    for name in FORMS[form]:
        at = SENTINELS.index(MARKS[name])
        out += [PieceTable(parts[name].buffers, ((MARK, at, len(MARKS[name])),)), parts[name]]
    return PieceTable.joined(out)


def restored(output: bytes, form: str) -> PieceTable:
    """The original text as descriptors over a rendered one: it is cut at its sentinels, and the
    parts go back to their order. No part holds a sentinel, nor can one arise across a seam,
    since no sentinel begins with another's end."""
    whole = PieceTable.of(output)
    if form == PLAIN:
        return whole
    cuts, at = [], 0
    for name in FORMS[form]:
        at = output.index(MARKS[name], at)
        cuts += [at, at + len(MARKS[name])]
        at = cuts[-1]
    stretches = dict(zip(FORMS[form], whole.cut(*cuts)[2::2]))
    return PieceTable.joined([stretches[name] for name in PARTS])


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, n (lines), form, prefix_chars and middle_chars (null if plain), ``pieces``, the
    transformed text as ``output``, and output_sha256."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().cast("binary").alias("text"))

    def one(doc_id: int | None, text: bytes) -> tuple:
        h = draws(doc_id, seed)
        form = form_of(text, h, rate, spm)
        n, parts = parts_of(text, h)
        table = PieceTable.of(text) if form == PLAIN else arranged(parts, form)
        chars = (None, None) if form == PLAIN else (parts["prefix"].chars(), parts["middle"].chars())
        pieces = [dict(buffer=b, start=s, length=k) for b, s, k in table.pieces if k]
        return doc_id, n, form, *chars, pieces, table.render(), table.sha256()

    names = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "pieces", "output", "output_sha256")
    schema = f"doc_id long, n long, form string, prefix_chars long, middle_chars long, pieces {PIECES}, output binary, output_sha256 string"

    def run(batch: pa.RecordBatch) -> dict:
        rows = [one(i, t) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        return dict(zip(names, map(list, zip(*rows))))

    return in_batches(texts, schema, run).withColumn("output", F.col("output").cast("string"))


def restore(transformed: DataFrame, texts: bool = True) -> DataFrame:
    """The rows of ``transformed`` (doc_id, form, output) with restored_sha256 and, if ``texts``, the
    original ``text``. Other columns than the texts are carried along."""
    carried = [c for c in transformed.columns if c not in ("output", "form", "pieces")]
    rows = transformed.select(F.struct(*carried).alias("carried"), "form", F.col("output").cast("binary").alias("output"))
    schema = f"carried {rows.schema['carried'].dataType.simpleString()}, form string, restored_sha256 string" + ", text binary" * texts

    def run(batch: pa.RecordBatch) -> dict:
        tables = [restored(o, f) for f, o in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        out = {"carried": batch.column(0), "form": batch.column(1), "restored_sha256": [t.sha256() for t in tables]}
        return out | ({"text": [t.render() for t in tables]} if texts else {})

    out = in_batches(rows, schema, run)
    text = [F.col("text").cast("string").alias("text")] if texts else []
    return out.select("carried.*", "form", *text, "restored_sha256")


def digests(docs: DataFrame) -> DataFrame:
    out = restore(transform(docs), texts=False)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
