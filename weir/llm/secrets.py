"""Secret scan: patterns, and character Markov models.

The base patterns find assignments, access keys and hexadecimal runs. Beyond them, every
long token is scored by the log-likelihood ratio of two character Markov models: one of
random strings, one of ordinary identifiers. Both are counted on labelled samples taken
from a bounded set of documents: random strings are what the base patterns found, and
digests of document ids written in several alphabets; ordinary identifiers are the other
words. A token outside the base spans whose ratio reaches a threshold becomes a span of
kind ``random``.

Positions are code points, ends exclusive. Null texts count as empty. Repeated rows give
repeated results; a null doc_id is kept. Extra columns are ignored. Without any labelled
sample all ratios are zero and nothing is added. A long text is one row; work and memory grow
with its length (positions and overlaps come from running sums and maxima by blocks).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..storage import written
from .common import bound, packed, whole_text

# Kinds in their order, patterns, the group that is measured, and its least length.
KINDS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),  # greedy runs of 16 and more are the runs that pass
}
RANDOM = "random"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ORDINARY = r"[A-Za-z0-9_-]{6,}"
#: Documents the models are counted on, in expectation.
SAMPLE = 4_000
#: Least ratio of a token, in thousandths of a nat, in total and for each of its steps.
LEAST, LEAST_STEP = 12_000, 600
#: Weight of the single characters' frequencies in a pair's.
WEIGHT = 10.0
MASK = "[SECRET]"

SPAN = "array<struct<start:int,kind:int,end:int>>"


def _empty() -> Column:
    return F.expr(f"CAST(array() AS {SPAN})")


def running(xs: Column, op, none, block: int = 256) -> Column:
    """Running ``op`` (associative, ``none`` as its neutral value) over an array, itself included. Blocks
    are scanned on their own and then moved by what precedes them, so no array grows step by step to
    the length of the text."""
    def scan(values: Column, start: Column) -> Column:
        """Each value's accumulation, after ``start``."""
        begin = F.struct(start.alias("at"), F.slice(values, 1, 0).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            at = op(acc["at"], x)
            return F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

        return F.aggregate(values, begin, step)["out"]

    def of_blocks(inner: Column) -> Column:
        ends = F.transform(inner, lambda b: F.element_at(b, -1))
        before = lambda e: F.concat(F.array(F.lit(none)), scan(e, F.lit(none)))
        return F.flatten(bound(before(ends), lambda at: F.transform(inner, lambda b, i: F.transform(b, lambda x: op(F.get(at, i), x)))))

    numbers = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int"))
    inner = F.transform(numbers, lambda k: scan(F.slice(xs, k * block + 1, block), F.lit(none)))
    return F.when(F.size(xs) == 0, xs).when(F.size(xs) <= block, scan(xs, F.lit(none))).otherwise(bound(inner, of_blocks))


def added_up(xs: Column) -> Column:
    return running(xs, lambda a, x: a + x, 0)


def largest(xs: Column) -> Column:
    return running(xs, lambda a, x: F.greatest(a, x), -(1 << 31))


def found(text: Column, kind: int, pattern: str, group: int, least: int, keep: bool = False) -> Column:
    """Spans of the matches whose ``group`` has at least ``least`` characters. Matches and the
    stretches between them alternate, so positions are running sums of their lengths. ``keep`` adds
    the matched text."""
    def placed(m: Column) -> Column:
        sizes = lambda gaps: F.transform(m, lambda x, i: F.length(F.get(gaps, i)) + F.length(x.m))

        def spans(ends: Column) -> Column:
            each = F.transform(m, lambda x, i: F.struct(
                (F.get(ends, i) - F.length(x.m)).alias("start"), F.lit(kind).alias("kind"), F.get(ends, i).alias("end"),
                *([x.m.alias("token")] if keep else [F.length(x.v).alias("v")])))
            if keep:
                return each
            return F.transform(F.filter(each, lambda x: x.v >= least), lambda x: F.struct(x.start.alias("start"), x.kind.alias("kind"), x.end.alias("end")))

        return bound(bound(bound(F.split(text, pattern, -1), sizes), added_up), spans)

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    both = F.zip_with(matches, values, lambda m, v: F.struct(m.alias("m"), v.alias("v")))
    none = F.expr("CAST(array() AS array<struct<start:int,kind:int,end:int,token:string>>)") if keep else _empty()
    return F.when(text.rlike(pattern), bound(both, placed)).otherwise(none)


def base_spans(text: Column) -> Column:
    kinds = [found(text, i, *rule) for i, rule in enumerate(KINDS.values())]
    return F.sort_array(F.concat(*kinds))


def base_values(text: Column) -> Column:
    """What the base patterns measure, of every match that passes."""
    each = [F.filter(F.regexp_extract_all(text, F.lit(p), F.lit(group)), lambda v, k=least: F.length(v) >= k) for p, group, least in KINDS.values()]
    return F.concat(*each)


def as_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, RANDOM)])
    one = lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))
    return F.concat_ws(",", F.transform(spans, one))


def steps(token: Column) -> Column:
    """Pairs of neighbouring characters."""
    pairs = lambda c: F.transform(F.slice(c, 1, F.size(c) - 1), lambda x, i: F.concat(x, F.get(c, i + 1)))
    return bound(F.split(token, ""), pairs)


def ratios(docs: DataFrame, n: int = SAMPLE) -> list[int]:
    """Log-likelihood ratio, in thousandths of a nat, of every pair of characters, counted on the
    documents with the smallest hashes of their ids, ``n`` of them in expectation."""
    part = min(1.0, n / max(1, docs.count()))
    drawn = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text")))  # rows without an id are drawn by their text
    chosen = docs.filter(F.pmod(drawn, F.lit(1 << 30)) < int(part * (1 << 30)))
    text = whole_text()
    some = written(chosen.select("doc_id", text.alias("text"), base_values(text).alias("base")), "sample")
    digest = F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 256)
    wide = F.base64(F.unhex(digest))
    made = F.array(F.substring(digest, 1, 40), wide, F.upper(F.regexp_replace(wide, "[+/=]", "")), F.regexp_replace(wide, "[+/=]", ""))
    random = some.select(F.explode(F.concat("base", made)).alias("token"), F.lit(1).alias("random"))
    words = F.filter(F.array_distinct(F.regexp_extract_all("text", F.lit(ORDINARY), F.lit(0))), lambda w: ~w.rlike("[0-9]"))

    def identifiers(ws: Column) -> Column:
        following = lambda i: F.coalesce(F.get(ws, i + 1), F.get(ws, F.lit(0)))
        forms = lambda w, n: F.array(w, F.concat_ws("_", w, n), F.concat(w, F.initcap(n)), F.upper(F.concat_ws("_", w, n)))
        return F.flatten(F.transform(ws, lambda w, i: forms(w, following(i))))

    ordinary = some.select(F.explode(bound(words, identifiers)).alias("token"), F.lit(0).alias("random"))
    tokens = random.unionByName(ordinary).filter(F.length("token") >= 2)
    pairs = tokens.select("random", F.explode(steps(F.col("token"))).alias("pair")).groupBy("random", "pair").count()
    size = len(ALPHABET)
    counts = [[0] * (size * size), [0] * (size * size)]
    for r in pairs.collect():  # at most two rows for each pair of the alphabet
        a, b = ALPHABET.find(r["pair"][0]), ALPHABET.find(r["pair"][1])
        if a >= 0 and b >= 0:
            counts[r["random"]][a * size + b] += r["count"]
    if not all(map(sum, counts)):
        return [0] * (size * size)

    def logs(c: list[int]) -> list[float]:
        """Each pair is smoothed by the frequency of its second character."""
        rows = [sum(c[a * size:(a + 1) * size]) for a in range(size)]
        single = [(sum(c[b::size]) + 0.5) / (sum(c) + 0.5 * size) for b in range(size)]
        return [math.log((c[a * size + b] + WEIGHT * single[b]) / (rows[a] + WEIGHT)) for a in range(size) for b in range(size)]

    ordinary_logs, random_logs = logs(counts[0]), logs(counts[1])
    return [round(1000 * (r - o)) for r, o in zip(random_logs, ordinary_logs)]


def ratio(token: Column, table: list[int]) -> Column:
    """The token's log-likelihood ratio under ``table``."""
    values = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")
    place = lambda c: F.call_function("locate", c, F.lit(ALPHABET)) - 1
    cell = lambda p: F.get(values, place(F.substring(p, 1, 1)) * len(ALPHABET) + place(F.substring(p, 2, 1)))
    return F.aggregate(steps(token), F.lit(0).cast("long"), lambda n, p: n + cell(p))


def scan(docs: DataFrame, n: int = SAMPLE) -> DataFrame:
    """The columns of ``docs``, ``base`` and ``spans`` (all of them), sorted by start and kind. One pass
    over the texts once the models are counted."""
    table = ratios(docs.select("doc_id", "text"), n)
    text, kind = whole_text(), len(KINDS)

    def added(base: Column) -> Column:
        """Tokens apart from all base spans, and likely random. All spans in the order of their starts: a
        token is apart if no base span before it reaches into it and the next one starts behind it."""
        tokens = found(text, kind, TOKEN, 0, 0, keep=True)
        both = F.sort_array(F.concat(F.transform(base, lambda b: F.struct(
            b.start.alias("start"), b.kind.alias("kind"), b.end.alias("end"), F.lit("").alias("token"))), tokens))

        def apart(all_: Column) -> Column:
            reached = largest(F.transform(all_, lambda s: F.when(s.kind < kind, s.end).otherwise(-1)))
            following = F.reverse(largest(F.transform(F.reverse(all_), lambda s: F.when(s.kind < kind, -s.start).otherwise(-(1 << 30)))))
            alone = lambda r, n: F.transform(all_, lambda s, i: F.when(
                (s.kind == kind) & (F.get(r, i) <= s.start) & (-F.get(n, i) >= s.end), s))
            return F.filter(bound(reached, lambda r: bound(following, lambda n: alone(r, n))), lambda s: s.isNotNull())

        def passes(s: Column) -> Column:
            return ratio(s.token, table) >= F.greatest(F.lit(LEAST), (s.end - s.start - 1) * LEAST_STEP)

        kept = F.filter(bound(both, apart), passes)
        return F.transform(kept, lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end")))

    more = lambda b: F.when(text.rlike(TOKEN), F.sort_array(F.concat(b, added(b)))).otherwise(b)
    both = bound(base_spans(text), lambda b: F.struct(b.alias("base"), more(b).alias("spans")))
    return docs.withColumn("_s", both).withColumns({"base": F.col("_s.base"), "spans": F.col("_s.spans")}).drop("_s")


def secrets(docs: DataFrame, n: int = SAMPLE) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, and all spans as text."""
    out = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), n)
    count = lambda i: F.size(F.filter("base", lambda s: s.kind == i)).cast("long")
    return out.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
                      F.sha2(as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))


BLOCK, BIG = 4096, 1 << 18


def blocks_of(text: Column) -> Column:
    """The text in blocks of ``BLOCK`` characters, so that a stretch is cut from its own blocks instead
    of being counted off from the beginning of the text."""
    cut = lambda t, size: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length(t) - 1, F.lit(0)) / size).cast("int")),
                                      lambda k: F.substr(t, k * size + 1, F.lit(size)))
    return F.flatten(F.transform(cut(text, BIG), lambda t: cut(t, BLOCK)))


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every stretch of spans replaced by a mark; overlapping spans become one mark."""
    def stretch(blocks: Column, start: Column, end: Column) -> Column:
        first, last = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
        return F.substr(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), start - first * BLOCK + 1, end - start)

    def whole(blocks: Column) -> Column:
        def pieces(reached: Column) -> Column:
            before = lambda i: F.when(i == 0, 0).otherwise(F.get(reached, i - 1))
            each = F.transform(spans, lambda s, i: F.when(s.start >= before(i), F.concat(stretch(blocks, before(i), s.start), F.lit(MASK))).otherwise(""))
            return F.concat(F.array_join(each, ""), stretch(blocks, F.element_at(reached, -1), F.length(text)))

        return bound(largest(F.transform(spans, lambda s: s.end)), pieces)

    return F.when(F.size(spans) == 0, text).otherwise(bound(blocks_of(text), whole))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets of its texts masked and n_chars counted anew where a text changed."""
    out = scan(packed(docs, "doc_id", "text"))
    hit = F.size("spans") > 0
    row = F.col("row").withField("text", F.col("_new"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(hit, F.length("_new").cast("long")).otherwise(F.col("row.n_chars")))
    changed = F.when(hit, masked(whole_text(), F.col("spans"))).otherwise(F.col("text"))
    return out.withColumn("_new", changed).select(row.alias("row")).select("row.*")
