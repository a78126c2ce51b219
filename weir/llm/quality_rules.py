"""Quality rules with adaptive thresholds.

Base rules are fixed. On top, four shares of a text (symbols, capitals, repeated lines,
characters per word) are judged against thresholds learnt from the corpus itself: every
(lang, source) group gets a mergeable quantile sketch of each share, the sketches of small
groups give way to those merged over the language and then over everything, and a text is
rejected outside ``quartile +- spread * max(quartile distance, floor)``. Thresholds are
joined to the texts' shares; nothing is cut off at a fixed value.

Shares are integers (per mille, or hundredths), so thresholds are too. Sketches are exact
up to their size and have a rank error of about 1.3 / ``SKETCH`` beyond. Windows of eight
words are compared by 64-bit hashes within one text.

Null texts have no words and fail the base rules; so do empty ones. Null languages and
sources count as empty names. Repeated rows are judged alike (and count as often in the
sketches); a null doc_id is kept. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..storage import written
from .common import bound, join_small, packed, whole_text

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30  # percent of the words
SKETCH = 2048
#: Texts a group needs for thresholds of its own.
MIN_GROUP = 40
SPREAD = 8
#: Share: least distance of the quartiles that counts, and whether small values are rejected too.
SHARES = {"symbols": (5, False), "capitals": (20, False), "dup_lines": (50, False), "word_length": (50, True)}

SPACE = r"[\x20\x09-\x0D]+"


def _times(text: Column, pattern: str) -> Column:
    return (F.size(F.split(text, pattern, -1)) - 1).cast("long")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside a window of ``window`` words that occurs at least twice in the array."""
    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda i, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1), i + window) - i))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda n, x: n + x)

    def among(s: Column) -> Column:
        twice = F.filter(s, lambda e, j: (e.x == F.get(s, j - 1).x) | (e.x == F.get(s, j + 1).x))
        return bound(F.sort_array(F.transform(twice, lambda e: e.i)), covered)

    def of_hashes(h: Column) -> Column:
        found = bound(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), among)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(found)

    def of_words(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))
        return F.when(F.size(w) < window, F.lit(0).cast("long")).otherwise(bound(windows, of_hashes))

    return bound(F.transform(words, lambda x: F.xxhash64(x)), of_words)


def base(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base counts, base_failed and the shares."""
    t = whole_text(text)
    words = F.filter(F.split(t, SPACE, -1), lambda w: w != "")
    of_words = bound(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.aggregate(w, F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("word_chars"),
        repeated_words(w).alias("n_repeat_words")))
    of_lines = bound(F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    counted = docs.withColumns({"_w": of_words, "_l": of_lines, "_symbols": _times(t, r"[#*$%&|<>]"), "_capitals": _times(t, "[A-Z]")})
    n, chars, dup = F.col("_w.n_words"), F.col("_w.word_chars"), F.col("_l.n_dup_lines")
    share = lambda a, b, of: F.floor(a * of / F.greatest(b, F.lit(1))).cast("long")
    return counted.withColumn("rules", F.struct(
        n.alias("n_words"), chars.alias("word_chars"), F.col("_symbols").alias("n_symbols"), dup.alias("n_dup_lines"),
        F.col("_w.n_repeat_words").alias("n_repeat_words"),
        ((n < MIN_WORDS) | (100 * F.col("_w.n_repeat_words") > MAX_REPEATED * n)).alias("base_failed"),
        share(F.col("_symbols"), chars, 1000).alias("symbols"), share(F.col("_capitals"), chars, 1000).alias("capitals"),
        share(dup, F.col("_l.n_lines"), 1000).alias("dup_lines"), share(chars, n, 100).alias("word_length"),
    )).drop("_w", "_l", "_symbols", "_capitals")


def thresholds(judged: DataFrame, sketch: int = SKETCH, min_group: int = MIN_GROUP, spread: int = SPREAD) -> DataFrame:
    """_lang, _source, and low and high of each share, one row per group; a written table.
    ``judged`` has _lang, _source and the struct ``rules``."""
    good = judged.filter("NOT rules.base_failed")
    own = written(good.groupBy("_lang", "_source").agg(
        F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_bigint(F.col(f"rules.{s}"), sketch).alias(s) for s in SHARES]), "sketches")
    # no texts at all merge to a sketch without values, which has no quantiles
    merged = lambda keys: own.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_bigint(s).alias(s) for s in SHARES]).filter("n > 0")

    def fences(sketches: DataFrame, name: str) -> DataFrame:
        cols = []
        for s, (floor, both) in SHARES.items():
            q1, q3 = (F.kll_sketch_get_quantile_bigint(F.col(s), F.lit(q)) for q in (0.25, 0.75))
            wide = spread * F.greatest(q3 - q1, F.lit(floor).cast("long"))
            cols += [(q1 - wide if both else F.lit(0).cast("long")).alias(f"{s}_low"), (q3 + wide).alias(f"{s}_high")]
        keys = [c for c in ("_lang", "_source") if c in sketches.columns]
        return sketches.select(*keys, "n", F.struct(*cols).alias(name))

    by_lang, overall = fences(merged(["_lang"]), "l"), fences(merged([]), "o")
    all_three = (fences(own, "s").join(by_lang.withColumnRenamed("n", "ln"), "_lang")
                 .crossJoin(F.broadcast(overall.drop("n"))))  # one row
    chosen = F.when(F.col("n") >= min_group, F.col("s")).when(F.col("ln") >= min_group, F.col("l")).otherwise(F.col("o"))
    return written(all_three.select("_lang", "_source", chosen.alias("limits")), "thresholds")


def _named(docs: DataFrame) -> DataFrame:
    """``docs`` with the struct ``rules`` and the group's names, without the text."""
    name = lambda c: F.coalesce(F.col(c), F.lit(""))
    return base(docs).withColumns({"_lang": name("lang"), "_source": name("source")}).drop("text")


def _judged(counted: DataFrame, limits: DataFrame) -> DataFrame:
    joined = join_small(counted, limits, ["_lang", "_source"])
    inside = F.lit(True)
    for s in SHARES:
        inside = inside & F.col(f"rules.{s}").between(F.col(f"limits.{s}_low"), F.col(f"limits.{s}_high"))
    # one indivisible condition: a part pushed below the join would count the words once more
    kept = F.forall(F.array(~F.col("rules.base_failed"), F.coalesce(inside, F.lit(False))), lambda x: x)
    return joined.withColumn("kept", kept).drop("_lang", "_source", "limits")


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the shares."""
    counted = written(_named(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")), "counted")
    return _judged(counted, thresholds(counted)).select(
        "doc_id", "rules.n_words", "rules.word_chars", "rules.n_symbols", "rules.n_dup_lines", "rules.n_repeat_words",
        "rules.base_failed", "kept", *[f"rules.{s}" for s in SHARES])


def passing(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept. The counts are made twice, for the thresholds and for the
    verdicts, so that texts are neither written nor moved in between."""
    rows = packed(docs, "text", "lang", "source")
    counted = written(_named(rows.drop("row")), "counted")
    return _judged(_named(rows), thresholds(counted)).filter("kept").select("row.*")
