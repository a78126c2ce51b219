"""The registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chaining, fim, licenses, mixing, quality_fm, quality_rules, secrets, simhash, suffix_dedup, topk, toxicity, whitening
from .common import table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(table(spark, sf, "embeddings"))


def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op3_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.shown(simhash.near_duplicates(table(spark, sf, "documents")))


def op4_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.dedup(table(spark, sf, "documents")))


def op5_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf, "documents"))


def op6_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.rates(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op7_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality_fm.quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op8_bpe(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path(RANKS)
    return bpe.digests(bpe.encode_documents(table(spark, sf, "documents"), ranks, public_tokenizers.PATTERN))


def op9_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.secrets(table(spark, sf, "documents"))


def op10_chaining(spark: SparkSession, sf: str) -> DataFrame:
    return chaining.passage_groups(table(spark, sf, "documents"))


def op11_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.licenses(table(spark, sf, "documents"))


def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whitened(table(spark, sf, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    return fim.digests(table(spark, sf, "documents"))


OP1_SQL = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
       FROM c q JOIN c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


# Bytes as two hexadecimal digits; a start is later if its string has started before, and starts at most
# 100 apart remove one run.
OP4_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 w AS (SELECT doc_id, p, substr(h, 2 * p - 1, 200) AS g FROM (SELECT doc_id, h, unnest(range(1, len(h) // 2 - 98)) AS p FROM t)),
 f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) > 1 AS later FROM w),
 i AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS first FROM f WHERE later),
 n AS (SELECT doc_id, p, sum(first) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM i),
 r AS (SELECT doc_id, run, min(p) AS a, max(p) + 99 AS z FROM n GROUP BY doc_id, run),
 k AS (SELECT doc_id, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) + 1 AS x, a - 1 AS y FROM r
       UNION ALL SELECT t.doc_id, coalesce(max(z), 0) + 1, max(len(h) // 2) FROM t LEFT JOIN r USING (doc_id) GROUP BY t.doc_id),
 s AS (SELECT k.doc_id, string_agg(substr(h, CAST(2 * x - 1 AS BIGINT), CAST(greatest(2 * (y - x + 1), 0) AS BIGINT)), '' ORDER BY x) AS kept
       FROM k JOIN t USING (doc_id) GROUP BY k.doc_id),
 c AS (SELECT doc_id, CAST(sum(z - a + 1) AS BIGINT) AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id)
SELECT t.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(kept)) AS kept_sha256 FROM t JOIN s USING (doc_id) LEFT JOIN c USING (doc_id)
"""

# Quantiles are exact here; the sketches are exact as well while a group has fewer texts than their size.
OP5_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
 w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
 g AS (SELECT id, i, array_to_string(words[i:i + 7], ' ') AS gram FROM (SELECT id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
 c AS (SELECT id, i, count(*) OVER (PARTITION BY id, gram) AS n FROM g),
 r AS (SELECT id, CAST(count(DISTINCT p) AS BIGINT) AS n_repeat_words FROM (SELECT id, unnest(range(i, i + 8)) AS p FROM c WHERE n > 1) GROUP BY id),
 b AS (SELECT w.id, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN r USING (id)),
 s AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         CAST(1000 * n_symbols // greatest(word_chars, 1) AS BIGINT) AS symbols, CAST(1000 * n_capitals // greatest(word_chars, 1) AS BIGINT) AS capitals,
         CAST(1000 * n_dup_lines // greatest(n_lines, 1) AS BIGINT) AS dup_lines, CAST(100 * word_chars // greatest(n_words, 1) AS BIGINT) AS word_length FROM b),
 l AS (UNPIVOT (SELECT id, lang, source, symbols, capitals, dup_lines, word_length FROM s WHERE NOT base_failed)
       ON symbols, capitals, dup_lines, word_length INTO NAME share VALUE x),
 q AS (SELECT lang, source, grouping(lang, source) AS level, share, count(*) AS n, list_sort(list(x)) AS xs FROM l
       GROUP BY GROUPING SETS ((lang, source, share), (lang, share), (share))),
 f AS (SELECT lang, source, level, share, n, xs[CAST(ceil(0.25 * n) AS BIGINT)] AS q1, xs[CAST(ceil(0.75 * n) AS BIGINT)] AS q3,
         CASE share WHEN 'symbols' THEN 5 WHEN 'capitals' THEN 20 ELSE 50 END AS least FROM q),
 e AS (SELECT lang, source, level, share, n, CASE WHEN share = 'word_length' THEN q1 - 8 * greatest(q3 - q1, least) ELSE 0 END AS low,
         q3 + 8 * greatest(q3 - q1, least) AS high FROM f),
 h AS (SELECT o.lang, o.source, o.share, CASE WHEN o.n >= 40 THEN o.low WHEN m.n >= 40 THEN m.low ELSE a.low END AS low,
         CASE WHEN o.n >= 40 THEN o.high WHEN m.n >= 40 THEN m.high ELSE a.high END AS high
       FROM e o JOIN e m ON m.level = 1 AND m.lang = o.lang AND m.share = o.share JOIN e a ON a.level = 3 AND a.share = o.share WHERE o.level = 0),
 v AS (SELECT l.id, bool_and(x BETWEEN low AND high) AS inside FROM l JOIN h USING (lang, source, share) GROUP BY l.id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(inside, FALSE) AS kept,
  symbols, capitals, dup_lines, word_length FROM s LEFT JOIN v USING (id)
"""

# Phrases at every word, and every block of every notice without any filter before the count.
_NOTICES = ", ".join(f"('{n.label}', {n.stride}, {n.need}, {n.words!r})" for n in licenses.notices_of())
OP11_SQL = rf"""
WITH w AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
 i AS (SELECT id, words, unnest(range(0, len(words))) AS p FROM w),
 p AS (SELECT id, p, 'mit' AS label FROM i WHERE words[p + 1] = 'mit' AND words[p + 2] = 'license'
   UNION ALL SELECT id, p, 'apache' FROM i WHERE words[p + 1] = 'apache' AND words[p + 2] = 'license'
   UNION ALL SELECT id, p, 'gpl' FROM i WHERE words[p + 1] = 'general' AND words[p + 2] = 'public' AND words[p + 3] = 'license'),
 b AS (SELECT id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels FROM p GROUP BY id),
 t(label, stride, need, toks) AS (VALUES {_NOTICES}),
 s AS (SELECT id, stride, words[k * stride + 1:(k + 2) * stride] AS block FROM
        (SELECT id, words, stride, unnest(range(0, CAST(ceil(len(words) / stride) AS BIGINT))) AS k FROM w, (SELECT DISTINCT stride FROM t))),
 c AS (SELECT id, label, len(list_intersect(toks, block)) AS common, need, len(toks) AS size FROM s JOIN t USING (stride)),
 m AS (SELECT id, label, max(common / size) AS containment FROM c WHERE common >= need GROUP BY id, label),
 l AS (SELECT id, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM (SELECT id, label FROM p UNION ALL SELECT id, label FROM m) GROUP BY id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN b USING (id) LEFT JOIN l USING (id) LEFT JOIN (SELECT id, max(containment) AS best FROM m GROUP BY id) USING (id)
"""

OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^
]*
|[^
]+') AS u,
             sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
 d AS (SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS y,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 100
           THEN 'plain' WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM t),
 c AS (SELECT *, array_to_string(u[1:least(x, y)], '') AS a, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS b, array_to_string(u[greatest(x, y) + 1:], '') AS z FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM c
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_topk, op2_toxicity, op3_simhash, op4_suffix_dedup, op5_quality_rules, op6_mixing, op7_quality,
                                    op8_bpe, op9_secrets, op10_chaining, op11_licenses, op12_whitening, op13_fill_in_middle)}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_topk": OP1_SQL, "op4_suffix_dedup": OP4_SQL, "op5_quality_rules": OP5_SQL, "op11_licenses": OP11_SQL,
            "op13_fill_in_middle": OP13_SQL}
