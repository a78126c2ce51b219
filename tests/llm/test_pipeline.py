"""All stages of the pipeline on an odd table, each against a plain version of what it does to its own input."""

import base64
import collections
import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from weir.llm import mixing, queries, secrets
from weir.storage import written

from test_small import brute_components, brute_fingerprint, documents, odd_texts


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmn") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    plain = [" ".join(rng.choice(words) for _ in range(rng.randint(25, 120))) for _ in range(120)]
    texts = odd_texts() + plain + plain[:5] + [plain[9] + " password = abcdef0123456789abcdef01", "#" * 60 + " $ " * 40, "again and again " * 40]
    docs = documents(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") != 40, F.col("doc_id")))
    docs = docs.unionByName(docs.filter("doc_id IN (25, 26)")).withColumn("lang", F.when(F.col("doc_id") % 7 != 0, F.col("lang")))
    root = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{root}/documents.parquet")
    labels = [(i, int(i % 9 != 0), int(i % 5 == 0)) for i in range(0, len(texts), 2)] + [(None, 1, 0), (3, None, None), (4, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("rate", F.lit("odd")).write.parquet(f"{root}/labels.parquet")
    return root


def rows(df):
    return collections.Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_stages(spark, tables):
    pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stages = dict(P.STAGES)
    assert list(stages) == ["quality_rules", "near_duplicates", "secrets", "mixing", "tokens"]
    kept = {}
    now = docs
    for name, stage in P.STAGES:
        kept[name] = (now, written(stage(spark, now, tables), name))
        now = kept[name][1]
        assert name == "tokens" or now.columns == docs.columns

    before, after = kept["quality_rules"]
    con = duckdb.connect()
    con.register("documents", before.select("doc_id", "text", "lang", "source").toPandas().astype({"doc_id": "Int64"}))
    verdict = con.execute(f"SELECT doc_id, sum(CAST(kept AS INT)) FROM ({queries.OP5_SQL}) GROUP BY doc_id").fetchall()
    got = collections.Counter(r["doc_id"] for r in after.select("doc_id").collect())
    assert got == collections.Counter({i: int(n) for i, n in verdict if n})

    before, after = kept["near_duplicates"]
    held = [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()]
    prints = [brute_fingerprint(t) for _, t in held]
    group = brute_components(len(held), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)
    want = collections.Counter()
    for root in set(group):  # rows that repeat an id are one document; rows without one stay
        ids = [held[k][0] for k in range(len(held)) if group[k] == root]
        low = min((i for i in ids if i is not None), default=None)
        want += collections.Counter(i for i in ids if i == low or i is None)
    assert collections.Counter(r["doc_id"] for r in after.select("doc_id").collect()) == want

    before, after = kept["secrets"]
    spans = {(r["doc_id"], r["text"]): r["spans"] for r in secrets.scan(before.select("doc_id", "text")).collect()}
    want = collections.Counter()
    for (i, text), n in rows(before).items():
        out, at = [], 0
        for s in sorted(spans[i, text], key=lambda s: (s["start"], s["kind"])):
            if s["start"] >= at:
                out.append(text[at:s["start"]] + secrets.MASK)
            at = max(at, s["end"])
        want[i, "".join(out) + text[at:]] += n
    assert rows(after) == want and any(secrets.MASK in t for _, t in want)

    before, after = kept["mixing"]
    rate = mixing.rates(before, spark.read.parquet(f"{tables}/labels.parquet"), P.TARGETS)
    of = {r["doc_id"]: r["rate"] for r in rate.collect()}
    n_before, n_after = rows(before), rows(after)
    assert set(n_after) <= set(n_before)
    for key, n in n_before.items():
        assert int(np.floor(of[key[0]])) * n <= n_after[key] <= (int(np.floor(of[key[0]])) + 1) * n

    before, after = kept["tokens"]
    import public_tokenizers
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(public_tokenizers.path(queries.RANKS), "rb"))}
    whole = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    want = collections.Counter()
    for (i, text), n in rows(before).items():
        ids = whole.encode_ordinary(text)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += n
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in after.collect()) == want


def test_run_and_an_empty_table(spark, tables, tmp_path):
    pytest.importorskip("public_tokenizers")
    assert P.run(spark, tables).count() > 0
    spark.read.parquet(f"{tables}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tables}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
