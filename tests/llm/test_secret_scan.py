"""Secret scan: running values, long texts, the ratio against a plain count, recall and false alarms of the added spans."""

import hashlib
import math
import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from weir.llm import secrets

from test_small import documents


def test_running_values(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [int(x) for x in rng.integers(-50, 50, n)]) for i, n in enumerate((0, 1, 2, 255, 256, 257, 512, 513, 3000))]
    df = spark.createDataFrame(rows, "i int, xs array<int>")
    for r in df.select("xs", secrets.added_up(F.col("xs")).alias("s"), secrets.largest(F.col("xs")).alias("m")).collect():
        assert r["s"] == np.cumsum(r["xs"]).tolist() and r["m"] == (np.maximum.accumulate(r["xs"]).tolist() if r["xs"] else [])


def brute_base(text):
    out = []
    for kind, (pattern, group, least) in enumerate(secrets.KINDS.values()):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return sorted(out)


def brute_spans(text, table):
    base = brute_base(text)
    size, out = len(secrets.ALPHABET), list(base)
    for m in re.finditer(secrets.TOKEN, text):
        a, b = m.span()
        if any(x < b and a < y for x, _, y in base):
            continue
        token = m.group()
        score = sum(table[secrets.ALPHABET.index(x) * size + secrets.ALPHABET.index(y)] for x, y in zip(token, token[1:]))
        if score >= max(secrets.LEAST, (b - a - 1) * secrets.LEAST_STEP):
            out.append((a, 3, b))
    return sorted(out)


def made(rng, k):
    """A random string of some alphabet, and an ordinary identifier."""
    alphabet = ("abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")[k % 2]
    words = ["get", "user", "account", "table", "index", "value", "handler", "manager", "connection", "response", "document", "service", "configuration"]
    name = "_".join(rng.choice(words) for _ in range(5))
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(28, 44))), name if k % 3 else "".join(w.title() for w in name.split("_"))


def corpus(spark, seed=3, n=300):
    rng = random.Random(seed)
    words = ["reading", "value", "sensor", "water", "station", "pressure", "document", "handler", "response", "account", "table", "service", "manager"]
    texts, secret, names = [], [], []
    for k in range(n):
        s, name = made(rng, k)
        secret.append(s)
        names.append(name)
        texts.append(" ".join(rng.choices(words, k=30)) + f" {s} " + " ".join(rng.choices(words, k=10)) + f" {name} password = {hashlib.md5(s.encode()).hexdigest()}")
    return documents(spark, texts), texts, secret, names


def test_ratio_and_all_spans_by_brute_force(spark):
    docs, texts, _, _ = corpus(spark)
    table = secrets.ratios(docs.select("doc_id", "text"))
    got = {r["doc_id"]: sorted(tuple(s) for s in r["spans"]) for r in secrets.scan(docs.select("doc_id", "text")).collect()}
    assert got == {i: brute_spans(t, table) for i, t in enumerate(texts)}


def test_recall_and_false_alarms_of_the_added_spans(spark):
    docs, texts, secret, names = corpus(spark, seed=8)
    spans = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in secrets.scan(docs.select("doc_id", "text")).collect()}
    hit = lambda i, what: any(a <= texts[i].index(what) < b for a, b in spans[i])
    assert sum(hit(i, s) for i, s in enumerate(secret)) >= 0.9 * len(secret)
    assert sum(hit(i, x) for i, x in enumerate(names)) <= 0.02 * len(names)


def test_pairs_counted_plainly(spark):
    """The model of random strings against a count of the same strings."""
    docs, _, _, _ = corpus(spark, n=40)
    table = secrets.ratios(docs.select("doc_id", "text"))
    assert len(table) == len(secrets.ALPHABET) ** 2 and not all(x == 0 for x in table)
    at = lambda a, b: table[secrets.ALPHABET.index(a) * len(secrets.ALPHABET) + secrets.ALPHABET.index(b)]
    assert at("7", "f") > 0 > at("r", "e") and all(math.isfinite(x) for x in table)


def test_long_texts(spark):
    rng = random.Random(5)
    run = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(17, 40)))
    texts = [" ".join(run() for _ in range(12_000)), "f" * 400_000, ("token = abcdefghijklmnop" + " é" * 20 + "\n") * 6_000]
    docs = documents(spark, texts).select("doc_id", "text")
    table = secrets.ratios(docs)
    spark.createDataFrame([(1,)], "x int").count()
    t = time.time()
    got = {r["doc_id"]: r["base"] for r in secrets.scan(docs).collect()}
    took = time.time() - t
    assert all([tuple(s) for s in got[i]] == brute_base(x) for i, x in enumerate(texts))
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    for i, x in enumerate(texts):
        out, at = [], 0
        for a, _, b in sorted(got[i]):
            if a >= at:
                out.append(x[at:a] + secrets.MASK)
            at = max(at, b)
        assert masked[i] == "".join(out) + x[at:]
    assert took < 60 and len(table)  # three texts and the sample's passes; a quadratic scan takes minutes
