"""License scan, whitening and fill-in-the-middle against brute force on odd tables."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weir.llm import fim, licenses, whitening

from test_small import documents, odd_texts


# ---------------------------------------------------------------- op11

def brute_words(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_licenses(text, contained=80, notices=licenses.NOTICES):
    words = brute_words(text)
    base = sorted((i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words))
                  if words[i:i + len(phrase.split())] == phrase.split())
    best, labels = 0.0, set()
    for label, notice in notices:
        all_words = brute_words(notice)
        want, stride = set(all_words), 1
        while stride < len(all_words):
            stride *= 2
        for at in range(0, len(words), stride):
            share = len(want & set(words[at:at + 2 * stride])) / len(want)
            if want and share * 100 >= contained - 1e-9:
                labels.add(label)
                best = max(best, share)
    bases = {label for _, label in base}
    return (len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(bases)),
            ",".join(sorted(bases | labels)), 1.0 if base else best)


LICENSED = [
    "Licensed under the Apache License, Version 2.0.", "x " * 50 + "Released under the MIT License.\n" * 3, "MIT LICENSE mit-license Mit\nlicense, mit  license",
    "licensed under cc by nc 4 0", "licensed under cc by-nc", "gnu general public license general public license", "mit K licenKe mit licensİ mit license",
    "w " * 13 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and documentation",
    "permission hereby free charge person copy software files", "a b c " * 3000 + "redistribution and use in source and binary forms with or without modification are permitted provided that conditions are met " * 40]


def shown(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_licenses(spark):
    texts = odd_texts() + LICENSED + LICENSED[:2]
    docs = documents(spark, texts).withColumns({c: F.lit("odd") for c in ("key", "blocks", "held", "label", "places", "word")})
    docs = docs.unionByName(docs.limit(0)).withColumn("doc_id", F.when(F.col("doc_id") != 3, F.col("doc_id")))
    got = licenses.licenses(docs)
    want = [((None if i == 3 else i), *brute_licenses(t)) for i, t in enumerate(texts)]
    assert shown(got.collect()) == shown(want)
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert licenses.licenses(docs.limit(0)).count() == 0


@pytest.mark.parametrize("contained", [30, 55, 100])
def test_every_block_that_holds_enough_is_found(spark, contained):
    rng = np.random.default_rng(contained)
    words = sorted({w for _, n in licenses.NOTICES for w in brute_words(n)}) + ["other", "more"]
    texts = [" ".join(rng.choice(words, size=int(k))) for k in rng.integers(1, 120, 60)]
    got = licenses.licenses(documents(spark, texts), contained=contained)
    assert shown(got.collect()) == shown([(i, *brute_licenses(t, contained)) for i, t in enumerate(texts)])


def test_matching_blocks(spark):
    rows = licenses.matches(documents(spark, ["x " * 40 + LICENSED[0]])).collect()
    assert rows and all(r["first"] <= 40 and r["last"] >= 40 and r["label"] == "apache" and r["containment"] == 1.0 for r in rows if r["notice"] == 0)


# ---------------------------------------------------------------- op12

def brute_whitening(rows, most=16):
    x = [(i, [int(np.floor(64 * float(c))) + 1_000_000 for c in v]) for i, v in rows
         if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(v) for _, v in x}), dtype=object)
    n, s = len(fit), fit.sum(0)
    centred = ((fit * n - s) / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    out = {}
    for i, v in x:
        y = (np.array(v, dtype=object) * n - s)
        out.setdefault(i, []).append((n, int((y * y).sum()), np.abs((y / n).astype(float) @ axes / np.sqrt(np.abs(values) + 1e-300)), values / values.sum()))
    return out


def test_whitening(spark):
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(20, 20)) * 1.2 ** -np.arange(20)[:, None]
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=20) @ mix]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(50)] + rows[:3]
    rows += [(None, rows[9][1]), (2000, None), (2001, []), (2002, [1.0] * 19 + [None]), (2003, [float("nan")] * 20), (2004, [float("-inf")] * 20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("odd") for c in ("x", "component", "n", "v")})
    got = whitening.whitened(df).collect()
    want = brute_whitening(rows)
    assert len(got) == 16 * sum(map(len, want.values()))
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], []).append(r)
    assert set(by_id) == set(want)
    for i, rs in by_id.items():
        n, deviation, white, explained = want[i][0]
        for r in rs:
            k = r["component"] - 1
            assert r["n"] == n and r["deviation"] == deviation and r["identity_error"] < 1e-9
            assert abs(abs(r["whitened"]) - white[k]) < 1e-8 and abs(r["explained"] / explained[k] - 1) < 1e-9
    assert {k + 1 for k in range(16)} == {r["component"] for r in got}


def test_whitening_of_few_and_equal_vectors(spark):
    def run(rows):
        return whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))

    assert run([(1, [1.0, 2.0])] * 5).count() == 0
    assert run([(1, None)]).count() == 0
    two = run([(1, [1.0, 2.0]), (2, [1.0, 4.0]), (3, [0.0])]).collect()
    assert [(r["vec_id"], r["component"], r["n"], round(abs(r["whitened"]), 9)) for r in sorted(two)] == [(1, 1, 2, 1.0), (2, 1, 2, 1.0)]
    far = run([(1, [1e15, 0.0]), (2, [-1e15, 0.0]), (3, [0.0, 1e15])]).collect()
    assert all(r["deviation"] is None for r in far) and len(far) == 6


def test_divide_and_conquer():
    rng = np.random.default_rng(0)
    for d in (1, 2, 3, 8, 40):
        q = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for values in (rng.random(d), np.repeat([1.0, 2.0], [d // 2, d - d // 2]), 10.0 ** -np.arange(d).clip(0, 14), np.zeros(d)):
            a = q @ np.diag(values) @ q.T
            a = (a + a.T) / 2
            found, axes = whitening.components(a)
            assert np.allclose(found, np.sort(values)[::-1], atol=1e-14 * max(1.0, d))
            assert np.allclose(axes.T @ axes, np.eye(d), atol=1e-11) and np.allclose(a @ axes, axes * found, atol=1e-13)
    a = rng.normal(size=(6, 6))
    a = a + a.T
    u = whitening.polar(a)
    assert np.allclose(u @ u, np.eye(6)) and np.all(np.linalg.eigvalsh(u @ a) > -1e-12)


# ---------------------------------------------------------------- op13

def brute_middle(doc_id, text, rate=100, spm=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i:i + 8], 16) for i in range(0, 32, 8)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    a, b, c = ("".join(units[i:j]) for i, j in ((0, low), (low, high), (high, len(units))))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return len(units), "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


MIDDLES = ["\n\n\n", "a\r\nb\n", "<P", "<\n<\n<\n<", "one <M> two\nthree", "S><P\n>é\n日本\n\n", "x\n" * 5000 + "end", "\n".join(map(str, range(40)))]


@pytest.mark.parametrize("rate,spm", [(100, 50), (40, 0), (100, 100), (0, 50)])
def test_fill_in_middle(spark, rate, spm):
    texts = odd_texts() + MIDDLES * 3
    docs = documents(spark, texts).withColumns({c: F.lit("odd") for c in ("form", "pieces", "output", "n", "carried")})
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") != 6, F.col("doc_id")))
    rows = fim.transform(docs, rate=rate, spm=spm)
    back = {}
    for r in fim.restore(rows).collect():
        back.setdefault(r["doc_id"], []).append((r["text"], r["restored_sha256"]))
    got = rows.collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[6 if r["doc_id"] is None else r["doc_id"]] or ""
        *want, output = brute_middle(r["doc_id"], text, rate, spm)
        assert [r["n"], r["form"], r["prefix_chars"], r["middle_chars"]] == want
        assert r["output"] == output and r["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()
        assert back[r["doc_id"]] == [(text, hashlib.sha256(text.encode()).hexdigest())]
    assert fim.transform(docs.limit(0)).count() == 0


def test_pieces_describe_the_output(spark):
    docs = documents(spark, MIDDLES)
    for r in fim.transform(docs).collect():
        buffers = [MIDDLES[r["doc_id"]].encode(), b"<P><S><M>"]
        assert b"".join(buffers[p["buffer"]][p["start"]:p["start"] + p["length"]] for p in r["pieces"]).decode() == r["output"]


def test_cuts_split_descriptors():
    table = fim.PieceTable.of(b"abcdefgh")
    a, b, c = table.cut(3, 3)
    assert [x.render() for x in (a, b, c)] == [b"abc", b"", b"defgh"]
    moved = fim.PieceTable.joined([c, a])
    assert [x.render() for x in moved.cut(1, 6)] == [b"d", b"efgha", b"bc"] and moved.render() == b"defghabc"
