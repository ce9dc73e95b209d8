"""The classifier: held-out accuracy, features against plain counting, odd rows."""

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from quire.llm import quality as Q

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = Q.op8_quality(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    told = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in told]) > 0.97


def test_features_equal_plain_counting():
    texts = [b"", b"a", b"ab ab  ab\nabc", "é éé".encode(), b"  x  ", b"same same same"]
    for text, (buckets, shares) in zip(texts, Q.counted(texts)):
        words = text.split()
        grams = [text_ for n in Q.GRAMS for i in range(len(text) + 3 - n) for text_ in [(b" " + text + b" ")[i:i + n]]
                 if len(text_) == n and not any(c <= 32 for c in text_[1:-1])]
        if not text:
            continue
        total = len(words) + len(grams)
        repeats = sum(a == b for a, b in zip(words, words[1:]))
        held = dict(zip(buckets.tolist(), shares.tolist()))
        assert abs(held.get(Q.REPEAT, 0) * total - repeats) < 1e-3
        assert abs(sum(held.values()) - 1) < 1e-5


def test_scores_do_not_depend_on_neighbours():
    rng = np.random.default_rng(0)
    model = Q.Model(rng.normal(size=1 << Q.BITS).astype(np.float32), 0.1)
    texts = [b"one two", b"", b"three " * 500, b"\xc3\xa9"]
    assert np.allclose(model.scores(texts), [model.scores([t])[0] for t in texts])


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "good text here", 5), (1, "good text here", 5), (2, None, 5), (None, "bad!!", 5), (3, "bad!! bad!!", 5), (4, "w " * 40000, 5)],
                                 "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (2, None), (None, 1), (9, 1)], "doc_id long, quality int")
    for labels, share in ((none, 0.5), (some, None), (some.filter("quality = 1"), 1.0)):
        model = Q.train(docs, labels)
        got = docs.select("doc_id", Q.score(spark, model, docs.text).alias("s")).collect()
        assert len(got) == 6 and all(0 <= r.s <= 1 for r in got)
        if share is not None:
            assert all(abs(r.s - share) < 1e-3 for r in got)
    assert Q.train(docs.limit(0), some).weights.any() == False  # noqa: E712
    assert docs.limit(0).select(Q.score(spark, model, docs.text)).count() == 0


def plain_shares(text):
    """Bucket -> share, by integers and dictionaries."""
    def bucket(code):
        code = code * 0xD6E8FEB86659FD93 % 2**64
        code ^= code >> 29
        return (code * 0xD6E8FEB86659FD93 % 2**64) >> (64 - Q.BITS)

    words = text.split()
    codes = [sum(c * pow(0x9E3779B97F4A7C15, i, 2**64) for i, c in enumerate(w)) % 2**64 for w in words]
    got = [Q.REPEAT if i and codes[i] == codes[i - 1] else bucket(codes[i]) for i in range(len(codes))]
    for n in Q.GRAMS:
        for i in range(len(text) + 3 - n):
            gram = (b" " + text + b" ")[i:i + n]
            if all(c > 32 for c in gram[1:-1]):
                code = n
                for c in gram:
                    code = (code << 8 | c) % 2**64
                got.append(bucket(code))
    return {b: got.count(b) / len(got) for b in set(got)}


def plain_fit(rows, labels):
    """The descent over lists of floats; returns the score of a text's shares."""
    rng = np.random.default_rng(0)
    start = rng.uniform(-1 / Q.DIMENSIONS, 1 / Q.DIMENSIONS, (1 << Q.BITS, Q.DIMENSIONS))
    vectors = {b: start[b].tolist() for shares in rows for b in shares}
    layer, bias, done = [[0.0] * Q.DIMENSIONS, [0.0] * Q.DIMENSIONS], [0.0, 0.0], 0

    def mean(shares):
        return [sum(s * vectors.get(b, start[b])[d] for b, s in shares.items()) for d in range(Q.DIMENSIONS)]

    def softmax(m):
        z = [sum(w * x for w, x in zip(layer[k], m)) + bias[k] for k in (0, 1)]
        e = [math.exp(v - max(z)) for v in z]
        return [v / sum(e) for v in e]

    while done < Q.STEPS:
        for i in rng.permutation(len(rows))[:Q.STEPS - done]:
            rate = Q.RATE * (1 - done / Q.STEPS)
            done += 1
            m = mean(rows[i])
            grad = [(k == labels[i]) - p for k, p in enumerate(softmax(m))]
            back = [grad[0] * layer[0][d] + grad[1] * layer[1][d] for d in range(Q.DIMENSIONS)]
            for k in (0, 1):
                layer[k] = [w + rate * grad[k] * x for w, x in zip(layer[k], m)]
                bias[k] += rate * 0.05 * grad[k]
            for b, s in rows[i].items():
                vectors[b] = [v + rate * s * g for v, g in zip(vectors[b], back)]
    return lambda shares: softmax(mean(shares))[1]


def test_fit_and_scores_equal_plain_python(spark):
    good = ["a fine day", "the sun rose", "we met them", "it was calm"]
    bad = ["buy buy now", "$$$ win", "click click", "xx yy zz"]
    texts = dict(enumerate(good + bad, 1)) | {20: "the fine sun", 21: "win win now", 22: "é new", 23: "w"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = {i: int(i <= len(good)) for i in range(1, 9)}
    model = Q.train(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"))
    got = {r.doc_id: r.s for r in docs.select("doc_id", Q.score(spark, model, docs.text).alias("s")).collect()}
    order = [r.doc_id for r in docs.filter("doc_id < 20").orderBy(F.xxhash64("doc_id")).collect()]
    scored = plain_fit([plain_shares(texts[i].encode()) for i in order], [labels[i] for i in order])
    for i, text in texts.items():
        assert abs(got[i] - scored(plain_shares(text.encode()))) < 1e-2, text
    assert all((got[i] > 0.5) == bool(y) for i, y in labels.items())
