"""The chain's scores from its weights, and the choice of features, in plain Python."""

import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridlume.llm import textops as T
from gridlume.llm import toxicity


def words_of(text):
    return [w.lower() for w in re.findall(rb"[A-Za-z0-9\x80-\xff]+", (text or "").encode())]


def code_of(word, n=0):
    """The number of a word, or of its first ``n`` bytes."""
    buf = np.frombuffer(word, np.uint8)
    end = np.array([n or len(word)])
    return int((T.hash_spans(buf, np.array([0]), end)[0] + T.U64(n)) >> T.U64(64 - toxicity.BITS))


def features_of(text):
    found = set()
    for w in words_of(text):
        found.add(code_of(w))
        found |= {code_of(w, n) for n in toxicity.BEGINNINGS if len(w) > n}
    marks = {c for c in toxicity._MARKS if c in (text or "").encode()}
    return found | {int(T.mix(np.array([c + 1000], T.U64))[0] >> T.U64(64 - toxicity.BITS)) for c in marks}


def corpus(n=160):
    rng = random.Random(21)
    rows, labels = [], []
    for i in range(n):
        toxic, poor = rng.random() < 0.3, rng.random() < 0.3
        text = " ".join(rng.choices("alpha beta gamma delta epsilon zeta eta theta".split(), k=rng.randint(3, 30)))
        text += " Vilo grumak!" * toxic + " cheap $$ buynow" * poor
        rows.append((i, text)), labels.append((i, int(not poor), int(toxic)))
    return rows, labels


def test_scores_follow_from_the_weights(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "VILO vilogram ébène")], "doc_id long, text string")
    chain = toxicity.train(docs, spark.createDataFrame(labels[:100], "doc_id long, quality int, toxic int"), toxicity.CATEGORIES)
    assert [x.name for x in chain] == ["poor", "toxic"] and len(chain[1].chain) == 1 and all(len(x.chosen) for x in chain)
    got = {r.doc_id: r for r in toxicity.score(docs, chain).collect()}
    for i, text in [*rows, (900, None), (901, ""), (902, "VILO vilogram ébène")]:
        before, own = [], features_of(text)
        for link in chain:
            z = link.bias + sum(w for c, w in zip(link.chosen.tolist(), link.weights, strict=True) if c in own) + sum(a * b for a, b in zip(before, link.chain, strict=True))
            before.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        assert math.isclose(got[i].p_poor, before[0], rel_tol=1e-9) and math.isclose(got[i].p_toxic, before[1], rel_tol=1e-9)
        assert got[i].toxic == (before[1] >= toxicity.THRESHOLD)


def test_chosen_features_have_the_largest_likelihood_ratios():
    rows, labels = corpus()
    y = np.array([t for _, _, t in labels])
    part = next(T.slices(pa.array([t for _, t in rows])))
    doc, code = toxicity.features(part)
    pairs = np.unique(np.stack([doc, code.astype(np.int64)], axis=1), axis=0)
    assert {(int(d), int(c)) for d, c in pairs} == {(i, c) for i, t in rows for c in features_of(t)}

    def ratio(c):
        table = np.zeros((2, 2))
        for i, t in rows:
            table[int(c in features_of(t)), y[i]] += 1
        expected = table.sum(axis=1, keepdims=True) * table.sum(axis=0, keepdims=True) / table.sum()
        return sum(o * math.log(o / e) for o, e in zip(table.ravel(), expected.ravel(), strict=True) if o)

    every = sorted({int(c) for c in pairs[:, 1]})
    stat = {c: ratio(c) for c in every if sum(c in features_of(t) for _, t in rows) >= 2}
    for most in (3, 8):
        chosen = toxicity._choose(pairs[:, 0].astype(np.int32), pairs[:, 1].astype(np.int32), y, most)
        least = sorted((v for v in stat.values() if v > 3), reverse=True)[:most]
        assert sorted((stat[c] for c in chosen.tolist()), reverse=True) == sorted(least, reverse=True) or np.allclose(sorted(stat[c] for c in chosen.tolist()), sorted(least))


def test_links_learn_from_out_of_fold_answers(spark):
    """A second category equal to the first: the chain's own weight carries it, and no fold scores what it has learnt from."""
    rows, labels = corpus(100)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("again", F.col("toxic"))
    chain = toxicity.train(docs, known, {"first": "toxic = 1", "second": "again = 1"})
    assert chain[1].chain[0] > 0
