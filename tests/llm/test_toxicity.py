import math
import random
from collections import defaultdict

import numpy as np
import xxhash

from docquarry.llm import toxicity as X

BAD = ["vile", "scum", "hate", "idiot", "trash"]


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 120))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(rng.randrange(3, 9)):
                text.insert(rng.randrange(len(text)), rng.choice(BAD))
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_held_out_accuracy_and_sparsity():
    model = X.fit([(t, y) for _, t, y in corpus(900, 1)])
    at, w, bias = model
    dense = np.zeros(2**X.BITS)
    dense[at] = w
    right = sum((bias + dense[np.unique(X.features(t))].sum() > 0) == bool(y) for _, t, y in corpus(300, 2))
    assert right >= 291
    assert 0 < len(at) < 20_000


def test_scores_and_rejection(spark, make):
    rows = corpus(400, 3)
    docs = make([(i, t) for i, t, _ in rows], clash=True)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows[:300]] + [(None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    rated = {r.doc_id: r.toxic for r in X.toxicity(docs, labels).collect()}
    assert sum(rated[i] == bool(y) for i, _, y in rows[300:]) >= 97
    kept = X.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r[0] for r in kept.collect()} == {i for i, bad in rated.items() if not bad}


def test_edges(spark, make):
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in corpus(200, 4)], "doc_id long, quality int, toxic int")
    docs = make([(i, t) for i, t, _ in corpus(200, 4)] + [(900, None), (901, ""), (902, "w1 " * 100_000), (903, "w1 w2"), (903, "w1 w2"), (None, "w3")])
    scored = X.toxicity(docs, labels).collect()
    assert len(scored) == 206 and all(0 <= r.toxicity <= 1 for r in scored)
    by = {}
    for r in scored:
        by.setdefault(r.doc_id, set()).add(r.toxicity)
    assert by[900] == by[901] and len(by[903]) == 1
    one_class = labels.where("toxic = 0")
    assert X.drop_toxic(docs, one_class).count() == docs.count() * 0 + len([r for r in X.toxicity(docs, one_class).collect() if not r.toxic])
    assert X.toxicity(make([]), labels).count() == 0


def test_without_both_classes_nothing_is_rejected(spark, make):
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    assert X.drop_toxic(make([(0, "vile"), (1, "x")]), labels).count() == 2
    assert X.drop_toxic(make([(0, "vile")]), labels.limit(0)).count() == 1


def scalar_features(text, bits):
    def mix(v):
        v = (v ^ v >> 30) * 0xBF58476D1CE4E5B9 & M64
        v = (v ^ v >> 27) * 0x94D049BB133111EB & M64
        return v ^ v >> 31

    M64 = 2**64 - 1
    h = [xxhash.xxh64_intdigest(w.strip(X._PUNCTUATION).lower()) for w in text.split()]
    found = set(h)
    for gap in (1, 2):
        found |= {mix(a ^ (b * 0x9E3779B97F4A7C15 + gap & M64)) for a, b in zip(h, h[gap:])}
    return {f >> 64 - bits for f in found}


def scalar_ftrl(rows, bits, epochs=3, seed=7, alpha=0.15, beta=1.0, l1=2.0, l2=0.1):
    """FTRL-proximal by its equations, a coordinate at a time."""
    z, n, zb, nb = defaultdict(float), defaultdict(float), 0.0, 0.0

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    seen = [(scalar_features(t or "", bits), y) for t, y in rows]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(seen)):
            places, y = seen[k]
            w = {i: weight(i) for i in places}
            b = -zb / ((beta + math.sqrt(nb)) / alpha)
            g = 1 / (1 + math.exp(-(math.fsum(w.values()) + b))) - y
            for i in places:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / alpha * b
            nb += g * g
    return {i: weight(i) for i in z if weight(i)}, -zb / ((beta + math.sqrt(nb)) / alpha)


def test_scores_equal_scalar_ftrl(spark, make, rng):
    nice, foul = [f"n{i}" for i in range(60)], [f"f{i}" for i in range(8)]
    rows = [(i, " ".join(rng.choice(nice + foul * (i % 2)) for _ in range(rng.randrange(1, 40)))) for i in range(60)]
    rows += [(60, "f1 f2 f3 n1"), (61, None), (62, ""), (None, "f1 f2"), (63, "F1, f2! " * 20_000), (5, "another text"), (5, "another text")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(51, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    docs = make(rows, clash=True)
    texts = {}
    for i, t in rows:
        if i is not None and i < 50 and t is not None:
            texts[i] = min(t, texts.get(i, t))
    weights, bias = scalar_ftrl([(texts[i], i % 2) for i in sorted(texts)], 20)
    got = sorted(((r[0], r[1], r[2]) for r in X.toxicity(docs, labels).collect()), key=repr)

    def score(text):
        return 1 / (1 + math.exp(-(bias + math.fsum(weights.get(i, 0.0) for i in scalar_features(text or "", 20)))))

    assert len(got) == len(rows)
    for (i, s, toxic), (j, e) in zip(got, sorted(((i, score(t)) for i, t in rows), key=lambda r: repr((r[0], round(r[1], 6))))):
        assert i == j and abs(s - e) < 2e-5 and (toxic == (e > 0.5) or abs(e - 0.5) < 1e-5)


def test_the_sample_is_bounded_where_ids_repeat(spark, make):
    docs = make([(1, "a b")] * 20 + [(2, "c d")] * 20)
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    assert X.training_rows(docs, labels, max_rows=1).count() == 2
