import random

import numpy as np
import pytest
from frames import documents, empty, words
from seriespan.llm import quality, toxicity
from seriespan.llm.labelled import held_out, training_texts


def labelled(spark, n=240):
    r, docs, labels = random.Random(4), [], []
    for i in range(n):
        toxic, junk = i % 3 == 0, i % 4 == 0
        w = words(r.randint(40, 90), i).split()
        if toxic:
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "moron"]))
        text = " ".join(w)
        if junk:
            text = " ".join(x.upper() + "!!" for x in w)
        docs.append((i, text, "n"))
        labels.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(scored, labels, name):
    rows = scored.where("held_out").join(labels, "doc_id").select("predicted", name).collect()
    assert len(rows) > 20
    return np.mean([r[0] == r[1] for r in rows])


@pytest.mark.parametrize("module,name", [(toxicity, "toxic"), (quality, "quality")])
def test_learns_on_held_out_rows(spark, module, name):
    docs, labels = labelled(spark)
    model = module.fit(docs, labels, name)
    scored = module.score(docs, model)
    assert scored.count() == docs.count() and scored.columns == ["doc_id", "held_out", "score", "predicted"]
    assert accuracy(scored, labels, name) > 0.93


@pytest.mark.parametrize("module,name", [(toxicity, "toxic"), (quality, "quality")])
def test_awkward_rows(spark, module, name):
    docs, labels = labelled(spark)
    odd = documents(spark)
    scored = module.score(odd, module.fit(docs, labels, name)).collect()
    assert len(scored) == odd.count() and all(0 <= r["score"] <= 1 for r in scored)
    nothing = labels.limit(0)
    assert all(r["score"] < 1e-9 for r in module.score(odd, module.fit(docs, nothing, name)).collect())
    assert module.score(empty(spark), module.fit(docs, labels, name)).count() == 0
    one = labels.withColumn(name, labels[name] * 0 + 1)
    assert all(r["score"] > 0.99 for r in module.score(odd, module.fit(docs, one, name)).collect())


def test_labels_of_held_out_rows_are_never_learnt(spark):
    import zlib

    docs, labels = labelled(spark)
    got = {r[0] for r in docs.select("doc_id", held_out().alias("h")).where("h").collect()}
    assert got == {i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0}
    lying = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    a = toxicity.score(docs, toxicity.fit(docs, labels)).orderBy("doc_id").collect()
    assert a == toxicity.score(docs, toxicity.fit(docs, lying)).orderBy("doc_id").collect()
    assert training_texts(docs, labels, "toxic", 10).count() == 10


def test_votes_are_those_of_brute_force():
    r = np.random.default_rng(0)
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    known, asked, labels = unit(r.standard_normal((400, 8))), unit(r.standard_normal((300, 8))), r.integers(0, 2, 400).astype(np.float32)
    model = quality.Model(None, None, None, known, labels)
    got = quality.votes(model, asked, 5)
    for v, g in zip(asked, got):
        near = known @ v
        best = np.argsort(-near)[:5]
        w = np.clip(near[best].astype(np.float64), 0, None) ** quality.SHARPNESS
        assert g == pytest.approx((w * labels[best]).sum() / w.sum(), abs=1e-5)


def test_keep_is_score(spark):
    docs, labels = labelled(spark)
    model = quality.fit(docs, labels)
    kept = {r[0] for r in quality.keep(docs, model).select("doc_id").collect()}
    assert kept == {r[0] for r in quality.score(docs, model).where("predicted = 1").select("doc_id").collect()}
    assert quality.keep(docs, model).schema == docs.schema


def grams(text):
    """The distinct codes of a text's n-grams, one at a time; an n-gram may reach past the end."""
    points = [ord(c) for c in text.lower()] + [0] * 4
    out = set()
    for n in toxicity.GRAMS:
        for i in range(len(text.lower())):
            value = 0
            for k in range(n):
                value = (value * 0x01000193 + points[i + k] + k + 1) % 2**32
            value = ((value ^ (value >> 15)) * 0x85EBCA6B) % 2**32
            value = ((value ^ (value >> 13)) * 0xC2B2AE35) % 2**32
            out.add(value >> (32 - toxicity.BITS))
    return out


def mixed_texts(n=50):
    r = random.Random(8)
    odd = ["", None, "a", "ab\x00\x00\x00\x00\x00c", "É ß \U0001f600", "x" * 5000]
    return odd + [words(r.randint(1, 60), i) for i in range(n - len(odd))]


def test_features_are_those_of_each_text_alone():
    texts = mixed_texts()
    text, code = toxicity.features(texts)
    assert [set(code[text == i].tolist()) for i in range(len(texts))] == [grams(t or "") for t in texts]
    wanted = np.arange(1 << toxicity.BITS) % 3 == 0
    text, code = toxicity.features(texts, wanted)
    assert [set(code[text == i].tolist()) for i in range(len(texts))] == [{c for c in grams(t or "") if wanted[c]} for t in texts]


def test_scores_depend_on_the_text_alone(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    texts = mixed_texts() + [r["text"] for r in docs.limit(20).collect()]
    alone = {}
    for i, t in enumerate(texts):
        weight = sum(float(model.weights[c]) for c in grams(t or "")) + model.intercept
        alone[i] = 1 / (1 + np.exp(-weight))
    for seed, parts in ((0, 1), (1, 1), (2, 7), (3, 70)):
        rows = list(enumerate(texts))
        random.Random(seed).shuffle(rows)
        got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), model).collect()
        assert len(got) == len(texts) and all(abs(r["score"] - alone[r["doc_id"]]) < 1e-9 for r in got)


def test_counts_and_ratios(spark):
    texts, labels = mixed_texts(40)[1:], [i % 2 for i in range(39)]
    df = spark.createDataFrame(list(zip(texts, labels)), "text string, label int").repartition(3)
    counts = toxicity.class_counts(df)
    want = {}
    for t, y in zip(texts, labels):
        for c in grams(t or ""):
            want.setdefault(c, [0, 0])[1 - y] += 1
    assert {r["code"]: [r["ones"], r["zeros"]] for r in counts.collect()} == want
    ratio, z, drawn = toxicity.ratios_of(counts.toArrow(), 19, 20)
    total = [sum(v[s] for v in want.values()) + 2**toxicity.BITS for s in (0, 1)]
    for c, (p, q) in want.items():
        assert abs(ratio[c] - (np.log((p + 1) / total[0]) - np.log((q + 1) / total[1]))) < 1e-9
        gap, error = np.log((p + 1) / 19) - np.log((q + 1) / 20), np.sqrt(1 / (p + 1) + 1 / (q + 1))
        assert abs(z[c] - abs(gap) / error) < 1e-9
        assert abs(drawn[c] - np.sign(gap) * max(abs(gap) - 3 * error, 0)) < 1e-9
    assert not drawn[[c for c in range(1 << toxicity.BITS) if c not in want]].any()


def test_a_wide_lexicon(spark):
    """One of 120 words marks a text: many more n-grams than have a coefficient of their own."""
    r = random.Random(12)
    lexicon = ["".join(r.choice("ijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(120)]
    docs, labels = [], []
    for i in range(6000):
        w, toxic = words(r.randint(30, 120), i).split(), i % 3 == 0
        if toxic:
            w.insert(r.randrange(len(w)), r.choice(lexicon))
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    assert accuracy(toxicity.score(docs, toxicity.fit(docs, labels)), labels, "toxic") > 0.95


def test_repeated_keys_do_not_widen_the_sample(spark):
    docs = spark.createDataFrame([(i % 10, f"text {i}") for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, toxic int")
    got = sorted(training_texts(docs, labels, "toxic", 5).collect())
    assert len(got) == 5 and got == sorted(training_texts(docs.repartition(7), labels, "toxic", 5).collect())
