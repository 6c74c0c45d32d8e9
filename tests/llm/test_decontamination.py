import random
import re
from collections import Counter

import numpy as np
from frames import documents, empty, words
from seriespan.llm import decontamination as D


def shingles(w):
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def brute(docs, items):
    """Every window of every item's length, without fingerprints."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    found = set()
    for key, text in docs:
        w = split(text)
        for item, item_text in items:
            own = split(item_text)
            if not own or len(w) < min(5, len(own)):
                continue
            want, size = shingles(own), min(5, len(own))
            for at in range(max(len(w) - len(own), 0) + 1):
                part = w[at : at + len(own)]
                got = Counter(tuple(part[i : i + size]) for i in range(len(part) - size + 1))
                if 4 * sum((got & want).values()) >= 3 * sum((got | want).values()):
                    found.add((key, item))
                    break
    return found


def planted(n=60):
    r = random.Random(5)
    items = [(i, words(r.randint(8, 60), 500 + i)) for i in range(25)] + [(25, "two words"), (26, ""), (27, None)]
    docs = []
    for i in range(n):
        body = words(r.randint(20, 200), i)
        if i % 2:
            w = r.choice(items[:25])[1].split()
            for _ in range(i % 7):
                w[r.randrange(len(w))] = "changed"
            body = body + " " + " ".join(w).upper() + " " + words(30, i + 7)
        docs.append((i, body))
    docs += [(n, items[3][1]), (n + 1, " ".join(items[4][1].split()[:-1])), (n + 2, "x two words y"), (n + 3, None), (n + 4, "")]
    return docs, items


def test_finds_what_brute_force_finds(spark):
    docs, items = planted()
    df = spark.createDataFrame([(*d, "e") for d in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.leaks(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute(docs, items)
    assert all(r["similarity"] >= 0.75 for r in got)
    leaked = {r["doc_id"] for r in got}
    assert {r[0] for r in D.clean(df, bench).select("doc_id").collect()} == {d[0] for d in docs} - leaked
    assert D.clean(df, bench).schema == df.schema


def test_awkward_rows(spark):
    bench = spark.createDataFrame([(1, words(80, 1)), (1, words(80, 1)), (None, "one two")], "item_id long, text string")
    got = Counter((r["doc_id"], r["item_id"]) for r in D.leaks(documents(spark), bench).collect())
    assert got[(6 * 7) % 19, 1] == 2 and any(item is None for _, item in got)
    assert D.leaks(empty(spark), bench).count() == 0
    assert D.leaks(documents(spark), bench.limit(0)).count() == 0
    assert D.clean(documents(spark), bench.limit(0)).count() == documents(spark).count()


def test_multi_index_gives_all_fingerprints_within_the_radius():
    r = np.random.default_rng(2)
    prints = r.integers(0, 2**63, 30, dtype=np.uint64)
    group = D.Length(list(range(30)), np.empty(0, np.uint64), prints)
    asked = []
    for _ in range(3000):
        bits = r.choice(64, r.integers(0, 40), replace=False)
        asked.append(int(prints[r.integers(30)]) ^ sum(1 << int(b) for b in bits))
    asked = np.array(asked, np.uint64)
    got = {(item, int(w)) for item, windows in group.candidates(asked) for w in windows}
    apart = np.bitwise_count(prints[:, None] ^ asked[None])
    assert got == set(zip(*map(lambda x: x.tolist(), np.nonzero(apart <= D.RADIUS)), strict=True))


def test_too_large_a_benchmark_raises(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(D, "MAX_ITEM_WORDS", 3)
    with pytest.raises(ValueError):
        D.leaks(documents(spark), spark.createDataFrame([(1, "a b c d")], "item_id long, text string"))
