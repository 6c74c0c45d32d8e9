import random
import re

import numpy as np
from frames import documents, empty, words
from seriespan.llm import minhash
from seriespan.llm.minhash import near_duplicates


def sets_of(rows):
    out = []
    for _, text in rows:
        raw = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
        w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def brute(rows):
    sets, ids = sets_of(rows), [r[0] for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            alike = a and b and None not in (ids[i], ids[j]) and 100 * len(a & b) >= 75 * len(a | b)
            if (alike or ids[i] == ids[j] is not None) and a and b and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for i, (key, _) in enumerate(rows):
        component = key if key is None else min(ids[j] for j in range(len(rows)) if group[j] == group[i] and ids[j] is not None)
        out.append((key, len(sets[i]), component, component == key))
    return sorted(out, key=repr)


def check(df):
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in near_duplicates(df).collect()), key=repr) == brute(rows)


def test_awkward_rows(spark):
    check(documents(spark))
    assert near_duplicates(empty(spark)).count() == 0


def family(n, seed, changes):
    """Copies of one text, each some words away from the one before, so that classes form chains."""
    r, w, out = random.Random(seed), words(120, seed).split(), []
    for _ in range(n):
        out.append(" ".join(w))
        for _ in range(changes):
            w[r.randrange(len(w))] = "w" + str(r.randrange(10**6))
    return out


def test_chains_copies_and_unlinked_relatives(spark):
    some = family(25, 1, 2) + family(25, 2, 5) + family(10, 3, 12) + family(3, 4, 1) * 8 + [words(50, 99 + i) for i in range(20)]
    random.Random(1).shuffle(some)
    check(spark.createDataFrame([(i, t) for i, t in enumerate(some)], "doc_id long, text string"))


def test_blocks_of_large_families_and_huge_buckets(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 700)
    monkeypatch.setattr(minhash, "BUCKET_COMPARED", 6)
    check(spark.createDataFrame([(i, t) for i, t in enumerate(family(40, 5, 3))], "doc_id long, text string"))


def test_rows_that_share_an_id(spark):
    rows = [(4, words(30, 1)), (4, words(30, 2)), (9, words(30, 1)), (1, words(30, 2)), (7, words(30, 3))]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_pigeonhole_keys_meet_within_the_radius():
    r = np.random.default_rng(3)
    a = r.integers(0, 256, (200, minhash.SYMBOLS), dtype=np.uint8)
    b = a.copy()
    for row in b:
        at = r.choice(minhash.SYMBOLS, minhash.RADIUS, replace=False)
        row[at] ^= r.integers(1, 256, minhash.RADIUS, dtype=np.uint8)
    for x, y in zip(minhash.chunk_keys(a), minhash.chunk_keys(b)):
        assert np.intersect1d(x, y).size


def test_signatures_estimate_similarity():
    r = np.random.default_rng(0)
    gaps = []
    for _ in range(40):
        pool = r.integers(0, 2**63, 500, dtype=np.uint64)
        a, b = minhash.signature(np.sort(pool[:400])), minhash.signature(np.sort(pool[100:]))
        gaps.append((a != b).mean())
    assert abs(np.mean(gaps) - 0.4) < 0.05
