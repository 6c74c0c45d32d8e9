import re

from frames import documents, empty, texts, words
from pyspark.sql import functions as F
from seriespan.llm import rules


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    again = {x for x in windows if windows.count(x) > 1} if len(windows) < 3000 else {x for x in set(windows) if len(set(windows)) < len(windows) and windows.count(x) > 1}
    covered = {i + k for i, x in enumerate(windows) if x in again for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_counts_match_plain_python(spark):
    some = [t for t in texts() if len(t or "") < 100_000]
    got = rules.count_texts([(t or "").encode() for t in some])
    assert [tuple(r[:5]) for r in got.tolist()] == [brute(t) for t in some]


def test_awkward_rows(spark):
    df = documents(spark)
    out = rules.adaptive_rules(df)
    assert out.count() == df.count() and rules.adaptive_rules(empty(spark)).count() == 0
    for r in out.collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def corpus(spark):
    rows = []
    for i in range(900):
        lang = ("aa", "bb")[i % 2]
        w = words(80, i).split()
        if lang == "bb":
            w = [x * 3 for x in w]  # this language's words are three times as long
        junk = i % 10 == 0
        rows.append((i, " ".join(x + "#%" for x in w) if junk else " ".join(w), lang, f"s{i % 3}" if i % 7 else None, junk))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, junk boolean")


def test_thresholds_follow_the_group(spark):
    df = corpus(spark)
    out = rules.adaptive_rules(df).join(df.select("doc_id", "junk"), "doc_id").groupBy("junk").agg(F.avg(F.col("kept").cast("int"))).collect()
    share = {r[0]: r[1] for r in out}
    assert share[False] == 1 and share[True] == 0
    marks = rules.thresholds(rules.sketch(rules.measures(df)), min_rows=50).groupBy("lang").agg(F.min("word_length_low"), F.max("word_length_high")).collect()
    by = {r[0]: r[1:] for r in marks}
    assert by["aa"][1] < by["bb"][0]  # words fit for one language would fail in the other


def test_sketches_merge_and_are_accurate(spark):
    df = rules.measures(corpus(spark))
    parts = rules.sketch(df.where("doc_id % 2 = 0")).unionByName(rules.sketch(df.where("doc_id % 2 = 1")))
    whole = rules.merge(rules.sketch(df), "lang", "source")
    assert sorted(map(repr, rules.merge(parts, "lang", "source").collect())) == sorted(map(repr, whole.collect()))
    got = rules.quantiles(rules.merge(rules.sketch(df)), [], (0.25, 0.5, 0.75)).where("rule = 'word_length'").first()
    values = sorted(r[0] for r in df.select(F.expr("word_chars / n_words")).collect())
    for q, share in (("q0", 0.25), ("q1", 0.5), ("q2", 0.75)):
        exact = values[-(-int(len(values) * share * 100) // 100) - 1]
        assert abs(got[q] / exact - 1) < rules.GAMMA - 1
