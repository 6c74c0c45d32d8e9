"""Small document frames with the awkward cases every operator must stand."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _k string, score string, size string, shard string, target string"


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))


def texts() -> list[str | None]:
    """Nulls, empties, short texts, copies, near copies, non-ASCII, odd spaces, one very long text."""
    base = words(80, 1)
    near = base.split()
    near[40] = "changed"
    far = base.split()
    far[10:60:3] = ["other"] * len(far[10:60:3])
    return [
        None, "", "   \n\t ", "one two", "one two", "ONE two", base, base, " ".join(near), " ".join(far), base.upper(),
        "é ü ß   　 x\x00y " * 12, "no_space_at_all" * 200, "\n".join(["the same line again"] * 30), "a b c " * 40,
        words(30_000, 2), "<|endoftext|> it's they'll 123 456 #*$%&|<>", words(60, 3) + " " + base,
    ]


def documents(spark, extra: bool = True):
    """A row per text, ids out of order, one null id, null metadata, and columns that might clash."""
    rows = []
    for i, text in enumerate(texts()):
        lang, source = (None, None) if i == 7 else (("en", "de")[i % 2], f"src{i % 3}")
        key = None if i == 17 else (i * 7) % 19
        rows.append((key, text, lang, source, None if text is None else len(text), "x", "y", "z", "w", "v"))
    df = spark.createDataFrame(rows, DOCS)
    return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")


def empty(spark):
    return spark.createDataFrame([], DOCS)
