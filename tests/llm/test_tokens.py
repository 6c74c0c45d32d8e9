import public_tokenizers
import pytest
from frames import documents, empty, texts
from seriespan.llm.tokens import Counter, token_counts


@pytest.fixture(scope="module")
def path():
    return public_tokenizers.path("byte_bpe_50k.json")


def whole(path, some):
    from tokenizers import Tokenizer

    return [len(Tokenizer.from_file(path).encode(t or "", add_special_tokens=False)) for t in some]


def test_counts_are_those_of_whole_texts(spark, path):
    got = {(r["doc_id"], r["n_bytes"]): (r["n_tokens"], r["over_limit"]) for r in token_counts(documents(spark), path).collect()}
    rows = documents(spark).select("doc_id", "text").collect()
    want = {(r[0], len((r[1] or "").encode())): (n, n > 512) for r, n in zip(rows, whole(path, [r[1] for r in rows]))}
    assert got == want
    assert token_counts(empty(spark), path).count() == 0


def test_cuts_are_safe_around_odd_spaces_and_marks(path):
    odd = ["a  b", "a  b c", "x　 y", "it's 're  's \t 1 2 ,, .", "<|endoftext|> <|endoftext|>a <|endoftext|>", " lead", "trail ", "a\n b", "᠎ a ᠎"]
    assert Counter(path).lengths(odd) == whole(path, odd)


def test_the_memory_of_pieces_is_bounded(path, monkeypatch):
    from seriespan.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_PIECES", 5)
    counter, some = Counter(path), [t or "" for t in texts()[:12]]
    for t in some:
        assert counter.lengths([t]) == whole(path, [t])
