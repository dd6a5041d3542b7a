import hashlib
import random
from array import array

import public_tokenizers
import pytest

from loomgraph.llm.bpe import codec
from loomgraph.llm.bpe_codec import encode_decode, encode_tree
from loomgraph.llm.token_counts import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "the", "ing", "'", "'s", "'ll", "re", "1", "22", " ", "  ", "\n", " \n", "é", "日", "😀", "!!", " ", "　", "<|endoftext|>", "<|end", "llama"]


def library_ids(text):
    return codec(PATH).library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("leaf", [7, 50])
def test_tree_equals_library(leaf):
    r = random.Random(leaf)
    for _ in range(300):
        some = r.sample(PARTS, r.choice([2, 4, len(PARTS)]))
        t = "".join(r.choice(some) for _ in range(r.choice([5, 60, 200])))
        assert array("I", encode_tree(codec(PATH), t, leaf)).tolist() == library_ids(t)


@pytest.mark.parametrize("t", ["a" * 3000, "!" * 999, " " * 999, "é" * 1000, "<|endoftext|>" * 90, "'" * 99 + "ll" * 99])
def test_unsplit_runs(t):
    assert array("I", encode_tree(codec(PATH), t, 64)).tolist() == library_ids(t)


def test_lone_spaces_of_every_kind_equal_library():
    r = random.Random(5)
    kinds = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1f", "\x85", "\xa0"]
    for n in range(400):
        words = ["".join(r.choices(["a", "Bc", "'s", "1", "é", "!", "ß", "'"], k=r.choice([1, 2, 5]))) for _ in range(30)]
        t = "".join(w + r.choice(kinds if n % 2 else kinds[:3]) * r.choice([1] if n % 3 else [1, 2]) for w in words)
        assert array("I", codec(PATH).encode(t)).tolist() == library_ids(t)


ROWS = [(1, "One two  three.", "x"), (2, None, "x"), (3, "", None), (3, "", None), (4, "z" * 9000, "y"), (5, "a b " * 9000 + "<|endoftext|>", "y")]


def test_queries_on_a_small_table(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, ids string")
    got = sorted(map(tuple, token_counts(df, PATH, longest=1000).collect()))
    want = sorted((i, len((t or "").encode()), n := len(library_ids(t or "")), n > 1024) for i, t, _ in ROWS)
    assert got == want
    out = encode_decode(df, PATH).collect()
    assert sorted((r.doc_id, r.decoded) for r in out) == sorted((i, t or "") for i, t, _ in ROWS)
    assert {hashlib.sha256(r.ids).hexdigest() for r in out} == {hashlib.sha256(array("I", library_ids(t or "")).tobytes()).hexdigest() for _, t, _ in ROWS}


def test_pieces_and_empty(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, ids string")
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert {r.doc_id: r.n_tokens for r in token_counts(df, path).collect()} == {i: len(model.encode(t or "")) for i, t, _ in ROWS}
    none = df.limit(0)
    assert token_counts(none, PATH).count() == 0 and encode_decode(none, PATH).count() == 0
