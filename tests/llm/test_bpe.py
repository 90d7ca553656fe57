import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quotelock.llm import bpe
from quotelock.llm.bpe import TokenAutomaton, Vocabulary, decode, encode
from quotelock.llm.queries import op3

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def automaton():
    return TokenAutomaton(Vocabulary.load(PATH))


def texts():
    random.seed(9)
    yield from ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "a" * 3000, " \n\n x  ", "don't we'll 's", "ա՘1 ࢏"]
    alphabets = ["aab  \n'1.é漢😀", "".join(map(chr, range(256))), "thereingion ", "՘ \u0085 　 a1"]
    for turn in range(3000):
        yield "".join(random.choices(alphabets[turn % 4], k=random.randrange(30)))


def test_ids_and_decoding_equal_the_library(library, automaton):
    for text in texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert automaton.encode(text) == ids
        assert automaton.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_tables_can_be_emptied_at_any_time(library, automaton, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_STATES", 5)
    monkeypatch.setattr(bpe, "MOST_WORDS", 3)
    for text in list(texts())[:300]:
        assert automaton.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_broken_ids_decode_as_in_the_library(library, automaton):
    random.seed(2)
    for _ in range(300):
        ids = [random.randrange(50257) for _ in range(random.randrange(8))]
        assert automaton.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_odd_rows(spark, odd_docs, no_docs, library):
    vocabulary = Vocabulary.load(PATH)
    encoded = encode(odd_docs.select("doc_id", "text", "ids", "key"), vocabulary, decoded="back")
    rows = encoded.collect()
    assert encoded.columns == ["doc_id", "key", "ids", "back"] and len(rows) == 10
    for row in rows:
        assert row["ids"] == library.encode(row["back"], add_special_tokens=False).ids
    again = decode(encoded.drop("back"), vocabulary, text="key")
    assert sorted(row["key"] for row in again.collect()) == sorted(row["back"] for row in rows)
    assert encode(no_docs, vocabulary).count() == 0


def test_query_equals_the_library(spark, folder, library):
    source = {row["doc_id"]: row["text"] for row in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for row in op3.build(spark, folder).collect():
        text = source[row["doc_id"]] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
