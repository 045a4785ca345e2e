import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lattica.llm import forced_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["a", "b", "the", "ing", " ", "  ", "\n", "\r\n", "\t", "'s", "'t", "1", "23", "é", "à", "　", "\xa0", "\x85", "\x1c", "՘", "Ᲊ", "࢏", "🙂", "中", "<|endoftext|>", " <|endoftext|> ", "<|endof", "!", "\x00"]
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(PATH)
    made.no_truncation()
    made.no_padding()
    return made


@pytest.fixture(scope="module")
def ours():
    with open(PATH, "rb") as f:
        return forced_bpe.ForcedBpe(f.read())


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(BITS), max_size=25).map("".join)), min_size=1, max_size=6))
def test_encodes_and_decodes_as_the_library(library, ours, texts):
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ours.encode_column(pa.array(texts, pa.string())).to_pylist() == expected
    assert [ours.decode(i) for i in expected] == library.decode_batch(expected, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50_300), max_size=12))
def test_decodes_any_ids_as_the_library(library, ours, ids):
    assert ours.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_no_token_holds_a_forced_pair(ours):
    for t in ours.bytes_of.values():
        assert not any(ours.forced[a << 8 | b] for a, b in zip(t, t[1:]))
    assert ours.forced[ord("e") << 8 | ord(" ")] and not ours.forced[ord("t") << 8 | ord("h")]


def test_long_fragments_and_forgotten_words(library, ours, monkeypatch):
    monkeypatch.setattr(forced_bpe, "MEMORY", 3)
    monkeypatch.setattr(forced_bpe, "MEMORY_BYTES", 1000)
    texts = ["z" * 60_000, "ab" * 30_000, "Xy" * 24 + "Xy" * 3, " x" * 50, "　" * 70, None, "", "one two three", "four five six one"]
    for _ in range(2):
        assert ours.encode_column(pa.array(texts, pa.string())).to_pylist() == [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_other_tokenizers_are_refused():
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f, pytest.raises(ValueError):
        forced_bpe.ForcedBpe(f.read())


def test_columns(spark, library):
    rows = [(1, "some text"), (1, "some text"), (2, None), (3, ""), (None, "no id <|endoftext|>"), (4, "z" * 100_000), (5, "žluťoučký 🙂\n\n kůň")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS ids", "'x' AS decoded", "2 AS n_tokens").repartition(2)
    encoded = forced_bpe.encoded(docs, PATH)
    found = forced_bpe.decoded(encoded, PATH).withColumn("sha", forced_bpe.decimal_sha256(F.col("ids"))).collect()
    expected = {}
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected[i] = (ids, text or "", hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert len(found) == len(rows)
    assert all((r["ids"], r["decoded"], r["sha"]) == expected[r["doc_id"]] for r in found)
    assert forced_bpe.decoded(encoded.withColumn("ids", F.lit(None).cast("array<int>")), PATH).filter("decoded is not null").count() == 0
    none = spark.createDataFrame([], DOCS)
    assert forced_bpe.decoded(forced_bpe.encoded(none, PATH), PATH).count() == 0
