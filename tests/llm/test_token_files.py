import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessella.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")


def corpus():
    r = random.Random(6)
    bits = ["hello", "World.", "don't", "'s", "it's,", "été", "éa", "İstanbul", "<|endoftext|>", "<|ENDOFTEXT|>", "a<|startoftext|>b", "12", "3.5%", "$$$", "%%%x", "...", " ", "x y", "≠≯", "\U0001f600", "naïve!", "\x00", "\x85", "中文", "|", "&&&'ll", "́", "ʼs", "ﬁ", "ΣΣ", "a'", "퟿"]
    rows = [(i * 3 - 50, "".join(r.choice(bits) + r.choice([" ", " ", "\n", "\t\t", "", "\x0b"]) for _ in range(r.choice([0, 1, 5, 63, 64, 65, 300])))) for i in range(150)]
    return rows + [(1000, None), (1001, ""), (1002, "  \n"), (7, rows[4][1]), (7, rows[4][1]), (7, "other"), (None, "null id"), (None, None), (1003, "hello World. " * 40000)]


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(tf, "BLOCK_TOKENS", 900)
    monkeypatch.setattr(tf, "PARTS_BYTES", 4000)
    rows = corpus()
    tokenizer = Tokenizer.from_file(PATH)
    want = [(d, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in rows]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, ids int").repartition(5)
    path = tf.scratch_path(spark, "round-trip")
    tf.write(docs, path, PATH)
    got = sorted(tf.read(spark, path).collect(), key=lambda x: x["start"])
    assert sorted(((x["doc_id"], list(x["ids"])) for x in got), key=str) == sorted(want, key=str)
    ids = [x["doc_id"] for x in got]
    assert ids == sorted(ids, key=lambda d: -(10**9) if d is None else d)
    assert [x["start"] for x in got] == np.cumsum([0] + [len(x["ids"]) for x in got])[:-1].tolist()
    crc = {(x["start"], x["ids_crc32"]) for x in tf.read(spark, path, digest=True).collect()}
    assert crc == {(x["start"], zlib.crc32(np.array(x["ids"], "<u4").tobytes())) for x in got}


def test_word_cache_equals_whole_texts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tf, "CACHED_WORDS", 5)
    encoder, tokenizer = tf.Encoder(PATH), Tokenizer.from_file(PATH)
    assert encoder.by_words
    for d, t in corpus():
        ids, sizes = encoder.encode(pa.array([t, t, None], pa.string()))
        assert ids.tolist() == 2 * (tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) + [2] and len(sizes) == 3


@pytest.mark.parametrize("change", ["split", "added", "normalizer"])
def test_other_files_encode_whole_texts(tmp_path, change):
    """A file that differs from the public one in a step that the cutting into words relies on."""
    import json

    import pyarrow as pa

    spec = json.load(open(PATH))
    if change == "split":
        spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = "[^x]+"
    elif change == "added":
        spec["added_tokens"][0] |= {"content": "hello w", "special": False}
    else:
        spec["normalizer"]["normalizers"][1]["content"] = "x"
    path = str(tmp_path / "other.json")
    json.dump(spec, open(path, "w"))
    encoder, tokenizer, texts = tf.Encoder(path), Tokenizer.from_file(path), ["hello world, it's x  two", None, "a\n b"]
    ids, sizes = encoder.encode(pa.array(texts))
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    assert not encoder.by_words and ids.tolist() == sum(want, []) and sizes.tolist() == [len(x) for x in want]


def test_empty_table(spark):
    assert tf.written_and_read(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("limit", [None, 9])
def test_code_is_a_length_limited_prefix_code(limit):
    r = np.random.default_rng(0)
    counts = np.concatenate([[0, 0], 2 ** np.arange(40), r.integers(0, 50, 300)])
    lengths, top = tf.code_lengths(counts, limit)
    assert lengths.max() <= top and ((lengths > 0) == (counts > 0)).all()
    assert np.isclose((0.5 ** lengths[lengths > 0].astype(float)).sum(), 1)
    ids = r.choice(np.flatnonzero(counts), 5000)
    code = tf.Code(lengths, top)
    sizes = np.array([1, 63, 64, 65, 4807])
    data, size, marks, n = code.encode(ids, sizes)
    at = marks + np.repeat((np.cumsum(size) - size) * 8, n)
    assert (code.decode(data, at, sizes) == ids).all()
    one, top = tf.code_lengths(np.array([0, 5]))
    assert one.tolist() == [0, 1]
