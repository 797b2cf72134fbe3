"""Ids against the whole tokenizer, and the files against the ids."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from fleetscope.llm import token_files
from fleetscope.llm.queries import tokenizer_path

from .cases import crc, documents, frame


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoder(whole):
    r, e = random.Random(4), token_files.Encoder(tokenizer_path(), "<u4")
    bits = ["a", "b's", "'ll", "don't", " ", " ", " ", "\n", "\n\n", "\t", "é", ".", "1", "<|endoftext|>", "\r", "  ", "\x1c", " ", "日本", "word", "Élan", "über.", "x,", "##", "º", "abͰ", "!!\n"]
    for _ in range(5000):
        s = "".join(r.choice(bits) for _ in range(r.randint(0, 14)))
        assert np.frombuffer(e.encode(s), "<u4").tolist() == whole(s), repr(s)


def test_added_tokens(whole):
    e = token_files.Encoder(tokenizer_path(), "<u4")
    assert np.frombuffer(e.encode("x <|endoftext|> y"), "<u4").tolist() == whole("x <|endoftext|> y") == [87, 220, 50256, 331]
    spelled = Tokenizer.from_file(tokenizer_path())
    spelled.encode_special_tokens = True
    text = token_files.Encoder(tokenizer_path(), "<u4", added_as_text=True)
    assert np.frombuffer(text.encode("x <|endoftext|> y"), "<u4").tolist() == spelled.encode("x <|endoftext|> y", add_special_tokens=False).ids


def test_files(spark, whole, tmp_path):
    rows = documents() + documents()[:2] + [(900, "one <|endoftext|>two", "en", None, None, None, None, None)]
    df = frame(spark, rows)
    made = token_files.write(df, str(tmp_path / "t"), tokenizer_path(), length=64)
    got = sorted((tuple(r) for r in token_files.read_documents(made).collect()), key=lambda r: r[1])
    start, want = 0, []
    for d, text, *_ in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = whole(text) + [2]
        want.append((d, start, len(ids), crc(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [r[:4] for r in got] == want
    stream = []
    for m in sorted(made.manifest.collect(), key=lambda r: r["part"]):
        assert m["first"] == len(stream)
        n = -(-m["n_tokens"] // 64)
        for i in range(n):
            ids, mask = token_files.sequence(made.folder, m["tokens"], i)
            assert len(ids) == 64 and not ids.flags.owndata and (mask.all() or i == n - 1)
            stream += ids[mask].tolist()
    assert stream == [x for d, text, *_ in sorted(rows, key=lambda r: (r[0], r[1] or "")) for x in whole(text) + [2]]


def test_id_type():
    assert token_files.id_type(65536) == "<u2" and token_files.id_type(65537) == "<u4"


def test_empty_and_null_keys(spark, tmp_path):
    made = token_files.write(frame(spark, []), str(tmp_path / "e"), tokenizer_path())
    assert token_files.read_documents(made).count() == 0
    made = token_files.write(spark.createDataFrame([(None, None), (3, "x")], "doc_id long, text string"), str(tmp_path / "n"), tokenizer_path())
    assert sorted(r["start"] for r in token_files.read_documents(made).collect()) == [0, 1]
