from __future__ import annotations

import random

import numpy as np
import pytest
import sentencepiece as spm
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerbeam.llm import pieces
from ledgerbeam.llm.params import tokenizer_path
from tests.llm.helpers import documents, ordered, table

MODEL = tokenizer_path("piece_bpe_32k.model")


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _message(*fields: tuple[int, int | bytes | float]) -> bytes:
    import struct

    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += _varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += _varint(number << 3) + _varint(value)
        else:
            out += _varint(number << 3 | 2) + _varint(len(value)) + value
    return out


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """A small unigram model, written by hand, with pieces that go on behind a space."""
    rng = random.Random(2)
    vocabulary = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    texts = {"▁", *"abcdeé"}
    while len(texts) < 120:
        texts.add("".join(rng.choice("▁abcdeé") for _ in range(rng.randint(2, 6))))
    vocabulary += [(t, -rng.uniform(2, 12), 1) for t in sorted(texts)]
    data = b"".join(
        _message((1, _message((1, t.encode()), (2, s), (3, k)))) for t, s, k in vocabulary
    )
    data += _message((2, _message((3, 1))))
    data += _message((3, _message((1, b"identity"), (3, 1), (4, 0), (5, 1))))
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(data)
    return str(path)


def ids(codec, text):
    return np.frombuffer(codec.encode(text), "<u4").tolist()


CHARS = "aabcdehnorstlTHE   \n\t.,1290é日本ßñ👍▁<0x>"


@pytest.fixture(scope="module")
def library():
    return spm.SentencePieceProcessor(model_file=MODEL)


def test_random_texts_equal_the_library(library):
    rng = random.Random(1)
    codec = pieces.piece_codec(MODEL)
    for _ in range(3000):
        text = "".join(rng.choice(CHARS) for _ in range(rng.randint(0, 40)))
        assert ids(codec, text) == library.encode(text), text
        assert codec.decode(codec.encode(text)) == library.decode(library.encode(text))


def test_a_very_long_word_streams(library):
    rng = random.Random(4)
    text = "".join(rng.choice("theandrofions") for _ in range(30_000))
    codec = pieces.piece_codec(MODEL)
    assert ids(codec, text) == library.encode(text)
    stream = pieces.StreamingEncoder(codec.model)
    given_out, most = [], 0
    for at in range(0, len(text), 100):
        given_out += stream.feed(text[at : at + 100])
        most = max(most, len(stream.text))
    given_out += stream.finish()
    assert [codec.model.ids[p] for p in given_out] == ids(codec, text)[1:] or "".join(given_out) == text
    assert most < 20 * codec.model.longest


def brute_unigram(model, text):
    """The best segmentation, by the whole lattice at once."""
    best = [(0.0, [])]
    for end in range(1, len(text) + 1):
        found = []
        for start in range(max(0, end - model.longest), end):
            piece = text[start:end]
            if piece in model.ids:
                gain = model.scores[model.ids[piece]]
            elif end - start == 1:
                gain = model.worst - 10
            else:
                continue
            found.append((best[start][0] + gain, [*best[start][1], piece]))
        best.append(max(found, key=lambda f: f[0]))
    return best[-1]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdeé x", max_size=50))
def test_unigram_equals_brute_force_and_library(unigram, text):
    codec = pieces.piece_codec(unigram)
    assert not codec.model.word_bound
    normal = codec.model.normalised(text)
    score, want = brute_unigram(codec.model, normal)
    got = codec.stream.feed(normal) + codec.stream.finish()
    total = sum(codec.model.scores[codec.model.ids[p]] if p in codec.model.ids else codec.model.worst - 10 for p in got)
    assert "".join(got) == normal and abs(total - score) < 1e-3
    library = spm.SentencePieceProcessor(model_file=unigram)
    if text:
        assert ids(codec, text) == library.encode(text)


def test_round_trip_over_spark(spark, library):
    rows = dict(enumerate([None, "", " ", "  two  spaces ", "line\nend\t", "日本 👍 é", "x" * 5000, "▁"]))
    encoded = pieces.encode(documents(spark, rows.items()), MODEL)
    want = sorted((i, library.encode(t or "")) for i, t in rows.items())
    assert ordered(encoded, "doc_id", "ids") == want
    back = pieces.decode(encoded, MODEL)
    expected = sorted((i, library.decode(library.encode(t or ""))) for i, t in rows.items())
    assert ordered(back, "doc_id", "text") == expected


def test_whole_documents_equal_the_library(spark, library):
    docs = table(spark, "documents", "0.01")
    got = {r["doc_id"]: r["ids"] for r in pieces.encode(docs, MODEL).collect()}
    for r in docs.select("doc_id", "text").collect():
        assert got[r["doc_id"]] == library.encode(r["text"] or "")
    assert pieces.digest(docs, MODEL).filter("NOT exact").isEmpty()


def test_nothing(spark):
    assert pieces.encode(documents(spark, []), MODEL).count() == 0
    assert pieces.digest(documents(spark, []), MODEL).count() == 0
    twice = pieces.digest(documents(spark, [(1, "a"), (1, "a"), (None, None)]), MODEL)
    assert [r[:2] for r in ordered(twice, "doc_id", "n_ids")] == [(None, 0), (1, 1), (1, 1)]
