import random
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meshwright.llm import rans, token_output
from meshwright.llm.queries import tokenizer_path

WORDS = tokenizer_path("word_bpe_49k.json")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=30), max_size=8))
def test_round_trip(documents):
    ids = np.arange(len(documents)) * 3 - 5
    blob = rans.encode(ids, np.array([len(d) for d in documents], np.uint32), np.array([x for d in documents for x in d], np.uint32))
    assert [(i, t.tolist()) for i, t in rans.Reader(blob).documents()] == list(zip(ids.tolist(), documents, strict=True))


def test_blocks_alone_and_damage():
    tokens = (np.random.default_rng(0).zipf(1.3, 700_000) % 40_000).astype(np.uint32)
    blob = rans.encode(np.array([1]), np.array([len(tokens)]), tokens)
    reader, size = rans.Reader(blob), rans.LANES * rans.STEPS
    assert (reader.block(1) == tokens[size : 2 * size]).all() and len(reader.counts) == 3
    assert len(blob) < 2 * len(tokens)
    broken = bytearray(blob)
    broken[-100] ^= 1
    with pytest.raises(rans.FormatError, match="block 2"):
        rans.Reader(bytes(broken)).tokens()
    assert (rans.Reader(bytes(broken)).block(0) == tokens[:size]).all()
    broken = bytearray(blob)
    broken[30] ^= 1
    with pytest.raises(rans.FormatError, match="header"):
        rans.Reader(bytes(broken))
    with pytest.raises(rans.FormatError):
        rans.Reader(b"not a file of this format")


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    library, encode = Tokenizer.from_file(WORDS), token_output.WordEncoder(WORDS)
    encode.words.size = 500  # generations turn often
    rng, pool = random.Random(1), "aAbé.,' \n\t1!́İΣςſKÅ\x01<|endoftext|>ﬀǅÉẞΩ_-²Ⅷ日"
    texts = ["", "a  b\t\r\nc", "x<|endoftext|>y", "Don't. WE'LL, 5. ...", "word " * 3000]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(0, 15))) for _ in range(4000)]
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        want = [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
        assert [np.frombuffer(b, np.uint32).tolist() for b in encode(part)] == want


def test_signs_after_words_are_learnt_apart():
    from tokenizers import Tokenizer

    library, encode = Tokenizer.from_file(WORDS), token_output.WordEncoder(WORDS)
    texts = ["that***", "größe!!?! cores,$$$ that*** a._", "x=; don't*** don'***", "É### ß) 5!! </s>** x<***", "the.' the'!! the\u0338= ="]
    texts += ["".join(random.Random(i).choices([*"aéZ5 ***", "the", *token_output.END_SIGNS, "'", "<", "\u0338", "\n"], k=20)) for i in range(3000)]
    for _ in range(2):  # unknown and known
        got = [np.frombuffer(b, np.uint32).tolist() for b in encode(texts)]
        assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert encode.ends and {"that***", "that", " ***"} <= encode.words.young.keys()


def test_files(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    rows = [(i * 2, f"word{i} " * (i % 7) + "é") for i in range(120)] + [(None, "none"), (3, None), (3, ""), (1001, "x " * 9000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, part int")
    manifest = token_output.write_tokens(docs, WORDS, 1, str(tmp_path / "f"), file_tokens=300)
    assert manifest.count() > 3 and manifest.agg({"documents": "sum"}).first()[0] == len(rows)
    back = {(r._id, tuple(np.frombuffer(r.ids, np.uint32).tolist())) for r in token_output.read_tokens(manifest, str(tmp_path / "f")).collect()}
    assert back == {(token_output.NO_ID if i is None else i, (*library.encode(t or "", add_special_tokens=False).ids, 1)) for i, t in rows}
    got = sorted(token_output.token_round_trip(docs, WORDS).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got][0] is None and [r.doc_id for r in got][1:] == sorted(i for i, _ in rows if i is not None)
    at = 0
    texts = {i: t for i, t in rows if i != 3}
    for r in got:
        if r.doc_id != 3:
            ids = [*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1]
            assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, np.uint32).tobytes()))
        at += r.n_tokens
    assert token_output.token_round_trip(docs.limit(0), WORDS).count() == 0


def test_blocks_in_parallel(spark, tmp_path):
    """Blocks that are decoded alone give the files' ids, whichever way the folder is named."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 400)))) for i in range(60)] + [(None, "x y"), (None, "z"), (None, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = f"file:{tmp_path}/blocks"
    assert token_output.location("/a/b") == "file:///a/b" and token_output.location("file:/a") == "file:///a" and token_output.location("hdfs://h/a") == "hdfs://h/a"
    manifest = token_output.write_tokens(docs, WORDS, 1, folder, file_tokens=5000)
    whole = {(r.part, r.seq): b"" for r in manifest.collect()}
    assert token_output.read_tokens(manifest, folder).count() == len(rows)
    for r in token_output.from_files(manifest, folder, lambda reader: iter([pd.DataFrame({"ids": [reader.tokens().tobytes()]})]), "ids binary").collect():
        whole[r.part, r.seq] = bytes(r.ids)
    found = {}
    for r in sorted(token_output.read_blocks(manifest, folder).collect(), key=lambda r: (r.part, r.seq, r.block)):
        assert 4 * r["first"] == len(found.get((r.part, r.seq), b""))
        found[r.part, r.seq] = found.get((r.part, r.seq), b"") + bytes(r.ids)
    assert found == whole and sum(map(len, whole.values())) == 4 * manifest.agg({"tokens": "sum"}).first()[0]


def test_blocks_of_a_large_file():
    tokens = (np.random.default_rng(1).zipf(1.3, 700_000) % 40_000).astype(np.uint32)
    blob = rans.encode(np.array([1]), np.array([len(tokens)]), tokens)
    asked = []
    reader = rans.Reader(lambda a, b: (asked.append(b - a), blob[a:b])[1], len(blob))
    size = rans.LANES * rans.STEPS
    assert (reader.block(2) == tokens[2 * size :]).all() and sum(asked) < len(blob) / 2
