import hashlib
import random

import pandas as pd
import pytest
import sentencepiece as spm

from meshwright.llm import sentencepiece_codec as sc
from meshwright.llm.queries import tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("trim", [True, False])
def test_normaliser_equals_library(rule, trim):
    library = spm.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=trim)
    own = sc.Normalizer(dict(sc._fields(library.serialized_model_proto()))[3])
    rng = random.Random(0)
    for _ in range(1500):
        text = "".join(rng.choice("abc ABC  ﬁ①Å①　ｶﾞ½ﬀ㍿é é\t\n​日本 ▁") for _ in range(rng.randint(0, 12)))
        normal, origin = own(text)
        assert normal.decode() == library.normalize(text), text
        assert len(origin) == len(normal) + 1 and (origin[1:] >= origin[:-1]).all() and origin[-1] <= len(text.encode())


def test_spans_cover_the_text():
    own = sc.codec(MODEL)
    for text in ("", "a", " a  b ", "héllo\nwörld ▁x ﬁ 日本 😀\x00z", "   ", "\t\ta", "x" * 5000):
        ids = own.encode([text])[0]
        spans = own.spans(text, ids)
        assert (spans[1:, 0] == spans[:-1, 1]).all()
        assert not len(ids) or (spans[0, 0], spans[-1, 1]) == (0, len(text.encode()))
        raw = text.encode()
        for (a, b), i in zip(spans.tolist(), ids, strict=True):
            if own.widths[i] > 1 and b > a:
                assert raw[a:b].decode().replace(" ", "▁") == own.library.id_to_piece(i)[-len(raw[a:b].decode()) :]


def test_rows(spark):
    library = spm.SentencePieceProcessor(model_file=MODEL)
    rows = [(1, "Hello wörld"), (1, None), (None, ""), (2, "ab " * 4000), (3, "\x00▁ <s>")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted(
        (str(i), len(e := library.encode(t or "")), digest(",".join(map(str, e))), digest(library.decode(e)), len((t or "").encode())) for i, t in rows
    )
    got = sc.piece_digests(docs, MODEL).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256, r.span_bytes) for r in got) == want
    full = {r.doc_id: r for r in sc.encode_pieces(docs.where("doc_id = 3"), MODEL).collect()}[3]
    assert full.ids == library.encode("\x00▁ <s>") and full.decoded == library.decode(full.ids) and len(full.spans) == len(full.ids)
    assert sc.piece_digests(docs.limit(0), MODEL).count() == 0


def hostile(rng, n):
    alphabet = ["a", "b", "the", " ", "  ", "\n", "\t", "▁", "é", "ß", "日本", "😀", "\x00", "<s>", "<0x41>", "ing", "tion", ".", ",", "\u0301", "\ufffd", "zz", "0", "12"]
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_ids_and_texts_equal_library():
    library = spm.SentencePieceProcessor(model_file=MODEL)
    own = sc.codec(MODEL)
    rng = random.Random(1)
    texts = [hostile(rng, rng.randint(0, 60)) for _ in range(4000)] + [hostile(rng, 3000), "x" * 5000, "ab" * 3000, " " * 500, "the" * 400 + " " + "\n" * 300]
    for text in texts:
        ids = own.coded(text)[0].tolist()
        assert ids == library.encode(text), text
        assert own.decode(ids) == library.decode(ids), text


def test_decoding_any_ids_equals_library():
    library = spm.SentencePieceProcessor(model_file=MODEL)
    own = sc.codec(MODEL)
    rng = random.Random(2)
    for _ in range(3000):
        ids = [rng.randrange(rng.choice((10, 300, 32000))) for _ in range(rng.randint(0, 8))]
        assert own.decode(ids) == library.decode(ids), ids


def test_long_words_by_heap(monkeypatch):
    own = sc.codec(MODEL)
    rng = random.Random(3)
    words = ["".join(rng.choice("abetionsr▁") for _ in range(rng.randint(2, 90))) for _ in range(300)]
    want = [own.merges._join(w) for w in words]
    monkeypatch.setattr(sc, "LONG", 0)
    assert [own.merges._join(w) for w in words] == want


def test_mapped_model_through_spark(spark, tmp_path):
    """A model whose normaliser has a character map: each piece's span holds what the library aligns it with."""
    with open(MODEL, "rb") as f:
        given = f.read()
    # the given vocabulary with another normaliser: no model is trained
    spec = spm.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True).serialized_model_proto()
    rule = dict(sc._fields(spec))[3]

    def varint(n):
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes(out + bytes([n]))

    parts = []
    for number, value in sc._fields(given):
        if number != 3:
            parts.append(varint(number << 3 | 2) + varint(len(value)) + value)
    model = tmp_path / "mapped.model"
    model.write_bytes(b"".join(parts) + varint(3 << 3 | 2) + varint(len(rule)) + rule)
    library = spm.SentencePieceProcessor(model_file=str(model))
    rows = [(1, "ﬁne  café １２"), (2, " ㍿ ｶﾞ\t½"), (3, ""), (4, None), (5, "Å" * 500), (5, " \u3000x ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sc.encode_pieces(docs, str(model)).collect()
    assert len(got) == len(rows)
    for r, (_, text) in zip(sorted(got, key=lambda r: r.doc_id), sorted(rows, key=lambda r: r[0]), strict=True):
        assert sorted(map(tuple, [(x.doc_id, tuple(x.ids)) for x in got])) == sorted((i, tuple(library.encode(t or ""))) for i, t in rows)
        if r.doc_id != 5:
            assert r.decoded == library.decode(r.ids)
            raw = (text or "").encode()
            assert all(0 <= s.begin <= s.end <= len(raw) for s in r.spans) and len(r.spans) == len(r.ids)


def test_new_words_are_merged_side_by_side(monkeypatch):
    """Ids are the library's, and few words of a block go through their merges one by one."""
    library = spm.SentencePieceProcessor(model_file=MODEL)
    own, alone = sc.PieceCodec(MODEL), []
    join = own.merges._join
    monkeypatch.setattr(own.merges, "_join", lambda word: alone.append(word) or join(word))
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("aabcdeehiinorst,.ßé日😀") for _ in range(rng.randint(1, 12))) for _ in range(60)) for _ in range(300)]
    assert own.encode(texts) == library.encode(texts)
    plain = [" ".join("".join(rng.choice("aabcdeehiinorst") for _ in range(rng.randint(3, 9))) for _ in range(60)) for _ in range(300)]
    alone.clear()
    assert own.encode(plain) == library.encode(plain)
    assert len(alone) < 1000 < len({w for t in plain for w in t.split()})


def test_workers_forget_words(spark):
    """A worker that goes on to other tasks holds no words of those that it has done."""
    docs = spark.createDataFrame([(i, f"some words and number{i} more") for i in range(40)], "doc_id long, text string").repartition(4)
    assert sc.piece_digests(docs, MODEL).count() == 40

    def held(frames):
        for _ in frames:
            pass
        known = [len(c.merges.known) + len(c.merges.old) for c in sc._codecs.values() if c.merges]
        yield pd.DataFrame({"n": pd.Series(known, dtype="int64")})

    words = [r.n for r in docs.mapInPandas(held, "n long").collect()]
    assert words and not any(words)
