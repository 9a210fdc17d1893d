import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from factloom.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_odd_rows_equal_the_library(docs, odd):
    rows = [*odd, (8, "▁ already ▁▁ there"), (9, "日本語 𝔡 \x00 tab\tand\r\nline"), (10, "  two  spaces  "), (11, "long " * 20000)]
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = pieces.encode(docs(*rows), MODEL).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want[i] = (ids, sp.decode(ids))
    for r in got:
        assert (r["ids"], r["decoded"]) == want[r["doc_id"]]
    assert pieces.encode(docs(), MODEL).count() == 0


@pytest.mark.parametrize("text", ["plain words here", "  two  spaces ", "日本語 and 𝔡", "tab\tand\nline", "▁ x"])
def test_spans_are_the_library_s(text):
    e = pieces.encoder(MODEL)
    _, spans = e.encode(text)
    proto = e.library.encode(text, return_type="proto")
    raw = text.encode()
    # Byte pieces share one character: the library gives it to the last of them; the bytes themselves are given here.
    for span, p in zip(spans[1:-1].tolist(), proto.pieces, strict=True):
        if not p.piece.startswith("<0x"):
            assert span == [p.begin, p.end]
    assert spans[0].tolist() == [0, 0] and spans[-1].tolist() == [len(raw)] * 2
    assert all(b == c for (_, b), (c, _) in zip(spans[1:-1].tolist(), spans[2:].tolist()))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "nfkc_cf", "identity"])
def test_normalisation_by_compiled_maps(rule):
    from sentencepiece import sentencepiece_model_pb2 as pb

    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    proto = pb.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    own = pieces.Normalizer(proto.normalizer_spec)
    for text in ["Ｈｅｌｌｏ　 Ｗorld", "  ﬁne ① ½  Å  ", "ｶﾞ㌔ ２", "", "   ", "a\tb​c", "ÄÖ ẞ Straße", "é é 한국 ㈱"]:
        normal, align = own.normalize(text.encode())
        assert normal.decode() == library.normalize(text)
        assert len(align) == len(normal) + 1 and (np.diff(align) >= 0).all() and align[-1] <= len(text.encode())


def test_query_digests(spark, docs, tmp_path):
    docs((1, "hello world"), (2, None)).write.parquet(f"{tmp_path}/documents.parquet")
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in pieces.query(spark, str(tmp_path)).collect():
        ids = sp.encode("hello world" if r["doc_id"] == 1 else "", add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
