"""Operator 11 against the sentencepiece library, on awkward texts, a hand-made model and the small table."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from millwright.llm import pieces, queries
from millwright.llm.common import table

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"
TEXTS = [
    None, "", " ", "   ", "a", " a", "a ", "▁", " ▁ a", "x ▁▁y", "héllo  wörld\n\n\tx", "漢字かな😀😀", "<s>", "<0x0A>", "\0a\0", "�", "a" * 5000, "ab" * 40 + " " + "é" * 33,
    "word " * 300_000, "the the THE theorem", "1234 567,890",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_texts_match_the_library(spark, library):
    rows = [(k, t, "e", "x", "y") for k, t in enumerate(TEXTS)] + [(None, "again", "e", "x", "y"), (3, "   ", "e", "x", "y"), (3, "other", "e", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string, unit string")
    got = pieces.decode(pieces.encode(docs, MODEL), MODEL).collect()
    want = sorted(((i, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t, *_ in rows), key=str)
    assert sorted(((r.doc_id, list(r.ids), r.decoded) for r in got), key=str) == want


def test_digest_of_the_small_table(spark, library):
    got = {r.doc_id: r for r in queries.op11_sentencepiece(spark, SMALL).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    docs = table(spark, SMALL, "documents").select("doc_id", "text").collect()
    assert len(docs) == len(got)
    for i, t in docs:
        ids = library.encode(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_agenda_and_matrix_agree_and_memory_is_bounded(library):
    rng = random.Random(3)
    vocab = pieces.Vocabulary(MODEL, room=50)
    units = sorted({"▁" * rng.randrange(1, 4) + "".join(rng.choice("etaoin é漢#́z") for _ in range(rng.randrange(1, 28))).replace(" ", "") for _ in range(3000)})
    flat, many = vocab.merge_many(units, 32)
    flat, at = flat.tolist(), [0, *many.cumsum().tolist()]
    assert [flat[a:b] for a, b in zip(at, at[1:])] == [vocab.merge(u) for u in units]
    for k in range(0, 3000, 300):
        texts = [u.replace("▁", " ") for u in units[k : k + 300]]
        ids, at = vocab.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == library.encode(texts)
        assert len(vocab.known) <= 50 + 300 * 5


def test_decoding_any_ids(spark, library):
    rng = random.Random(4)
    rows = [[rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(300) for _ in range(rng.randrange(7))] for _ in range(3000)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(rows)] + [(-1, None)], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in pieces.decode(df, MODEL).collect()}
    assert got.pop(-1) == "" and got == dict(enumerate(library.decode(rows)))


def model_file(tmp_path, fallback, mark_inside):
    """Three words, a user-defined and an unused piece; with ``mark_inside`` a piece that goes over a blank."""
    m = pb.ModelProto()
    m.trainer_spec.model_type = pb.TrainerSpec.BPE
    m.trainer_spec.byte_fallback = fallback
    m.normalizer_spec.name, m.normalizer_spec.remove_extra_whitespaces = "identity", False
    add = lambda p, s, t: m.pieces.add(piece=p, score=s, type=t)
    kind = pb.ModelProto.SentencePiece
    add("<unk>", 0, kind.UNKNOWN), add("<s>", 0, kind.CONTROL), add("</s>", 0, kind.CONTROL)
    if fallback:
        for k in range(256):
            add(f"<0x{k:02X}>", 0, kind.BYTE)
    names = ["ab", "bc", "abc", "▁a", "▁ab", "cab", *(["c▁", "bc▁a"] if mark_inside else []), "a", "b", "▁"]
    for k, p in enumerate(names):
        add(p, -float(k), kind.UNUSED if p == "abc" else kind.NORMAL)
    add("<tag>", 0, kind.USER_DEFINED)
    path = tmp_path / f"m{fallback}{mark_inside}.model"
    path.write_bytes(m.SerializeToString())
    return str(path)


@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize("mark_inside", [True, False])
def test_other_vocabularies(spark, tmp_path, fallback, mark_inside):
    path = model_file(tmp_path, fallback, mark_inside)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", "b", "c", " ", "<tag>", "q", "é"]) for _ in range(rng.randrange(14))) for _ in range(300)]
    got = pieces.decode(pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path), path).collect()
    assert {r.doc_id: list(r.ids) for r in got} == dict(enumerate(library.encode(texts)))
    assert {r.doc_id: r.decoded for r in got} == dict(enumerate(library.decode(library.encode(texts))))


def test_empty_table_and_wrong_kind(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.digest(pieces.decode(pieces.encode(none, MODEL), MODEL)).count() == 0
    m = pb.ModelProto()
    m.ParseFromString(open(MODEL, "rb").read())
    m.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    path = tmp_path / "u.model"
    path.write_bytes(m.SerializeToString())
    with pytest.raises(ValueError, match="merge-type"):
        pieces.Vocabulary(str(path))
