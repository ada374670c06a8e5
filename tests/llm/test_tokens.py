import random
import struct

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from docket.llm import pieces, sentencepiece_codec, token_counts

from .helpers import documents, odd_rows, prose

DATA = token_counts.model_bytes()
ORIGINAL = sentencepiece.SentencePieceProcessor(model_proto=DATA)
CODEC = sentencepiece_codec.Codec(DATA)
COUNT = token_counts.counter(DATA)
TEXTS = st.text(alphabet=st.sampled_from("ab cdeTh\n ▁.,é日𝄞\t0<s>x"), max_size=40)


def ids_of(text):
    import numpy as np

    return np.frombuffer(CODEC.encode([text])[0][0], "<i4").tolist()


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_ids_and_counts_equal_the_original_library(text):
    expect = ORIGINAL.encode(text)
    assert ids_of(text) == expect
    assert sum(map(COUNT.__getitem__, pieces.chunks(text))) == len(expect)
    assert CODEC.tokenizer.encode(text, add_special_tokens=False).ids == expect


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_decoding_gives_the_text_back(text):
    ids = CODEC.encode([text])[0][0]
    import numpy as np

    assert CODEC.decode([np.frombuffer(ids, "<i4").tolist()]) == [text.replace("▁", " ")] == [CODEC.encode([text])[0][2]]
    assert "".join(pieces.chunks(text)) == ("▁" + text.replace(" ", "▁") if text else "")


def test_model_file_fields():
    model = pieces.read_model(DATA)
    assert len(model.pieces) == ORIGINAL.get_piece_size() and model.kind == pieces.BPE and model.byte_fallback
    assert [p for p, _, _ in model.pieces[:3]] == [ORIGINAL.id_to_piece(i) for i in range(3)]
    assert all(abs(model.pieces[i][1] - ORIGINAL.get_score(i)) < 1e-6 for i in range(0, 32000, 997))
    assert pieces.separable(model)


def test_operators_over_odd_rows(spark):
    rows = odd_rows() + [(20, prose(3, 500)), (21, "<s> </s> <unk> <0x0A>")]
    docs = documents(spark, rows)
    counts = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, DATA, 100).collect()}
    expect = {(i, len((t or "").encode()), n := len(ORIGINAL.encode(t or "")), n > 100) for i, t in rows}
    assert counts == expect
    got = sentencepiece_codec.encode(docs, DATA).collect()
    assert sorted((r.doc_id or -1, list(r.ids)) for r in got) == sorted((i or -1, ORIGINAL.encode(t or "")) for i, t in rows)
    assert all(r.agrees and r.n_tokens == len(r.ids) for r in got)
    assert {r.doc_id for r in got if not r.restored} == {8}  # holds the mark itself
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, DATA), DATA).collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted((i or -1, (t or "").replace("▁", " ")) for i, t in rows)
    empty = documents(spark, [])
    assert token_counts.token_counts(empty, DATA).collect() == [] and sentencepiece_codec.digests(empty, DATA).collect() == []


def test_a_wrong_tokenizer_shows_in_ids_and_agreement():
    """Results are the rebuilt tokenizer's own: without its merges it gives other ids, and the comparison says so."""
    from tokenizers import models

    wrong = sentencepiece_codec.Codec(DATA)
    vocab = wrong.chunk_tokenizer.get_vocab()
    wrong.chunk_tokenizer.model = models.BPE(vocab=vocab, merges=[], unk_token="<unk>", fuse_unk=True, byte_fallback=True)
    ids, agrees, back = wrong.encode(["the house"])[0]
    assert len(ids) // 4 > len(ORIGINAL.encode("the house")) and not agrees and back == "the house"


def test_a_word_is_learnt_once_whatever_stands_behind_it():
    """Each word before four kinds of punctuation is one part, and many parts take one call of each library."""
    rng = random.Random(7)
    words = sorted({"".join(rng.choices("abcdefgh", k=9)) for _ in range(700)})
    texts = [" ".join(w + behind for w in words) for behind in (".", ",", "###", "%%%")]
    codec, calls = sentencepiece_codec.Codec(DATA), []
    learn = codec.original

    class Counted:
        def encode(self, *args, **more):
            calls.append(args)
            return learn.encode(*args, **more)

    codec.original = Counted()
    got = codec.encode(texts)
    assert [ids for ids, _, _ in got] == [struct.pack(f"<{len(x)}i", *x) for x in map(ORIGINAL.encode, texts)]
    assert all(same for _, same, _ in got) and [back for _, _, back in got] == texts
    assert len(codec.ids) < 2 * len(words) and len(calls) < 10


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(TEXTS, st.text(alphabet="ab .", min_size=70, max_size=90), st.text(max_size=30)), max_size=6))
def test_texts_side_by_side_keep_apart(texts):
    """Texts are cut and looked up together; empty ones, newlines at the edges and parts too long to be remembered too."""
    got = CODEC.encode(texts)
    assert [ids for ids, _, _ in got] == [struct.pack(f"<{len(x)}i", *x) for x in map(ORIGINAL.encode, texts)]
    assert all(same for _, same, _ in got) and [back for _, _, back in got] == [t.replace("▁", " ") for t in texts]


def test_parts_are_forgotten_and_learnt_again(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "REMEMBERED", 20)
    codec = sentencepiece_codec.Codec(DATA)
    for i in range(30):
        text = " ".join(prose(i % 7, 30).split()) + "\nx" * (i % 3)
        ids, same, back = codec.encode([text])[0]
        assert ids == struct.pack(f"<{len(x := ORIGINAL.encode(text))}i", *x) and same and back == text


def test_only_texts_with_a_lost_character_are_not_restored():
    """Without byte fallback a rare character is unknown: its text comes back otherwise and does not agree, the others do."""
    codec = sentencepiece_codec.Codec(DATA)
    codec.chunk_tokenizer.model.byte_fallback = False
    got = codec.encode(["the house", "a 𝄞 in it", "", "it"])
    assert [same for _, same, _ in got] == [True, False, True, True]
    assert [back for _, _, back in got] == ["the house", "a <unk> in it", "", "it"]


def unigram_model():
    """A model file of a few unigram pieces, written field by field."""
    def field(number, value):
        if isinstance(value, int):
            return bytes([number << 3, value])
        if isinstance(value, float):
            return bytes([number << 3 | 5]) + struct.pack("<f", value)
        return bytes([number << 3 | 2, len(value)]) + value

    pieces_ = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", -20.0, 6) for i in range(256)]
    pieces_ += [("▁", -3.0, 1), ("▁the", -2.0, 1), ("th", -4.0, 1), ("e", -3.5, 1), ("▁he", -3.2, 1), ("t", -5.0, 1), ("h", -5.0, 1), ("re", -3.0, 1), ("r", -6.0, 1)]
    body = b"".join(field(1, field(1, p.encode()) + field(2, score) + field(3, kind)) for p, score, kind in pieces_)
    return body + field(2, field(3, 1) + bytes([35 << 3 & 0x7F | 0x80, 35 << 3 >> 7, 1])) + field(3, field(3, 1) + field(4, 0) + field(5, 1))


def test_a_unigram_model(spark):
    data = unigram_model()
    original = sentencepiece.SentencePieceProcessor(model_proto=data)
    assert not pieces.read_model(data).kind == pieces.BPE
    texts = ["the there", "he  three", "", "x théé", "ere tht he"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(sentencepiece_codec.encode(docs, data).collect())
    assert [list(r.ids) for r in got] == [original.encode(t) for t in texts]
    assert all(r.agrees and r.restored for r in got)


def test_memo_keeps_two_generations():
    from docket.llm.common import Memo

    calls = []
    memo = Memo(lambda k: calls.append(k) or k * 2, 10)
    r = random.Random(1)
    assert all(memo[k] == 2 * k for k in (r.randint(0, 50) for _ in range(500)))
    assert len(memo) <= 10 and len(memo.old) <= 10
