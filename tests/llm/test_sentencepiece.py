import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from pathloom.llm import sentencepiece_fst as fst

PATH = fst.default_model()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def same(text):
    ids = fst.Transducer.of(PATH).encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode(text)
    assert fst.Transducer.of(PATH).decode(ids) == LIBRARY.decode(LIBRARY.encode(text))


def test_documents(docs):
    for r in docs.collect():
        same(r["text"])


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_any_text(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.text("abe th,.'1 \n▁é漢", max_size=60))
def test_dense_texts(text):
    same(text)


def test_forgetting(monkeypatch):
    monkeypatch.setattr(fst, "REMEMBERED", 8)
    small = fst.Transducer(PATH)
    text = "many words go through a memory of eight words and are many words again"
    for _ in range(3):
        assert np.frombuffer(small.encode(text), "<u4").tolist() == LIBRARY.encode(text)


def test_columns(odd, none):
    rows = fst.with_text(fst.with_ids(odd)).collect()
    for r in rows:
        assert (r["ids"] is None) == (r["text"] is None)
        if r["text"] is not None:
            assert np.frombuffer(r["ids"], "<u4").tolist() == LIBRARY.encode(r["text"])
            assert r["decoded"] == r["text"].replace("▁", " ")
    assert all(r["restored"] for r in fst.with_digest(odd).collect())
    assert fst.with_digest(none).count() == 0


def test_normaliser_rewrites_the_longest():
    machine = fst.Normaliser({"a": "1", "abc": "2", "b": "a", "cd": ""}, before="^")
    assert machine.simple is None
    assert machine.compose("abcdabab xcd") == "^2d1a1a x"
    assert machine.compose("") == ""
    assert fst.Normaliser({" ": "_"}).compose("a b ") == "a_b_"
    own = fst.Transducer(PATH, {"ﬁ": "fi"})
    assert np.frombuffer(own.encode("ﬁne ﬁsh"), "<u4").tolist() == LIBRARY.encode("fine fish")


def test_shortest_path_by_all_paths():
    """All paths of the composed machines, their weights added up one by one: the least is the one that is found, and no other is finite."""
    t = fst.Transducer.of(PATH)
    rank = t.neighbours.rank
    for text in ("▁the", "▁▁an", "▁été", "▁x漢y", "thing", "▁inside"):
        found = []

        def go(i, ids, weight, last, text=text):
            if i == len(text):
                found.append((weight, ids))
            for j in range(i + 1, len(text) + 1):
                piece = text[i:j]
                if piece in rank and t.neighbours.merge(piece) == [piece] and (last is None or t.neighbours.merge(last + piece) == [
                    last,
                    piece,
                ]):
                    go(j, [*ids, t.names.index(piece)], weight + rank[piece], piece)
            if text[i : i + 1] and text[i] not in rank:
                go(i + 1, ids + [t.lexicon.byte_ids[b] for b in text[i].encode()], weight + t.lexicon.heavy, None)

        go(0, [], 0.0, None)
        ids, weight = t.shortest(text)
        assert [(weight, ids)] == found, text


def test_null_and_empty(spark, odd, none):
    rows = fst.with_text(fst.with_ids(odd)).collect()
    for r in rows:
        assert (r["ids"] is None) == (r["text"] is None)
        assert r["decoded"] == (None if r["text"] is None else r["text"].replace(fst.SPACE, " "))
    assert fst.with_digest(none).count() == 0
    assert fst.with_digest(odd).count() == 11
