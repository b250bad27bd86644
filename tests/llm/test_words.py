import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from hornspark.llm import _words

from . import brute


@given(st.lists(st.text(alphabet="aB é\t\nx ", max_size=30), max_size=12), st.booleans(), st.integers(0, 3))
def test_words_and_ngrams(texts, fold, skip):
    column = pa.array(["skipped x"] * skip + texts, pa.string()).slice(skip)
    w = _words.words_of(column, fold)
    seen = {}
    for i, t in enumerate(texts):
        expected = brute.ws_words(brute.folded(t) if fold else t)
        assert [w.word(j).decode() for j in range(w.first[i], w.first[i + 1])] == expected
        for j, x in zip(range(w.first[i], w.first[i + 1]), expected):
            assert seen.setdefault(x, w.ids[j]) == w.ids[j]
    assert len(set(seen.values())) == len(seen)
    for k in (1, 3):
        grams = _words.ngrams(w.ids, k)
        assert len(set(zip(grams.tolist(), (tuple(w.ids[i : i + k]) for i in range(len(grams)))))) == len(set(grams.tolist()))


def test_chunks_do_not_change_hashes(monkeypatch):
    column = pa.array(["a bb ccc " * 40, "dddd" * 30, ""])
    whole = _words.words_of(column, False).ids
    monkeypatch.setattr(_words, "CHUNK", 5)
    assert (_words.words_of(column, False).ids == whole).all()


def test_sub_batches():
    b = pa.RecordBatch.from_arrays([pa.array(["aa", "b" * 9, "", "cc", "d"])], ["text"])
    assert [s.num_rows for s in _words.sub_batches(b, 2)] == [2, 2, 1]
    assert [s.num_rows for s in _words.sub_batches(b, 9, most_bytes=4)] == [1, 1, 3]
