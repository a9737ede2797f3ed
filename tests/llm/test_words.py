from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from vacantia.llm import words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aZ9 é\n\t,.#😀", max_size=30)), max_size=12)
RULES = [
    (words.PLAIN, r"[^\x20\x09-\x0D]+"),
    (words.LETTERS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"),
    (words.PIECES, r"[0-9A-Za-z\x80-\U0010FFFF]+|[!-/:-@\[-`{-~]+"),
]


@pytest.mark.parametrize("classes, pattern", RULES)
@settings(max_examples=60, deadline=None)
@given(texts=TEXTS, limit=st.integers(1, 40))
def test_words_equal_the_pattern(classes, pattern, texts, limit):
    seen: dict[str, int] = {}
    got = []
    for part in words.slices(pa.array(texts, pa.string()), limit):
        found = words.split_words(part, classes)
        data = part.data.tobytes()
        for i in range(part.rows):
            mine = slice(found.first[i], found.first[i + 1])
            pieces = [data[a:b].decode() for a, b in zip(found.start[mine], found.end[mine])]
            got.append(pieces)
            for piece, number in zip(pieces, found.hash[mine].tolist()):
                assert seen.setdefault(piece, number) == number
    assert got == [re.findall(pattern, text or "") for text in texts]
    assert len(set(seen.values())) == len(seen)


def test_runs_stay_in_rows():
    part = next(words.slices(pa.array(["a b c", None, "d", "e f"], pa.string())))
    found = words.split_words(part, words.PLAIN)
    assert words.within_rows(found.first, 2, len(found.hash)).tolist() == [True, True, False, False, True]
    assert len(np.unique(words.joined(found.hash, 2))) == 5
    assert words.joined(found.hash[:0], 0).tolist() == []


def test_sliced_column_and_no_rows():
    column = pa.array(["xx", "a b", "c"], pa.string()).slice(1)
    assert words.split_words(next(words.slices(column)), words.PLAIN).counts.tolist() == [2, 1]
    assert list(words.slices(pa.array([], pa.string()))) == []
