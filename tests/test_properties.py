"""Properties that hold for any input."""

from hypothesis import given, settings
from hypothesis import strategies as st

from palaver.functions.numbers import numbers_in
from palaver.operators.audio import voiced
from palaver.operators.scoring import align_counts
from palaver.sources.formats import decode_wav, encode_wav

words = st.lists(st.sampled_from("abc"), max_size=12)


@given(words, words)
def test_alignment_is_a_distance(a, b):
    s, d, i = align_counts(a, b)
    assert s + d + i == _distance(a, b) and len(a) - d + i == len(b)


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@given(st.text(max_size=80))
def test_numbers_are_sorted_and_found_again(text):
    found = numbers_in(text)
    assert found == sorted(found) and numbers_in(" , ".join(map(str, found))) == found


@settings(deadline=None)
@given(st.lists(st.floats(-1, 1), max_size=50))
def test_wav_keeps_samples(samples):
    import numpy as np

    x = np.array(samples, float)
    assert np.abs(decode_wav(encode_wav(x, 8000)) - x).max(initial=0) < 1e-3
    assert len(voiced(x, 4, 0.0, 0, 0)) == len(x)
