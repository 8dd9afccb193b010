"""The model's lists and filters: exact look-ups, and little disk."""

import numpy as np
import pytest

from prospectry.llm import ngram_lm
from prospectry.llm.elias_fano import EliasFano, load, narrow, save


@pytest.mark.parametrize("top", [300, 9_000, 1 << 20, 1 << 40, (1 << 62) + 5])
def test_access_and_find(tmp_path, top):
    rng = np.random.default_rng(top % 97)
    values = np.unique(np.concatenate([rng.integers(0, top, 6000), np.arange(64), [top - 1]]))
    EliasFano.of(values).save(str(tmp_path), "x")
    found = EliasFano.open(str(tmp_path), "x")
    places = rng.permutation(len(values))
    assert (found.access(places) == values[places]).all()
    assert (found.find(values[places]) == places).all()
    others = np.setdiff1d(np.concatenate([values + 1, rng.integers(0, 2 * top if top < 1 << 60 else top, 500), [-1]]), values)
    assert (found.find(others) == -1).all()


def test_mapped_arrays_are_plain(tmp_path):
    save(str(tmp_path), "a", np.arange(5))
    assert type(load(str(tmp_path), "a")) is np.ndarray


def test_numbers_are_kept_in_the_smallest_type():
    for values in ([0, 255], [1, 256], [70_000], [1 << 33], []):
        kept = narrow(np.array(values, np.int64))
        assert kept.tolist() == values
    assert narrow(np.array([3])).itemsize == 1 and narrow(np.array([70_000])).itemsize == 4


def test_filter_takes_a_byte_for_each_ngram_and_loses_none():
    rng = np.random.default_rng(2)
    first, second = rng.integers(0, 1 << 31, 5000), rng.integers(0, 1 << 31, 5000)
    bits = ngram_lm.filter_of(first, second)
    assert len(bits) == 5000 and ngram_lm.may_hold(bits, first, second).all()
    assert ngram_lm.may_hold(bits, first + 1, second).mean() < 0.2
    none = ngram_lm.filter_of(first[:0], second[:0])
    assert not ngram_lm.may_hold(none, first, second).any()
