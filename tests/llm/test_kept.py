"""A worker that goes on to another operator's tasks does not hold what the last one kept."""

import gc
import weakref

import public_tokenizers

from prospectry.llm import bpe, common


class Big:
    pass


def test_kept_until_another_is_kept_or_forgotten():
    one = weakref.ref(common.kept("one", Big))
    assert common.kept("one", Big) is one()
    two = weakref.ref(common.kept("two", Big))
    gc.collect()
    assert one() is None and two() is not None
    common.forget()
    assert two() is None


def test_tokenizer_is_given_up():
    path = public_tokenizers.path("word_bpe_49k.json")
    before = weakref.ref(bpe.loaded(path))
    assert bpe.loaded(path) is before()
    coded = before().encode("some words to remember")
    common.forget()
    assert before() is None and bpe.loaded(path).encode("some words to remember") == coded
    common.forget()
