"""The tokenizer remembers words compactly and hands its results on in bounded batches."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from prospectry.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_remembered_words_are_small():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(20_000)]
    coder = bpe.WordBpe(PATH)
    coder.encode("some words")
    tracemalloc.start()
    for word in words:
        coder.encode(word)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held / len(words) < 200


def test_decoded_text_follows_from_the_ids():
    library, coder = Tokenizer.from_file(PATH), bpe.WordBpe(PATH)
    for text in ["", "Two  words", "café, naïve\x7f!", "a<|endoftext|>b <|startoftext|>", "\x1cx\x1d y", "漢字 İσ", "   "]:
        ids, decoded = coder.encode(text)
        expected = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected
        assert decoded == library.decode(expected, skip_special_tokens=False)


def test_a_long_batch_goes_out_in_pieces(monkeypatch):
    class Frame:
        """Keeps the function that ``mapInArrow`` would send to workers."""

        sparkSession = None

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    monkeypatch.setattr(bpe, "bound_batches", lambda _: None)
    monkeypatch.setattr(bpe, "F", type("F", (), {"col": staticmethod(lambda _: Frame.Column())}))
    Frame.Column = type("Column", (), {"cast": lambda self, _: self, "alias": lambda self, _: self})
    texts = [None, "", *["some words of a text " * 20_000] * 6, "end"]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    out = list(bpe.encode_texts(Frame(), PATH)(iter([batch])))
    assert len(out) > 1 and max(b.nbytes for b in out) < 5 << 20
    rows = pa.Table.from_batches(out).to_pydict()
    assert rows["doc_id"] == list(range(len(texts)))
    coder = bpe.loaded(PATH)
    for ids, decoded, text in zip(rows["ids"], rows["decoded"], texts):
        assert (np.array(ids, "<u4").tobytes(), decoded) == coder.encode(text or "")
    assert not list(bpe.encode_texts(Frame(), PATH)(iter([batch.slice(0, 0)])))
