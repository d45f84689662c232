"""Units cut before line breaks and marks keep the tokenizer's ids."""
import random

import numpy as np
import pyarrow as pa

from postlens.llm import units
from postlens.llm.queries import tokenizer_path

PARTS = [" ", "  ", "\n", "\n\n", "a", "é", "'s", "'", "don't", "&&&", "$", "<|endoftext|>", "<|", "|>", "\t", "\xa0", "1", "99", "ß", "中", "…", "x", "The", ".", "\r", "\U0001f600", "ª"]


def test_ids_are_those_of_the_tokenizer():
    r, tok = random.Random(3), units.load_tokenizer(tokenizer_path())
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 14))) for _ in range(5000)]
    want = [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    keys = ["The", "x&&&", "\nThe", units.FIRST + "a"]
    hot = pa.table({"word": keys, "ids": pa.array(units.encode_units(tok, keys), pa.binary())})
    for table in (None, hot, hot.slice(0, 0)):
        enc = units.Encoder(tokenizer_path(), table, block_words=50)
        assert enc.ids(texts[:3000]) + enc.ids(texts[3000:]) == want and enc.ids([]) == []


def test_units_that_differ_in_marks_share_their_word():
    assert units.parts_finely(units.load_tokenizer(tokenizer_path()))
    got = [units.fine_parts(u) for u in units.split_units("end.\nnew end&&& new*** <|endoftext|>", True)]
    assert got == [["  end", "  ."], ["\nnew"], ["end", "  &&&"], ["new", "  ***"], ["<|endoftext|>"]]
