"""The packing tokenizer's memory of words: what it holds is not learnt again, and its ids stay those of whole texts."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sparkevidence.llm.packing import WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_are_those_of_whole_texts_for_new_known_and_long_words():
    texts = ["", " \n", "Hello, hello HELLO?! hello,", "naïve Straße x1y ... a.b.c. " + "z" * 90 + " " + "z" * 90, "hello İstanbul $5 #tag# the end", "Hello,"]
    whole, words = Tokenizer.from_file(PATH), WordTokenizer(PATH)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in words.ids(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_half_a_million_words_are_learnt_once():
    words, learnt = WordTokenizer(PATH), []
    learn = words._learn
    words._learn = lambda new: learnt.extend(new) or learn(new)
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    texts = [" ".join(name(i) + "." * (1 + i // 26**4) for i in range(at, at + 1000)) for at in range(0, 500_000, 1000)]
    first = words.ids(texts)
    assert len(learnt) == 500_000 and words.ids(texts) == first and len(learnt) == 500_000
