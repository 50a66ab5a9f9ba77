"""Languages of texts far longer than the compressor's window."""

import random

from conftest import prose
from trackloom.llm import langid


def test_the_whole_of_a_long_text_has_a_say():
    rnd = random.Random(4)
    words = {n: [prose(rnd, n, 1).strip(".\n") for _ in range(3000)] for n in ("en", "de")}

    def text(lang, size):
        out = " ".join(rnd.choices(words[lang], k=size // 4))
        return out[:size]

    c = langid.Classifier([(n, langid.shape(text(n, 90_000))) for n in ("en", "de")])
    assert c.predict(text("de", 130_000) + " " + text("en", 1_000_000))[0] == "en"
    assert c.predict(text("en", 130_000) + " " + text("de", 1_000_000))[0] == "de"
    assert c.predict(text("en", 1_000_000))[::2] == ("en", True)


def test_short_texts_are_one_block():
    c = langid.Classifier([("en", b"some words of english"), ("de", b"ein paar deutsche worte")])
    assert c.sizes("some words") == [len(k.compress(b"some words")) for k in c.coders]
