import random
import re

import numpy as np
import regex

from docpipe.llm.dac import ByteBpe
from docpipe.llm.queries import vocabulary


def test_parts_are_those_of_the_library():
    codec = ByteBpe(vocabulary("byte_bpe_50k.json"))
    for i in range(0x250):
        for kind, own in (("L", codec._LETTERS), ("N", codec._NUMBERS)):
            assert bool(regex.match(rf"\p{{{kind}}}", chr(i))) == bool(re.match(f"[{own}]", chr(i))), hex(i)
    rng, latin = random.Random(5), [chr(i) for i in range(0x250)]
    signs = [*"abcdeéñ", *"  \n '", *"'st've'll'd.,!12²½", *"Жあ€’“”​—́", *latin]
    codec._AT_ONCE, codec._HELD = 40, 500  # cuts and full tables
    for _ in range(4000):
        text = "".join(rng.choices(signs[: rng.choice([14, 32, 40, len(signs)])], k=rng.randint(1, 100)))
        text = codec._OTHER_WHITE.sub(" ", text) if rng.random() < 0.5 else text
        text += rng.choice(["", "", "", "<|endoftext|>b"])
        assert codec.encode([text])[0] == np.array(codec.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_runs_of_spaces_and_feeds_do_not_take_a_text_out_of_the_table():
    codec = ByteBpe(vocabulary("byte_bpe_50k.json"))
    texts = ["  one  two\n\n three (four). \n", "one two\n\nÉtat-major, l'été.\n"]
    want = [np.array(codec.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    whole, ids = [], codec._ids
    codec._ids = lambda text: whole.append(text) or ids(text)
    assert codec.encode(texts) == want
    assert whole == []
