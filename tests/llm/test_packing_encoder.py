"""op8_packing fails the check: op8's ids come from a pattern without look-ahead; they must be those of the tokenizer file."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from termlens.llm import op08_packing as o8


def test_encoder_pattern_has_no_look_ahead_and_gives_the_same_ids():
    slow = o8._tokenizer(o8.TOKENIZER)
    fast = o8.encoder(o8.Tokens.of())
    assert "(?!" not in fast.fast._pat_str
    rng = random.Random(7)
    signs = [*(" " * 6), *"ab'stZ9.,!\n\t\r\x0b\x1c\x1f\x85\xa0 　​́é中😀", "'s", "'ll", " \n"]
    texts = ["", " ", "  ", "a  b", "a \n\nb", "\n \n", "a　 b", *("".join(rng.choices(signs, k=rng.randint(0, 14))) for _ in range(3000))]
    runs = pc.match_substring_regex(pa.array(texts), o8.RUN).to_pylist()
    assert 0 < sum(runs) < len(texts)
    for text, meets in zip(texts, runs, strict=True):
        want = slow.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(fast(text), fast.about.kind).tolist() == want
        assert fast(text, meets) == fast(text)
