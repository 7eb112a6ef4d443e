"""Packing's store of chunks: a text's unknown chunks are encoded in one call, with the same ids."""

import numpy as np

from apisieve.llm import packing, queries
from apisieve.llm.chunks import Chunks

TEXTS = ["", "one", " lead", "it's 42 été naïve\nline two <|endoftext|> end", "a  b", "a b ", "tab\there x\n\ny z", "日本 語 \U0001f600 x", "w" * 80 + " " + "w" * 80 + " v", "a b a b c"]


def test_ids_are_the_encoders_for_any_text_and_store():
    encode, leads = packing.json_encoder(queries.tokenizer("byte_bpe_50k.json"), queries.pattern())
    rng = np.random.default_rng(3)
    some = ["".join(chr(c) for c in rng.choice([32, 32, 97, 98, 39, 115, 10, 233, 0x1F600, 48, 33], 40)) for _ in range(300)]
    for most in (1, 20, 1000):
        chunks = Chunks(encode, leads, most)
        for text in [*TEXTS, *some, *TEXTS]:
            ids = chunks.ids(text)
            assert ids.dtype == np.uint32 and ids.tolist() == encode(text)


def test_unknown_chunks_of_a_text_share_a_call():
    encode, leads = packing.json_encoder(queries.tokenizer("byte_bpe_50k.json"), queries.pattern())
    calls = []
    chunks = Chunks(lambda text: calls.append(text) or encode(text), leads, 1000)
    text = " ".join(f"word{k}" for k in range(200))
    assert chunks.ids(text).tolist() == encode(text) and len(calls) == 2
    assert chunks.ids(text).tolist() == encode(text) and len(calls) == 3
