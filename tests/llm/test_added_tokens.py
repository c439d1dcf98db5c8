from __future__ import annotations

import numpy as np

from quarrystone.llm.packing import Encoder, default_tokenizer


def test_added_tokens_get_the_ids_of_the_file():
    chosen = default_tokenizer()
    for t in (chosen, chosen._replace(ranks=None)):
        enc = Encoder(t)
        got = [np.frombuffer(raw, enc.dtype).tolist() for raw in enc.encode(["a b", "a <|endoftext|> b"])]
        assert got[1] == [64, 220, 50256, 275] and got[0] == [64, 275]
