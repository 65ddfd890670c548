"""Very long pieces: the same ids as the reference library, in steps by ranks and not by letters."""

import base64
import random
import time

import public_tokenizers
import pytest
import tiktoken

from cindersift.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_long_pieces():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["a" * n for n in (1, 2, 3, 4, 5, 7, 31, 20_000)] + ["".join(rng.choice(letters) for _ in range(n)) for letters in ("ab", "abcde", "etaoinshr", "-=", "ACGT", "é漢a") for n in (10, 1000, 5000)]
    texts += ["".join(rng.choice(["ing", "the", "er", "ation", "re"]) for _ in range(2000))]
    codec = bpe.Codec(open(PATH, "rb").read(), public_tokenizers.PATTERN)
    for t, ids in zip(texts, codec.encode(texts)):
        assert ids.tolist() == plain.encode_ordinary(t)


@pytest.mark.parametrize("letters", ["a", "ACGT", "="])
def test_a_million_letters(letters):
    rng = random.Random(2)
    text = "".join(rng.choice(letters) for _ in range(1_000_000))
    codec = bpe.Codec(open(PATH, "rb").read(), public_tokenizers.PATTERN)
    began = time.perf_counter()
    ids = codec.encode([text])[0]
    assert time.perf_counter() - began < 30
    assert codec.decode(ids.tolist()).decode() == text
