"""Other splitting patterns, and white space inside and outside of brackets."""

import random

import public_tokenizers
import pytest
import tiktoken

from quarterline.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.mark.parametrize("pattern", [public_tokenizers.PATTERN, r"\p{L}+[\s]?|[^\s\p{L}]+\s*|\s+", r"[^\n]+|\n", r"\s*\S+\s*|\s+", r"[\p{L}\s]+|[^\p{L}\s]"])
def test_any_pattern_equals_the_library(pattern):
    encode, decode = bpe.codec(PATH, pattern)
    ref = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    rng = random.Random(4)
    parts = ["word", "a", " ", "  ", "\n", "\t", "é", "中", "\x1c", "\x85", "　", "12", "!", "'s", "the tion"]
    for _ in range(300):
        text = "".join(rng.choices(parts, k=rng.randint(0, 20)))
        ids = encode(text)
        assert list(memoryview(ids).cast("I")) == ref.encode_ordinary(text) and len(decode(ids)) <= len(text.encode())


def test_the_known_pattern_is_the_vocabularys():
    assert bpe.SPLITTING == public_tokenizers.PATTERN
    assert bpe._own_white(r"[^\s\]a]\s\\s") == rf"[^{bpe.WHITE}\]a][{bpe.WHITE}]\\s"
