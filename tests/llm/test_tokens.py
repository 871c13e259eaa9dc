"""Token counts of long unbroken texts: equal to the library's, in time that grows with the text."""

import random
import string
import time

import pytest

from signalloom.llm import tokens
from signalloom.llm.queries import tokenizer


@pytest.fixture(scope="module")
def model():
    return tokens.load(tokenizer("piece_bpe_32k.model"))


def random_text(seed, letters, n):
    rng = random.Random(seed)
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.mark.parametrize("seed", range(12))
def test_random_mixtures_at_small_chunks(model, seed):
    rng = random.Random(seed)
    parts = ["x" * rng.randint(1, 300), " " * rng.randint(1, 40), random_text(seed, string.ascii_letters + "+/", 200), "日本" * 30, "\n" * 50, "the words of a sentence, ", "é" * 70, "\U0001f600"]
    t = "".join(rng.choice(parts) for _ in range(40))
    for chunk, overlap in ((40, 3), (128, 16), (700, 64)):
        assert model.count(t, chunk, overlap) == len(model.sp.encode(t))


@pytest.mark.parametrize("unit", ["x", " ", "ab", "aB3+", "a ", "日本語", "é", "-", "\n"])
def test_long_runs(model, unit):
    for t in (unit * (60_000 // len(unit)), "Words before it. " * 2000 + unit * (60_000 // len(unit)) + " and words after." * 2000):
        assert model.count(t) == len(model.sp.encode(t))


def test_time_of_an_unbroken_run(model):
    t = "x" * 10_000_000
    began = time.process_time()
    want = len(model.sp.encode(t, num_threads=1))
    library = time.process_time() - began
    began = time.process_time()
    assert model.count(t) == want
    assert time.process_time() - began < 4 * library + 1
