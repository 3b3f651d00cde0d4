"""Distinct words of a batch become Python strings in one conversion."""

import time

import pyarrow as pa
from salesprism.llm.packing import strings_of


def test_odd_strings():
    for words in ([], [""], ["", "a", "", "é ü", "\u0085", "\x1c", ""], ["a"]):
        assert strings_of(pa.array(words, pa.large_string())) == words


def test_cost():
    words = pa.array([f"word{i}" for i in range(300_000)], pa.large_string())
    took = []
    for convert in (strings_of, lambda x: x.to_pylist()):
        start = time.process_time()
        assert len(convert(words)) == 300_000
        took.append(time.process_time() - start)
    assert took[0] < 0.5 * took[1]
