"""Columns with clashing names, every end of a loose phrase, wide strips, awkward headers."""

import random

import numpy as np
import pyarrow as pa

from salesprism.llm import decontaminate, quality, warc
from salesprism.llm.anchors import mix, runs
from salesprism.llm.line_dedup import drop_repeated_lines


def test_extra_columns_keep_their_values(spark):
    names = ["_id", "_text", "_lines", "_gone", "_in", "_kept", "_words", "_at", "x_length", "m_0", "d2", "lang_", "start_", "given_1"]
    line = "a line that stands in many documents"
    rows = [(i, f"{line}\nown {i} " + " ".join(f"w{i * k % 97}" for k in range(70)), "en", "s", *[f"{n}{i}" for n in names]) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))
    for out in (drop_repeated_lines(docs), quality.quality_rules(docs)):
        for r in out.collect():
            assert [r[n] for n in names] == [f"{n}{r.doc_id}" for n in names]
    assert {r.doc_id: r.n_dropped for r in drop_repeated_lines(docs).collect()} == {i: int(i < 5) for i in range(6)}


def test_null_ids_and_repeated_rows_of_lines(spark):
    line = "a line that stands in many documents"
    docs = spark.createDataFrame([(None, line), (None, line), (1, line), (1, line), (2, line + "\nx")], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.text) for r in drop_repeated_lines(docs).collect())
    assert got == [(0, ""), (0, ""), (1, ""), (1, ""), (2, line + "\nx")]


def test_every_end_of_a_loose_phrase():
    def near(words, terms, slop):
        segment = decontaminate.Segment.of([" ".join(words).encode()])
        return segment.near(segment.numbers(pa.array([t.encode() for t in terms], pa.binary())), slop).tolist()

    assert near("a b x b".split(), ["a", "b"], 2) == [[0, 2], [0, 4]]
    assert near("a b x b".split(), ["a", "b"], 1) == [[0, 2]]
    assert near(["a", "x", "a"], ["a"], 3) == [[0, 1], [2, 3]]
    rng = random.Random(5)
    for _ in range(200):
        words = [rng.choice("abcd") for _ in range(12)]
        terms, slop = [rng.choice("abc") for _ in range(rng.randrange(1, 4))], rng.randrange(4)
        if not set(terms) <= set(words):
            continue
        want = set()

        def grow(places, terms=terms, words=words, want=want, slop=slop):
            if len(places) == len(terms):
                if places[-1] - places[0] < len(terms) + slop:
                    want.add((places[0], places[-1] + 1))
                return
            for p in range(places[-1] + 1 if places else 0, len(words)):
                if words[p] == terms[len(places)]:
                    grow([*places, p])

        grow([])
        assert {tuple(x) for x in near(words, terms, slop)} == want


def test_runs_of_wide_windows():
    h = mix(np.array([random.Random(4).randrange(9) for _ in range(900)], np.uint64))
    for w in (65, 66, 100, 200):
        anchors, first, last = runs(h, w)
        bits = (64 + w - 2).bit_length()
        rank = h >> np.uint64(bits)
        for a, b, anchor in zip(first, last, anchors, strict=True):
            for s in range(a, b + 1):
                assert s + int(np.argmin(rank[s : s + w])) == anchor


def test_archive_of_addresses_like_headers(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/?X-Payload-SHA256: 0", "p"), (None, None, "p"), (2, "u", None)], "page_id bigint, url string, html string")
    warc.write_archive(pages, str(tmp_path / "w"))
    assert sorted(bytes(r.payload) for r in warc.restore(spark, str(tmp_path / "w")).collect()) == [b"", b"p", b"p"]
    warc.write_archive(pages.limit(0), str(tmp_path / "e"))
