"""Null and repeated ids, repeated rows, extra columns, empty tables, long texts, for each operator."""

import random
from collections import Counter

import public_tokenizers
import pytest

from salesprism.llm import decontaminate, html_text, packing, simhash, suffix_dedup, token_counts, warc
from salesprism.llm.suffix_dedup import remove_repeated_bytes

BPE = str(public_tokenizers.path("word_bpe_49k.json"))
SCHEMA = "doc_id bigint, text string, fp string, key string, row string, n_words string"


def docs_with(spark, rows):
    return spark.createDataFrame([(i, t, "f", "k", "r", "n") for i, t in rows], SCHEMA)


def test_op1_over_the_edge_of_a_piece(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_PIECE", 1 << 20)
    rng = random.Random(3)
    text = bytes(rng.choice(b"abcdefgh ") for _ in range((1 << 20) + 400)).decode()
    cut = (1 << 20) - 60
    docs = docs_with(spark, [(1, text), (2, "x" * 30 + text[cut : cut + 120] + "y" * 30), (3, "z" + text[-70:])])
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in remove_repeated_bytes(docs).collect()}
    assert got == {1: (0, 0), 2: (120, 1), 3: (70, 1)}


def test_op3_null_and_repeated_ids(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(None, f"a {item} b"), (None, None), (4, item), (4, "clean"), (4, item)]
    bench = spark.createDataFrame([(1, item, "x"), (1, item, "x"), (None, "clean", "y")], "item_id int, text string, fp string")
    out = decontaminate.matches(docs_with(spark, rows), bench).collect()
    assert Counter((r.doc_id, len(r.hits)) for r in out) == Counter([(None, 11), (None, 0), (4, 11), (4, 1), (4, 11)])


def test_op4_null_and_repeated_ids(spark):
    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    out = token_counts.token_counts(docs_with(spark, [(None, "a b"), (None, "a b"), (1, None), (1, "")]), path).collect()
    unknown = [r.n_tokens for r in out if r.doc_id is None]
    assert len(unknown) == 2 and unknown[0] == unknown[1] > 0 and [r.n_tokens for r in out if r.doc_id == 1] == [0, 0]


def test_op5_repeated_rows_and_very_long_pages(spark):
    long = "<article>" + "".join(f"<p>line {i}</p>" for i in range(60_000)) + "</article>"
    rows = [(1, "http://a/1", long), (1, "http://a/1", long), (None, None, "<p>x</p>"), (2, "http://a/1", "<article><p>Short</p></article>")]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id bigint, url string, html string, text string")
    out = html_text.main_text(pages).collect()
    sizes = Counter((r.page_id, r.text.count("\n") + 1 if r.text else 0) for r in out)
    assert sizes == Counter([(1, 60_000), (1, 60_000), (None, 1), (2, 1)])


def test_op6_null_page_ids_and_extra_columns(spark, tmp_path):
    pages = spark.createDataFrame([(None, "u", "a", "z"), (5, "u", "a", "z"), (None, "u", None, "z")], "page_id bigint, url string, html string, sha256 string")
    warc.write_archive(pages, str(tmp_path / "w"))
    assert sorted(bytes(r.payload) for r in warc.restore(spark, str(tmp_path / "w")).collect()) == [b"", b"a", b"a"]


def test_op7_null_and_repeated_rows(spark):
    docs = docs_with(spark, [(None, "one two"), (None, "one two"), (3, "x " * 400), (3, "x " * 400), (4, None)])
    out = packing.pack_documents(docs, BPE, length=64).collect()
    pieces = Counter((r.doc_id, r.piece) for r in out)
    assert pieces[None, 0] == 2 and pieces[3, 0] == 2 and pieces[4, 0] == 1
    for s in {r.sequence_id for r in out}:
        own = sorted((r.offset, r.length) for r in out if r.sequence_id == s)
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 64


@pytest.mark.parametrize("rows", [[(None, "a b c d"), (None, "A b  c d"), (7, "a b c d"), (7, "other words here now")], [(None, "a"), (None, "a")]])
def test_op8_null_and_repeated_ids(spark, rows):
    out = simhash.simhash_components(docs_with(spark, rows)).collect()
    same = {r.component_id for r in out if r.fp == out[0].fp}
    assert len(out) == len(rows) and len(same) == 1 and same <= {7, None}
