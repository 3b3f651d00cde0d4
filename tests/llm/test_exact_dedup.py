"""Exact deduplication against grouping whole texts in Python."""

from collections import defaultdict

import pytest

from salesprism.llm.exact_dedup import exact_duplicates

SCHEMA = "doc_id bigint, text string, _key string, _Id int, kept string"


def judged(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return {(i, t or ""): (max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""])) for i, t in rows}


def rows():
    long = "é" * 300
    out = [(i, t) for i, t in enumerate([None, "", " ", "a", "a", "b", "ab", "ba", "ab", long, long, long + "x", long + "y", "A"])]
    out += [(100 + i, "copy " * 50) for i in range(60)]
    return out + [(7, "twice"), (7, "twice"), (None, "twice"), (None, "none"), (None, "none"), (3, "other"), (None, "single")]


@pytest.mark.parametrize("cells, heavy", [(1 << 20, 1000), (1, 3), (1, 1)])
def test_op12_groups(spark, cells, heavy):
    docs = spark.createDataFrame([(i, t, "k", 1, "x") for i, t in rows()], SCHEMA)
    out = exact_duplicates(docs, sieve_cells=cells, heavy=heavy, head_chars=3).collect()
    want = judged(rows())
    assert len(out) == len(rows())
    kept = defaultdict(int)
    for r in out:
        assert (r.keep_id, r.group_size) == want[r.doc_id, r.text or ""]
        assert (r["_key"], r["_Id"]) == ("k", 1)
        kept[r.text or ""] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1} and len(kept) == len({t or "" for _, t in rows()})


def test_op12_empty_table(spark):
    assert exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
