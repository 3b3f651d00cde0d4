"""Collocations against plain counting, with ranks for all words, for some and for none."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from salesprism.llm.collocations import _blocks, collocations
from salesprism.llm.pair_tiles import ID_BITS, count_pairs

SCHEMA = "doc_id bigint, lang string, text string, phrase string, n int"


def texts():
    rng = random.Random(3)
    words = ["New", "york", "city", "the", "é", "ab" * 40, "of", "a", "\x1c", "x\x0fy"]
    out = [(None, None), ("en", ""), ("en", " .. "), ("und", "new york city " * 12)]
    for i in range(60):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", "\n", "?!"]) for _ in range(80))
        out.append((("en", "fr", None)[i % 3], text + "the city of " * (i % 4)))
    return out + [("en", "rare pair " * 9), ("fr", "a a a a " * 20)]


def expected(top, cover=50):
    f, n = Counter(), Counter()
    for lang, text in texts():
        lang = lang or "und"
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for (lang, *w), a in f.items():
        if len(w) < 2 or a < 10:
            continue
        longer = [g for p, g in f.items() if p[0] == lang and len(p) == 4 and g >= 10 and len(w) == 2 and w in (list(p[1:3]), list(p[2:]))]
        if any(100 * g >= cover * a for g in longer):
            continue
        cuts = [(10**6 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, " ".join(w), a, f[lang, *w[:k]], f[lang, *w[k:]], n[lang], score))
    ranked = []
    for lang in n:
        rows = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(r[0], i, *r[1:]) for i, r in enumerate(rows[:top], 1)]
    return sorted(ranked)


@pytest.mark.parametrize("head, cells, top", [(1 << ID_BITS, 1 << 20, 2000), (9, 4, 2000), (9, 1, 7), (0, 1 << 20, 5)])
def test_op11_phrases(spark, head, cells, top):
    docs = spark.createDataFrame([(i, lang, t, "x", 1) for i, (lang, t) in enumerate(texts())], SCHEMA).repartition(5)
    got = collocations(docs, top=top, head=head, cells=cells).collect()
    assert sorted(tuple(r) for r in got) == expected(top)
    if top == 2000:
        assert len(got) > 50 and any(r.phrase.count(" ") == 2 for r in got)


def test_op11_empty_table(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations(spark.createDataFrame([(1, "en", None, "", 1)], SCHEMA)).count() == 0


def test_pairs_in_tiles():
    rng = np.random.default_rng(2)
    for size, scale in ((0, 1), (1, 1), (200_000, 60), (300_000, 4000)):
        a, b = (np.minimum(rng.exponential(scale, size).astype(np.int64), (1 << ID_BITS) - 1) for _ in "ab")
        b[: size // 50] = (1 << ID_BITS) - 1
        codes, counts = count_pairs(a, b)
        assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == Counter((a << ID_BITS | b).tolist())
        assert len(set(codes.tolist())) == len(codes)


def test_long_texts_are_cut_between_pieces():
    text = b"one two. three four, " * 50
    parts = list(_blocks([text, b"", b"tail"], 30))
    assert len(parts) > 10 and b"".join(parts).replace(b"..", b".").startswith(b"one two. three four,")
    want = [p.split() for p in re.split(b"[.,]", text + b".tail") if p.split()]
    assert [p.split() for part in parts for p in re.split(b"[.,]", part) if p.split()] == want
