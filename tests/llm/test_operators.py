"""Each operator against a brute-force version on a small table with the awkward rows."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from salesprism.llm import decontaminate, html_text, packing, quality, simhash, suffix_array, warc
from salesprism.llm.anchors import gram_hashes, mix, runs
from salesprism.llm.common import connected_components
from salesprism.llm.line_dedup import drop_repeated_lines
from salesprism.llm.substring_dedup import remove_repeated
from salesprism.llm.suffix_dedup import remove_repeated_bytes
from salesprism.llm.token_counts import counter, token_counts, vocabulary

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, row int"
BPE = str(public_tokenizers.path("word_bpe_49k.json"))


def texts():
    rng = random.Random(11)
    words = ["alpha", "béta", "Gamma,", "delta.", "x", "İota", "它", "eps"] + [f"w{i}" for i in range(60)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passage, line = prose(60), "A Line that many Documents hold"
    out = [None, "", " \n\t", "one", "a b", prose(400), passage, f"{prose(30)}\n{passage}\n{prose(20)}"]
    out += [f"{prose(60)}\n{line} \n{prose(5)}\n {line.upper()}" for _ in range(5)]
    out += [out[5], out[5], "z " * 120, "=" * 300, "=" * 120 + "q" + "=" * 90, prose(3000) + " " + passage]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", None)[i % 2], "s", len(t or ""), "clash", 7) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def split(s):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", s or "") if w]


def test_suffix_array_against_sorting():
    rng = random.Random(2)
    for _ in range(300):
        letters = rng.choice([b"a", b"ab", b"abcz"])
        spans = [bytes(rng.choice(letters) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 6))]
        s, _ = suffix_array.join(spans)
        plain = s.tolist()
        sa = suffix_array.suffix_array(s)
        assert sa.tolist() == sorted(range(len(plain)), key=lambda i: plain[i:])
        for k, common in enumerate(suffix_array.common_prefixes(s, sa), 1):
            a, b, n = plain[sa[k - 1] :], plain[sa[k] :], 0
            while n < min(len(a), len(b)) and a[n] == b[n] and a[n] > suffix_array.SEPARATOR:
                n += 1
            assert n == common


def test_runs_take_the_leftmost_least_gram():
    h = mix(np.array([random.Random(4).randrange(5) for _ in range(400)], np.uint64))
    anchors, first, last = runs(h, 18)
    rank = h >> np.uint64(7)
    for a, b, anchor in zip(first, last, anchors, strict=True):
        for s in range(a, b + 1):
            assert s + int(np.argmin(rank[s : s + 18])) == anchor
    units = mix(np.arange(50, dtype=np.uint64))
    assert (gram_hashes(np.concatenate([units, units]), 18)[:33] == gram_hashes(units, 18)).all()


def test_op1_removes_bytes_of_earlier_documents(docs, empty):
    got = {r.doc_id: r for r in remove_repeated_bytes(docs).collect()}
    seen = {}
    for i, t in enumerate(texts()):
        data = (t or "").encode()
        flags = bytearray(len(data))
        windows = [data[k : k + 50] for k in range(len(data) - 49)]
        for k, w in enumerate(windows):
            if seen.get(w, i) < i:
                flags[k : k + 50] = b"\1" * 50
        for w in windows:
            seen.setdefault(w, i)
        spans = sum(1 for k in range(len(flags)) if flags[k] and (k == 0 or not flags[k - 1]))
        kept = bytes(x for x, gone in zip(data, flags, strict=True) if not gone)
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (len(data), sum(flags), spans, kept)
    assert remove_repeated_bytes(empty).count() == 0


def test_op2_removes_words_of_repeated_windows(docs, empty):
    got = {r.doc_id: r for r in remove_repeated(docs).collect()}
    count = Counter()
    for t in texts():
        w = split(t)
        count.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    for i, t in enumerate(texts()):
        w = split(t)
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].text) == (len(w), sum(gone), kept)
    assert remove_repeated(empty).count() == 0


def test_rows_of_one_id_are_told_apart(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(1, long), (1, "x"), (1, long), (None, long), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    words = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in remove_repeated(docs).collect())
    assert words == [(0, 0, 0), (0, 50, 50), (1, 1, 0), (1, 50, 50), (1, 50, 50)]
    assert {r.n_removed for r in remove_repeated_bytes(docs).collect()} == {0}


def test_op3_phrases_and_proximity(spark, docs, empty):
    items = [(1, " ".join(texts()[6].split()[5:30])), (2, "ALPHA"), (3, "nowhere to be found"), (None, None), (1, "eps x")]
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = {r.doc_id: r for r in decontaminate.matches(docs, bench, segment_bytes=2000).collect()}
    blocks = {r.doc_id: r for r in decontaminate.matches(docs, bench, block_bytes=8).collect()}
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for name, t in items:
        w = pattern.findall(lower(t or ""))
        for k in range(max(1, len(w) - 9)) if w else []:
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(name))
    for i, t in enumerate(texts()):
        w = pattern.findall(lower(t or ""))
        hit, names = set(), set()
        for x, holders in windows.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    names |= holders
        for r in (got[i], blocks[i]):
            assert (r.n_words, r.hits, r.items) == (len(w), sorted(hit), sorted(names))
    assert decontaminate.matches(empty, bench).count() == 0
    assert decontaminate.matches(docs, bench.limit(0)).filter("size(hits) > 0").count() == 0
    segment = decontaminate.Segment.of([b"a x b y c", b"a b", b"c"])
    numbers = segment.numbers(pa.array([b"a", b"b", b"c"], pa.binary()))
    assert segment.near(numbers, 2).tolist() == [[0, 5]]
    assert segment.near(numbers, 1).tolist() == []


def test_op4_counts_like_the_tokenizer(docs, empty):
    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    whole = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary(path)], unk_id=0, byte_fallback=False))
    whole.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    got = {r.doc_id: r for r in token_counts(docs, path).collect()}
    for i, t in enumerate(texts()):
        ids = whole.encode(t or "").ids
        assert (got[i].n_tokens, got[i].n_unknown) == (len(ids), ids.count(0))
    for s in (" ", "  a", "a  b ", "▁x y", "日本😀😀 a😀", "a\nb"):
        assert counter(path).count(s)[0] == len(whole.encode(s).ids)
    assert token_counts(empty, path).count() == 0


def test_op5_main_text(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><nav>menu</nav><div class='ad'>buy</div>"
        "<article><h1>Top</h1><p>One &amp; <b>two<br><p>Three\n  four<script>var t='</p>'</script></article>"
        "<div id='comments'><p>nice</p></div><footer>&copy;</footer></body></html>"
    )
    plain = "<body><p>Site name<p>{}<p>All rights"
    rows = [
        (1, "http://a.example/x/1", page), (2, "http://a.example/x/2", page), (3, None, None), (4, "::", ""),
        (5, "http://b.example/n/1", plain.format("First story")), (6, "http://b.example/n/2", plain.format("Second story")),
        (7, "http://c.example/1", plain.format("Same")), (8, "http://c.example/2", plain.format("Same")),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    main = "Top\nOne & two\nThree four"
    assert got == {
        1: main, 2: main, 3: "", 4: "", 5: "First story", 6: "Second story",
        7: "Site name\nSame\nAll rights", 8: "Site name\nSame\nAll rights",
    }
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_op6_round_trip(spark, tmp_path):
    rows = [(3, "u", "same\r\n\r\nWARC/1.1"), (1, None, "same\r\n\r\nWARC/1.1"), (2, "u", None), (5, "u", ""), (4, "é", "é"), (4, "é", "é")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    warc.write_archive(pages, str(tmp_path / "w"))
    back = warc.restore(spark, str(tmp_path / "w")).collect()
    assert sorted((r.page_id, bytes(r.payload)) for r in back) == sorted((i, (h or "").encode()) for i, _, h in rows)
    assert {(r.page_id, r.record_type, r.refers_to) for r in back} == {
        (1, "response", None), (3, "revisit", 1), (2, "response", None), (5, "revisit", 2), (4, "response", None)
    }
    assert warc.read_payloads(spark, str(tmp_path / "w")).count() == 3
    digest = pages.select(warc.base32_sha1(warc.payload_bytes(F.col("html"))).alias("d"), "html").collect()
    assert all(r.d == base64.b32encode(hashlib.sha1((r.html or "").encode()).digest()).decode() for r in digest)


def test_op7_ids_and_sequences(docs, empty):
    whole = Tokenizer.from_file(BPE)
    rows = packing.pack_documents(docs, BPE, length=256).toPandas()
    pieces = {(r.doc_id, r.piece): r for r in rows.itertuples()}
    assert len(pieces) == len(rows)
    for i, t in enumerate(texts()):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 256)):
            part, r = ids[at : at + 256], pieces.pop((i, k))
            assert (r.start, r.length, r.ids_crc32) == (at, len(part), zlib.crc32(part.tobytes()))
    assert not pieces
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum()][:-1] and s.length.sum() <= 256
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 256) + 1
    assert packing.pack_documents(empty, BPE).count() == 0


def test_op7_chunks_encode_like_whole_texts():
    rng, encoder = random.Random(3), packing.ChunkEncoder(BPE)
    signs = "abzAZéÉßÿſŉİıĳĲ×÷ªµº09_'<|>-.,#*$%&`~{}[]@^\\\"/ \t\n ́中x\x1c\x85"
    found = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(3000)]
    found += ["<|endoftext|> A", "x <|STARTOFTEXT|>", "", None]
    for at in range(0, len(found), 500):  # slices of one array, as batches are
        part = found[at : at + 500]
        ids, offsets = encoder.encode(pa.array(found, pa.string()).slice(at, 500))
        for i, s in enumerate(part):
            assert encoder.tokenizer.encode(s or "", add_special_tokens=False).ids == ids[offsets[i] : offsets[i + 1]].tolist()


def test_op8_fingerprints_and_components(docs, empty):
    got = {r.doc_id: r for r in simhash.simhash_components(docs).collect()}
    prints = {}
    for i, t in enumerate(texts()):
        w = split(lower(t or ""))
        grams = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert got[i].fp % 2**64 == prints[i]
    for i in prints:
        group, grown = {i}, True
        while grown:
            more = {j for j in prints for k in group if (prints[j] ^ prints[k]).bit_count() <= 2}
            grown, group = more != group, more
        assert got[i].component_id == min(group)
    assert simhash.simhash_components(empty).count() == 0


@pytest.mark.parametrize("light", [64, 2])
def test_op8_links_are_complete(spark, light):
    rng = random.Random(6)
    values = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        values |= {x} | {x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(6)}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    fps = spark.createDataFrame([(v,) for v in values], "fp bigint")
    found = {r.node: r.label for r in connected_components(simhash.links(fps, len(values), light=light)).collect()}
    for v in values:
        group, grown = {v}, True
        while grown:
            more = {u for u in values for g in group if ((u ^ g) % 2**64).bit_count() <= 2}
            grown, group = more != group, more
        assert found.get(v, v) == min(group)


def test_op9_statistics_and_planted_junk(spark, docs, empty):
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    for i, t in enumerate(texts()):
        w, r = split(t), got[i]
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        count = Counter(grams)
        covered = {k + d for k, g in enumerate(grams) if count[g] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if split(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    assert quality.quality_rules(empty).count() == 0
    rng = random.Random(8)
    rows = [(i, " ".join(f"{rng.choice('abcdef') * rng.randrange(2, 8)}{k}" for k in range(rng.randrange(60, 300))), "en", "s") for i in range(200)]
    rows += [(1000 + i, " ".join(f"w{rng.randrange(10**6)}###" for _ in range(100)), "en", "s") for i in range(20)]
    judged = quality.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"))
    assert {r.doc_id for r in judged.filter("NOT kept").collect()} == set(range(1000, 1020))


def test_op10_lines(docs, empty):
    got = {r.doc_id: r for r in drop_repeated_lines(docs).collect()}
    held = {}
    for i, t in enumerate(texts()):
        for x in (t or "").split("\n"):
            key = lower(x.strip(" \t\n\x0b\f\r"))
            if len(key) >= 20:
                held.setdefault(key, set()).add(i)
    for i, t in enumerate(texts()):
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(h := held.get(lower(x.strip(" \t\n\x0b\f\r")), ())) >= 3 and max(h) != i)]
        assert (got[i].n_lines, got[i].n_dropped, got[i].text) == (len(lines), len(lines) - len(kept), "\n".join(kept))
        assert got[i]["n_words"] == "clash"
    assert drop_repeated_lines(empty).count() == 0


def test_pipeline_stages(spark, docs, empty, tmp_path):
    import corpus_pipeline as p

    bench = spark.createDataFrame([("b", "w1 w2 nowhere")], "item_id string, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (docs, empty):
        for name, stage in p.STAGES[:-1]:
            table = stage(spark, table, str(tmp_path))
            assert table.columns == list(p.COLUMNS), name
        p.STAGES[-1][1](spark, table, str(tmp_path)).count()
    kept = {r.doc_id for r in p.quality(spark, docs, "").collect()}
    assert kept == {r.doc_id for r in quality.quality_rules(docs).filter("kept").collect()}
    same = spark.createDataFrame([(2, "a b c d", "en", "s", 7), (1, "A b  c d", "en", "s", 8), (None, "q", "", "", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert {r.doc_id for r in p.near_duplicates(spark, same, "").collect()} == {1, None}


def test_pipeline_keeps_one_of_each_linked_group(spark):
    import corpus_pipeline as p

    rng = random.Random(12)
    rows = []
    for i in range(40):
        words = [f"v{rng.randrange(400)}" for _ in range(rng.randrange(3, 300))]
        rows.append(" ".join(words))
        for _ in range(3):
            words[rng.randrange(len(words))] = f"u{i}"
            rows.append(" ".join(words))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate([*rows, None, "", " "])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    first = {r.component_id for r in simhash.simhash_components(docs).collect()}
    assert [r.doc_id for r in p.near_duplicates(spark, docs, "").orderBy("doc_id").collect()] == sorted(first)
    assert 40 <= len(first) < len(rows) - 10


@pytest.mark.parametrize("bits", [0, 3, 12])
def test_links_of_any_radius_in_crowded_cells(spark, bits):
    rng = random.Random(9)
    values = {0}
    for _ in range(40):
        x = rng.getrandbits(64) if rng.random() < 0.3 else rng.choice(sorted(values))
        for _ in range(8):
            y = x
            for _ in range(rng.randrange(8)):
                y ^= 1 << rng.randrange(64)
            values.add(y)
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    fps = spark.createDataFrame([(v,) for v in values], "fp bigint")
    found = simhash.links(fps, len(values), bits, light=2).collect()
    pairs = {(a, b) for a in values for b in values if a < b and ((a ^ b) % 2**64).bit_count() <= bits}
    assert {(r.src, r.dst) for r in found} == pairs and len(found) == len(pairs)


def test_pipeline_keeps_unlinked_rows_of_one_id(spark):
    import corpus_pipeline as p

    rng = random.Random(14)
    a, b, c, d, e, f = (" ".join(f"{x}{rng.randrange(1000)}" for _ in range(80)) for x in "abcdef")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, d), (3, d), (None, e), (None, f), (None, c), (None, f)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = Counter((r.doc_id, r.text) for r in p.near_duplicates(spark, docs, "").collect())
    assert got == Counter([(1, a), (2, b), (3, c), (3, d), (None, e), (None, f)])


def test_op9_rejects_a_third_of_junk(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"{rng.choice('abcdef') * rng.randrange(2, 8)}{k}" for k in range(rng.randrange(60, 300))), "en", "s") for i in range(200)]
    rows += [(1000 + i, " ".join(f"w{rng.randrange(10**6)}###" for _ in range(100)), "en", "s") for i in range(100)]
    judged = quality.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"))
    assert {r.doc_id for r in judged.filter("NOT kept").collect()} == set(range(1000, 1100))
