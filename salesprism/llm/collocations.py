"""Phrase collocations: ranked ids, pairs counted in tiles, frequent pairs ranked and paired again."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesprism.llm.anchors import mix
from salesprism.llm.common import read, written
from salesprism.llm.exact_dedup import SIEVE_CELLS, WORD_BITS, sieve
from salesprism.llm.pair_tiles import ID_BITS, count_codes, count_pairs

MIN_COUNT = 10
TOP = 2000
HEAD_WORD_BYTES = 64
CHUNK_BYTES = 1_000_000
FLUSH_TOKENS = 1_000_000
FLUSH_WORDS = 200_000
BATCH_ROWS = 100_000
KEY_MASK = (1 << 63) - 1
BREAK, UNKNOWN, TAIL = -1, -2, -3
# The characters that end a piece, and the blanks that end a word inside one.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
WORD_ENDS = b"\x20\x09"
_MARK = b"."
_TABLE = bytes.maketrans(PIECE_ENDS + WORD_ENDS, _MARK * len(PIECE_ENDS) + b" " * len(WORD_ENDS)).lower()
_END = re.compile(b"[" + re.escape(PIECE_ENDS) + b"]")


def _blocks(texts: list[bytes], most: int) -> Iterator[bytes]:
    """The texts, joined to blocks of about ``most`` bytes; long ones are cut where a piece ends."""
    block, total = [], 0
    for text in texts:
        at = 0
        while at < len(text):
            end = _END.search(text, at + most) if len(text) - at > most else None
            part = text[at : end.end() if end else len(text)] if at or end else text
            at += len(part)
            block.append(part)
            total += len(part)
            if total >= most:
                yield _MARK.join(block)
                block, total = [], 0
    if block:
        yield _MARK.join(block)


def _tokens(batches: Iterator[pa.RecordBatch], most: int = CHUNK_BYTES) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, words) of many texts at a time, a mark between pieces."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        codes = langs.indices.to_numpy()
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            texts = batch.column(1).take(pa.array(np.flatnonzero(codes == code))).to_pylist()
            for block in _blocks(texts, most):
                yield lang, block.translate(_TABLE).replace(_MARK, b" . ").split()


def _sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, BATCH_ROWS):
        yield batch.slice(at, BATCH_ROWS)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = defaultdict(Counter)

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counter in counts.items():
            words = pa.array(counter.keys(), pa.binary()).cast(pa.string())
            yield from _sliced(pa.RecordBatch.from_arrays(
                [pa.array([lang]).take(pa.array(np.zeros(len(words), np.int32))), words, pa.array(counter.values(), pa.int64())],
                ["lang", "word", "n"],
            ))
        counts.clear()

    for lang, tokens in _tokens(batches):
        counts[lang].update(tokens)
        counts[lang].pop(_MARK, None)
        if sum(map(len, counts.values())) > FLUSH_WORDS:
            yield from flush()
    yield from flush()


def _head(counted: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The most frequent rows of ``counted`` (column f), at most ``most``, and whether these are all.

    Whole classes of about equal frequency are taken, so which rows they are depends on nothing else.
    """
    kind = F.floor(F.log2("f") * 8).cast("int")
    classes = counted.groupBy(kind.alias("kind")).count().orderBy(F.desc("kind")).collect()
    total, lowest = 0, None
    for c in classes:
        total += c["count"]
        if total > most:
            break
        lowest = c.kind
    whole = total <= most
    return counted.filter(F.lit(False) if lowest is None else kind >= lowest), whole


class Sieve:
    """A table of ``sieve`` as one array; tells which keys may be in it."""

    def __init__(self, keys: DataFrame, cells: int):
        table, self.cells = sieve(keys, "key", cells)
        found = table.toArrow()
        self.words = np.zeros(self.cells, np.uint64)
        self.words[found.column("cell").to_numpy()] = found.column("word").to_numpy().view(np.uint64)

    def hits(self, keys: np.ndarray) -> np.ndarray:
        keys = keys & np.uint64(KEY_MASK)
        cell = (keys % np.uint64(self.cells)).astype(np.int64)
        return (self.words[cell] >> (keys // np.uint64(self.cells) % np.uint64(WORD_BITS)) & np.uint64(1)) == 1


def _text_keys(phrases: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(p, 42) for p in phrases), np.uint64, len(phrases))


def _pair_keys(codes: np.ndarray, lang: int) -> np.ndarray:
    return mix(codes.astype(np.uint64) ^ (np.uint64(lang) << np.uint64(2 * ID_BITS)))


class Vocabulary:
    """The frequent words of each language as ranks, and the sieve of those that have none."""

    def __init__(self, words: DataFrame, most: int, cells: int):
        head, whole = _head(words.filter(F.octet_length("phrase") <= HEAD_WORD_BYTES), most)
        table = head.select("lang", F.col("phrase").cast("binary").alias("word"), "f").toArrow()
        ranked: dict[str, list[tuple[int, bytes]]] = defaultdict(list)
        for lang, word, f in zip(*(table.column(i).to_pylist() for i in range(3)), strict=True):
            ranked[lang].append((-f, word))
        self.langs = sorted(ranked)
        self.words = [[w for _, w in sorted(ranked[lang])] for lang in self.langs]
        long = words.filter(F.octet_length("phrase") > HEAD_WORD_BYTES)
        self.tail = None
        if not whole or not long.isEmpty():
            key = (F.xxhash64(F.col("phrase")).bitwiseAND(F.lit(KEY_MASK))).alias("key")
            rest = words.join(F.broadcast(head.select("lang", "phrase")), ["lang", "phrase"], "left_anti")
            self.tail = Sieve(rest.select(key), cells)

    def lookups(self) -> dict[str, tuple[int, dict[bytes, int]]]:
        return {
            lang: (k, {_MARK: BREAK} | {w: i for i, w in enumerate(words)})
            for k, (lang, words) in enumerate(zip(self.langs, self.words, strict=True))
        }

    def ids(self, tokens: list[bytes], lookup: dict[bytes, int]) -> np.ndarray:
        ids = np.fromiter(map(lookup.get, tokens, repeat(UNKNOWN)), np.int32, len(tokens))
        unknown = np.flatnonzero(ids == UNKNOWN)
        if self.tail is None or not len(unknown):
            ids[unknown] = BREAK
        else:
            hit = self.tail.hits(_text_keys([tokens[i] for i in unknown]))
            ids[unknown] = np.where(hit, TAIL, BREAK)
        return ids


class Units:
    """The most frequent pairs of each language as ranks, and the sieve of all frequent pairs."""

    def __init__(self, pairs: DataFrame, most: int, cells: int):
        self.sieve = Sieve(pairs.select("key"), cells)
        head, _ = _head(pairs.filter("code IS NOT NULL"), most)
        table = head.select("lang_id", "code", "f").toArrow()
        lang, code, f = (table.column(i).to_numpy() for i in range(3))
        self.codes, self.ranks, self.by_rank = {}, {}, {}
        for k in np.unique(lang).tolist():
            own = lang == k
            order = np.lexsort((code[own], -f[own]))
            self.by_rank[k] = code[own][order]
            place = np.argsort(self.by_rank[k])
            self.codes[k], self.ranks[k] = self.by_rank[k][place], place

    def rank(self, lang: int, codes: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for those without."""
        known = self.codes.get(lang)
        if known is None or not len(known):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        return np.where(known[at] == codes, self.ranks[lang][at], -1)


COUNTS = "lang string, lang_id int, unit boolean, code bigint, phrase string, n bigint"


def _batch(lang, lang_id, unit, code, phrase, n) -> pa.RecordBatch:
    size = len(n)
    columns = [
        pa.nulls(size, pa.string()) if lang is None else pa.array([lang]).take(pa.array(np.zeros(size, np.int32))),
        pa.array(np.full(size, lang_id, np.int32)),
        pa.array(np.full(size, unit)),
        pa.nulls(size, pa.int64()) if code is None else pa.array(code),
        pa.nulls(size, pa.string()) if phrase is None else pa.array(phrase, pa.binary()).cast(pa.string()),
        pa.array(n, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in COUNTS.split(", ")])


def _phrase_counter(vocabulary, units):
    """Counts phrases of two words, or of three if ``units`` are given, over the texts of a task."""
    size = 2 if units is None else 3

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary.value
        pairs = None if units is None else units.value
        lookups = words.lookups()
        held: dict[int, list[np.ndarray]] = defaultdict(list)
        waiting = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                ids = np.concatenate(parts)
                a, b = ids[:-1], ids[1:]
                if pairs is None:
                    both = (a >= 0) & (b >= 0)
                    code, n = count_pairs(a[both], b[both])
                    yield from _sliced(_batch(None, lang, False, code, None, n))
                    continue
                code = np.where((a >= 0) & (b >= 0), a.astype(np.int64) << ID_BITS | b, -1)
                frequent = (code >= 0) & pairs.sieve.hits(_pair_keys(code, lang))
                at = np.flatnonzero(frequent[:-1] & frequent[1:])
                unit, third = pairs.rank(lang, code[at]), ids[at + 2]
                ranked = unit >= 0
                code_, n = count_pairs(unit[ranked], third[ranked])
                yield from _sliced(_batch(None, lang, True, code_, None, n))
                code_, n = count_codes(code[at[~ranked]] << ID_BITS | third[~ranked])
                yield from _sliced(_batch(None, lang, False, code_, None, n))
            held.clear()

        for lang, tokens in _tokens(batches):
            lang_id, lookup = lookups.get(lang, (-1, {_MARK: BREAK}))
            ids = words.ids(tokens, lookup)
            if words.tail is not None:
                found = Counter(_tail_phrases(tokens, ids, lang_id, size, pairs))
                if found:
                    yield from _sliced(_batch(lang, lang_id, False, None, list(found), list(found.values())))
            if lang_id >= 0:
                held[lang_id].append(np.append(ids, np.int32(BREAK)))
                waiting += len(ids)
            if waiting > FLUSH_TOKENS:
                yield from flush()
                waiting = 0
        yield from flush()

    return count


def _tail_phrases(tokens, ids, lang_id, size, pairs) -> list[bytes]:
    """The phrases with at least one word that has no rank, as texts."""
    usable = (ids >= 0) | (ids == TAIL)
    tail = ids == TAIL
    n = len(ids) - size + 1
    if n <= 0 or not tail.any():
        return []
    inside = np.logical_and.reduce([usable[k : k + n] for k in range(size)])
    inside &= np.logical_or.reduce([tail[k : k + n] for k in range(size)])
    starts = np.flatnonzero(inside)
    if size > 2:
        for k in (0, 1):  # both pairs inside must be frequent
            a, b = ids[starts + k], ids[starts + k + 1]
            ranked = (a >= 0) & (b >= 0)
            keys = _pair_keys(np.where(ranked, a.astype(np.int64) << ID_BITS | b, 0), max(lang_id, 0))
            plain = np.flatnonzero(~ranked)
            keys[plain] = _text_keys([b" ".join(tokens[i + k : i + k + 2]) for i in starts[plain]])
            starts = starts[pairs.sieve.hits(keys)]
    return [b" ".join(tokens[i : i + size]) for i in starts.tolist()]


def _decoder(vocabulary, units):
    """Gives counted codes their words again, and pairs the key their sieve is built from."""
    names = ["lang", "phrase", "f", "lang_id", "code", "key"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = vocabulary.value, None if units is None else units.value
        low = (1 << ID_BITS) - 1
        for batch in batches:
            lang, lang_id, unit, code, phrase, f = (batch.column(i).to_pylist() for i in range(6))
            keys = np.zeros(batch.num_rows, np.uint64)
            for i, k in enumerate(lang_id):
                if phrase[i] is not None:
                    keys[i] = xxhash.xxh64_intdigest(phrase[i].encode(), 42)
                    continue
                parts, rest = [code[i] & low], code[i] >> ID_BITS
                rest = int(pairs.by_rank[k][rest]) if unit[i] else rest
                parts = [rest >> ID_BITS, rest & low, *parts] if pairs else [rest, *parts]
                lang[i] = words.langs[k]
                phrase[i] = b" ".join(words.words[k][p] for p in parts).decode()
            coded = np.array([c is not None for c in code], bool)
            for k in set(lang_id):
                own = coded & (np.array(lang_id) == k)
                keys[own] = _pair_keys(np.array([c or 0 for c in code], np.int64)[own], max(k, 0))
            key = pa.array((keys & np.uint64(KEY_MASK)).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(f, pa.int64()),
                 batch.column(1), batch.column(3), key], names)

    return decode


def _frequent(docs: DataFrame, vocabulary, units, min_count: int) -> DataFrame:
    counted = docs.mapInArrow(_phrase_counter(vocabulary, units), COUNTS)
    keys = ["lang", "lang_id", "unit", "code", "phrase"]
    frequent = counted.groupBy(*keys).agg(F.sum("n").alias("f")).filter(F.col("f") >= min_count)
    frequent = frequent.mapInArrow(
        _decoder(vocabulary, units), "lang string, phrase string, f bigint, lang_id int, code bigint, key bigint"
    )
    return written(frequent, "pairs" if units is None else "triples")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in whole decimals; holds for counts below 10^13."""
    a, left, right = (c.cast("decimal(13,0)") for c in (a, left, right))
    return F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), left * right)


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 3,
                  min_count: int = MIN_COUNT, head: int = 1 << ID_BITS, cells: int = SIEVE_CELLS) -> tuple[DataFrame, DataFrame]:
    """Tables (lang, phrase, size, f) of the frequent phrases and (lang, n) of all words.

    Words are those of lower-cased (A-Z) texts between blanks, phrases lie within pieces. At most
    ``head`` words and ``head`` pairs, the most frequent, have ranks and are broadcast; phrases
    of all others are counted as texts or as codes of their words, none is left out.
    """
    if longest not in (2, 3):
        raise ValueError("phrases have two or three words")
    if head > 1 << ID_BITS:
        raise ValueError(f"ranks have {ID_BITS} bits")
    context = docs.sparkSession.sparkContext
    texts = docs.select(
        F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).cast("string").alias("lang"),
        F.col(f"`{text_col}`").cast("binary").alias("text"),
    ).filter(F.octet_length("text") > 0)
    words = texts.mapInArrow(_word_counts, "lang string, word string, n bigint")
    words = written(words.groupBy("lang", F.col("word").alias("phrase")).agg(F.sum("n").alias("f")), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    words = words.filter(F.col("f") >= min_count)
    vocabulary = context.broadcast(Vocabulary(words, head, cells))
    pairs = _frequent(texts, vocabulary, None, min_count)
    found = [words.withColumn("size", F.lit(1)), pairs.select("lang", "phrase", "f", F.lit(2).alias("size"))]
    if longest == 3:
        units = context.broadcast(Units(pairs, head, cells))
        triples = _frequent(texts, vocabulary, units, min_count)
        found.append(triples.select("lang", "phrase", "f", F.lit(3).alias("size")))
    table = found[0]
    for more in found[1:]:
        table = table.unionByName(more)
    return table, totals


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 3,
                 min_count: int = MIN_COUNT, cover: int = 50, top: int = TOP, head: int = 1 << ID_BITS,
                 cells: int = SIEVE_CELLS) -> DataFrame:
    """Per language the ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    A phrase of two to ``longest`` words occurring at least ``min_count`` times is scored at its
    weakest cut, floor(10^6 * a * a / (l * r)), ties at the earliest cut. A phrase inside a longer
    frequent one with at least ``cover`` percent of its occurrences is left out. Ties of score and
    count rank by phrase in byte order.

    Null texts are empty, a null language is ``und``; ids and other columns are not read, repeated
    rows count again, an empty table gives none. Very long texts are cut between pieces while
    they are read, which no phrase spans.

    Words are ranked by frequency, pairs of ranks counted per task in dense tiles or sorted runs
    and summed; then frequent pairs are ranked themselves and paired with the word behind them.
    """
    table, totals = phrase_counts(docs, lang_col, text_col, longest, min_count, head, cells)
    parts = F.split("phrase", " ")
    join = lambda start, length: F.array_join(F.slice(parts, start, length), " ")
    candidates = table.filter("size > 1").withColumnRenamed("f", "a")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"left": join(F.lit(1), F.col("k")), "right": join(F.col("k") + 1, F.col("size") - F.col("k"))})
    counted = table.select("lang", "phrase", "f")
    cuts = cuts.join(counted.toDF("lang", "left", "l"), ["lang", "left"]).join(counted.toDF("lang", "right", "r"), ["lang", "right"])
    weakest = F.min(F.struct(_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "size", "a").agg(weakest)
    if longest > 2:
        inside = table.filter("size = 3").select("lang", "f", F.explode(F.array(join(F.lit(1), F.lit(2)), join(F.lit(2), F.lit(2)))).alias("phrase"))
        covering = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
        scored = scored.join(covering, ["lang", "phrase"], "left").filter(
            F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a"))
        )
    scored = scored.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # Each of many parts of a language first gives its best, so no task orders them all.
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    best = scored.withColumn("turn", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("turn") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir):
    return collocations(read(spark, sf_dir, "documents").select("lang", "text"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(p) AS piece, generate_subscripts(p, 1) AS at
  FROM (SELECT doc_id, lang, string_split_regex(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents)),
split AS (SELECT lang, [x FOR x IN string_split_regex(piece, '[\x20\x09]+') IF x <> ''] AS w FROM pieces),
spots AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM split WHERE len(w) > 0),
grams AS (
  SELECT lang, s.size, array_to_string(w[i:i + s.size - 1], ' ') AS phrase
  FROM spots, (VALUES (1), (2), (3)) s(size) WHERE i + s.size - 1 <= len(w)),
freq AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
totals AS (SELECT lang, count(*) AS n FROM grams WHERE size = 1 GROUP BY lang),
cand AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM freq WHERE size > 1),
cuts AS (
  SELECT c.lang, c.size, c.phrase, c.a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp
  FROM cand c, (VALUES (1), (2)) t(k) WHERE k < c.size),
valued AS (
  SELECT c.*, x.f AS l, y.f AS r,
         CAST(CAST(a AS HUGEINT) * a * 1000000 // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts c JOIN freq x ON x.lang = c.lang AND x.phrase = c.lp JOIN freq y ON y.lang = c.lang AND y.phrase = c.rp),
weakest AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(w[p:p + 1], ' ') AS phrase, max(a) AS longer
  FROM cand, (VALUES (1), (2)) t(p) WHERE size = 3 GROUP BY ALL),
left_over AS (
  SELECT w.* FROM weakest w LEFT JOIN inside i ON i.lang = w.lang AND i.phrase = w.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 50 * w.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN totals t USING (lang) WHERE rank <= 2000
"""
