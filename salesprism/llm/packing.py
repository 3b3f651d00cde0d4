"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm.

The pieces are dealt to districts of bounded size. In each district islands evolve packings:
crossover injects whole well-filled bins of one parent into the other, removes bins that hold
injected pieces and puts the displaced ones back by best fit. Between epochs each island's
best packing migrates to the next island. Full bins of the best packing are final; what the
others hold is dealt to fewer districts in the next round.
"""

from __future__ import annotations

import random
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesprism.llm.common import chunks, read, written

LENGTH = 2048
END_ID = 0
DISTRICT = 2048  # pieces in a district, about
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 4
POPULATION = 4
ROUNDS = 8
CACHED_CHUNKS = 600_000
_BATCH_BYTES = 8 << 20


# Letters that lower-case to one letter and compose with nothing, then the chunks
# made of them, of digits and of signs that start no contraction and no special token.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įĲ-ſ"
_PLAIN = re.compile(rf"(?:[{_LETTERS}0-9!-&(-/:;=-@\[-`{{-~])+")
_PART = re.compile(rf"[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9\n]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [x for x in range(256) if x not in shown]
    return {x: chr(x) for x in shown} | {x: chr(256 + i) for i, x in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()
_NEWLINE = _BYTE_LETTERS[10]


def strings_of(column: pa.LargeStringArray) -> list[str]:
    """The strings of a column without line feeds: decoded as one text, which costs far less than each alone."""
    if not len(column):
        return []
    lines = pa.LargeListArray.from_arrays(pa.array([0, len(column)], pa.int64()), column)
    return pc.binary_join(lines, pa.scalar("\n", pa.large_string()))[0].as_py().split("\n")


class ChunkEncoder:
    """Token ids of texts by way of their distinct chunks between ASCII blanks.

    For byte-level tokenizers that lower-case, drop white space and never join characters across
    it, like the word vocabulary here, the ids of a text are those of its chunks. A batch is split
    and its distinct chunks are found by column; only chunks not met lately are encoded. A plain
    one falls into runs of letters, single digits and runs of signs, which recur more; those go
    to the vocabulary's merges directly, all others through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _learn(self, parts: list[str]) -> None:
        """Ids of parts that the pre-tokenizer leaves whole."""
        merge, pack = self.tokenizer.model.tokenize, struct.pack
        shown = "\n".join(parts).encode().decode("latin-1").translate(_BYTE_LETTERS).split(_NEWLINE) if parts else []
        for part, letters in zip(parts, shown, strict=True):
            found = [t.id for t in merge(letters)]
            self.parts[part] = pack(f"<{len(found)}I", *found)

    def _chunks(self, words: list[str]) -> list[bytes]:
        """The ids of distinct chunks."""
        if len(self.cache) > CACHED_CHUNKS:
            self.cache.clear()
        if len(self.parts) > CACHED_CHUNKS:
            self.parts.clear()
        cache, parts = self.cache, self.parts
        out = list(map(cache.get, words))
        new = [i for i, x in enumerate(out) if x is None]
        plain, other = [], []
        for i in new:
            (plain if _PLAIN.fullmatch(words[i]) else other).append(i)
        # One pass over all plain chunks: a line each, so a part never runs into the next chunk.
        split = [x.split() for x in _PART.sub(r"\g<0> ", "\n".join([words[i] for i in plain]).lower()).split("\n")] if plain else []
        self._learn(list({x for found in split for x in found if x not in parts}))
        for i, found in zip(plain, split, strict=True):
            out[i] = parts[found[0]] if len(found) == 1 else b"".join([parts[x] for x in found])
        for i, x in zip(other, self.tokenizer.encode_batch_fast([words[i] for i in other], add_special_tokens=False), strict=True):
            out[i] = np.array(x.ids, "<u4").tobytes()
        cache.update((words[i], out[i]) for i in new)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and where each text's begin and the last's end."""
        # A fresh array: lower-casing a cast slice reads the wrong bytes.
        texts = pa.array([t or "" for t in texts.to_pylist()], pa.large_string())
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # a special token's name keeps its case
            texts = pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        found = self._chunks(strings_of(coded.dictionary))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        table = np.frombuffer(b"".join(found), "<u4")
        starts = np.cumsum(sizes) - sizes
        codes = coded.indices.to_numpy()
        lengths = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = table[np.repeat(starts[codes] - ends[:-1], lengths) + np.arange(ends[-1])]
        offsets = lists.offsets.to_numpy()
        return ids, ends[offsets - offsets[0]]


@lru_cache(maxsize=1)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def token_pieces(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
    length: int = LENGTH, end_id: int = END_ID,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and the end id, cut at ``length``."""
    kind = dict(docs.dtypes)[id_col]
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            for a, b in chunks(pc.fill_null(pc.binary_length(column), 0).to_pylist(), _BATCH_BYTES):
                rows, numbers, starts, lengths, sums = [], [], [], [], []
                ids, offsets = encoder(tokenizer_path).encode(column.slice(a, b - a))
                for i, (first, stop) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    view = memoryview(ids[first:stop].tobytes() + end)
                    for number, at in enumerate(range(0, len(view), 4 * length)):
                        part = view[at : at + 4 * length]
                        rows.append(a + i)
                        numbers.append(number)
                        starts.append(at // 4)
                        lengths.append(len(part) // 4)
                        sums.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()),
                        pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64()),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


Packing = list[list[int]]


def best_fit(items: list[int], sizes: list[int], bins: Packing, capacity: int) -> Packing:
    """``bins`` with ``items`` put, in their order, each where it leaves the least room."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: a bin with room r
    for i, members in enumerate(bins):
        room = capacity - sum(sizes[x] for x in members)
        rooms[room].append(i)
        mask |= 1 << room
    for x in items:
        size = sizes[x]
        fits = mask >> size
        if fits:
            room = (fits & -fits).bit_length() - 1 + size
            i = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
            bins[i].append(x)
        else:
            room, i = capacity, len(bins)
            bins.append([x])
        rooms[room - size].append(i)
        mask |= 1 << (room - size)
    return bins


def fitness(bins: Packing, sizes: list[int], capacity: int) -> float:
    """Fewer bins first; of as many bins, the one that leaves its room in fewer of them."""
    fills = [sum(sizes[x] for x in b) / capacity for b in bins]
    return -len(bins) + sum(f * f for f in fills) / max(1, len(bins))


def crossover(a: Packing, b: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """Whole well-filled bins of ``b`` go into ``a``; pieces they displace are put back by best fit."""
    ranked = sorted(b, key=lambda x: -sum(sizes[i] for i in x))
    top = ranked[: max(1, len(ranked) // 2)]
    injected = [list(x) for x in top if rng.random() < 0.5] or [list(top[0])]
    taken = {i for x in injected for i in x}
    kept, displaced = [], []
    for members in a:
        if taken.isdisjoint(members):
            kept.append(list(members))
        else:
            displaced += [i for i in members if i not in taken]
    return best_fit(sorted(displaced, key=lambda i: (-sizes[i], i)), sizes, injected + kept, capacity)


def mutate(bins: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """Empties the worst-filled bins and a few others and puts their pieces back, nearly by size."""
    ranked = sorted(bins, key=lambda x: sum(sizes[i] for i in x))
    out = max(2, len(ranked) // 20)
    opened = ranked[:out] + [x for x in ranked[out:] if rng.random() < 0.05]
    closed = {id(x) for x in opened}
    loose = sorted((i for x in opened for i in x), key=lambda i: (-sizes[i] * rng.uniform(0.9, 1.1), i))
    return best_fit(loose, sizes, [list(x) for x in ranked if id(x) not in closed], capacity)


def evolve(sizes: list[int], start: list[Packing], capacity: int, seed: int, generations: int, population: int) -> Packing:
    """The best packing after some generations on one island."""
    rng = random.Random(seed)
    by_size = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    people = [p for p in start if p] or [best_fit(by_size, sizes, [], capacity)]
    least = -(-sum(sizes) // capacity)
    while len(people) < population:
        noisy = sorted(by_size, key=lambda i: -sizes[i] * rng.uniform(0.8, 1.2))
        people.append(best_fit(noisy, sizes, [], capacity))

    def rate(p):
        return fitness(p, sizes, capacity)

    people.sort(key=rate, reverse=True)
    for _ in range(generations):
        if len(people[0]) == least:
            break
        a, b = people[0], people[rng.randrange(1, len(people))] if len(people) > 1 else people[0]
        children = [crossover(a, b, sizes, capacity, rng), crossover(b, a, sizes, capacity, rng)]
        children.append(mutate(a, sizes, capacity, rng))
        people = sorted(people + children, key=rate, reverse=True)[:population]
    return people[0]


_ITEM = ["length", "doc_id", "piece", "start", "ids_crc32"]


def _island(capacity: int, epoch: int, generations: int, population: int, islands: int):
    """Of one island of one district: its pieces with their bin in the island's best packing.

    The rows of an epoch after the first stand once for each packing that came, with its bin.
    """
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["origin", *_ITEM, "bin"], ascending=[True, False, *[True] * 5], kind="stable")
        packings, one = [], None
        for _, part in rows.groupby("origin", sort=True):
            one = part if one is None else one
            if epoch:
                bins: dict[int, list[int]] = {}
                for i, x in enumerate(part["bin"].tolist()):
                    bins.setdefault(x, []).append(i)
                packings.append(list(bins.values()))
        sizes = one["length"].tolist()
        district, island = int(one["district"].iloc[0]), int(one["island"].iloc[0])
        best = evolve(sizes, packings, capacity, district * islands + island + 7919 * epoch, generations, population)
        place, fill, offset = [0] * len(sizes), [0] * len(sizes), [0] * len(sizes)
        for number, members in enumerate(best):
            at = 0
            for i in members:
                place[i], offset[i] = number, at
                at += sizes[i]
            for i in members:
                fill[i] = at
        return one.assign(bin=place, offset=offset, fill=fill, origin=island, fitness=fitness(best, sizes, capacity))

    return run


def _round(items: DataFrame, n: int, number: int, capacity: int, district: int, islands: int, epochs: int,
           generations: int, population: int) -> DataFrame:
    """``items`` with district, bin, offset and fill of the best island's packing."""
    kind = dict(items.dtypes)["doc_id"]
    districts = -(-n // district)
    schema = (
        f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, district bigint, island int, "
        "origin int, bin int, offset bigint, fill bigint, fitness double"
    )
    names = [x.split()[0] for x in schema.split(", ")]
    dealt = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.lit(number)), F.lit(districts))
    rows = items.select(
        "doc_id", "piece", "start", "length", "ids_crc32", dealt.alias("district"),
        F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"),
        F.lit(0).alias("origin"), F.lit(0).alias("bin"), F.lit(0).cast("long").alias("offset"),
        F.lit(0).cast("long").alias("fill"), F.lit(0.0).alias("fitness"),
    )
    for epoch in range(epochs):
        if epoch:  # each island's best also goes to the next island
            stay = F.struct(F.col("island").alias("i"))
            move = F.struct(((F.col("island") + 1) % islands).alias("i"))
            rows = rows.withColumn("to", F.explode(F.array_distinct(F.array(stay, move)))).withColumn("island", F.col("to.i")).select(*names)
        rows = rows.groupBy("district", "island").applyInPandas(
            _island(capacity, epoch, generations, population, islands), schema
        )
    rows = written(rows, "packed")
    best = written(
        rows.groupBy("district").agg(F.max(F.struct("fitness", (-F.col("island")).alias("i"))).alias("b"))
        .select(F.col("district").alias("of"), (-F.col("b.i")).alias("winner")),
        "winners",
    )
    return rows.join(best, (rows.district == best.of) & (rows.island == best.winner))


def pack(
    pieces: DataFrame,
    capacity: int = LENGTH,
    district: int = DISTRICT,
    islands: int = ISLANDS,
    epochs: int = EPOCHS,
    generations: int = GENERATIONS,
    population: int = POPULATION,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``pieces`` with sequence_id and offset: disjoint, gapless from 0, at most ``capacity``.

    A piece of full length is a sequence of its own. The others go through rounds of districts
    of about ``district`` pieces, whatever their number: bins without room are final, the rest
    is dealt anew while a round finishes a fair part of it. Pieces carry their columns, so equal rows
    (a document given twice) are packed as often as they stand. The result does not depend on
    partitions: districts are hashes of the pieces and islands have fixed seeds.
    """
    pieces = written(pieces, "pieces")
    full = pieces.filter(F.col("length") >= capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    done = [full]
    items = pieces.filter(F.col("length") < capacity)
    n = items.count()
    for number in range(rounds):
        if not n:
            break
        packed = _round(items, n, number, capacity, district, islands, epochs, generations, population)
        packed = written(
            packed.select(
                "doc_id", "piece", "start", "length", "ids_crc32", "offset", "fill",
                (F.lit(number * (1 << 58)) + F.col("district") * (1 << 20) + F.col("bin")).alias("sequence_id"),
            ),
            "round",
        )
        left = packed.filter(F.col("fill") < capacity)
        rest = left.count() if n > district and number + 1 < rounds else 0
        final = packed.filter(F.col("fill") >= capacity) if 0 < rest < 0.9 * n else packed
        done.append(final.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"))
        if final is packed:
            break
        items, n = left, rest
    return reduce(DataFrame.union, done)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    Null and empty texts are the end id alone. Only documents longer than ``length`` are cut.
    Texts are tokenised whole in one pass and never shuffled; an empty table has no pieces.
    Other columns are not read. ``tokenizer_path`` is read on every machine.
    """
    return pack(token_pieces(docs, tokenizer_path, id_col, text_col, length), length)


def op7_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    return pack_documents(read(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))
