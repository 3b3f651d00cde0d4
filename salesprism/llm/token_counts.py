"""Token counts of a unigram tokenizer without its tokens.

An Aho-Corasick automaton lists the vocabulary pieces that end at each place of a chunk; the
Viterbi pass carries only the best score and the number of pieces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesprism.llm.common import read

# Fixed values of the unigram tokenizer: the mark of a blank, and how far an unknown character
# stands below the worst piece.
BLANK_MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHED_CHUNKS = 400_000


@lru_cache(maxsize=2)
def vocabulary(path: str) -> list[tuple[str, float]]:
    """Ordinary pieces and scores of a piece model file; control, byte and unknown entries are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        (model.id_to_piece(i), model.get_score(i))
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))
    ]


class UnigramCounter:
    """Counts pieces as the unigram tokenizer segments: chunk by chunk, ties to the longest last piece.

    A chunk is a blank mark and what follows up to the next. A place's candidates are compared in
    the order of their starts and a later one must be strictly better. A character that is no
    piece is unknown; neighbouring unknowns are one token.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.cache: dict[str, tuple[int, int, float]] = {}

    def chunk(self, text: str) -> tuple[int, int, float]:
        """(pieces, unknown tokens, score) of the best segmentation."""
        n = len(text)
        best = [0.0] + [-math.inf] * n
        pieces, unknowns, open_unknown = [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text):
            ends[end].append(match)
        for end in range(1, n + 1):
            single = False
            for length, score in sorted(ends[end - 1], reverse=True):
                start = end - length
                single = single or length == 1
                if best[start] + score > best[end]:
                    best[end] = best[start] + score
                    pieces[end], unknowns[end], open_unknown[end] = pieces[start] + 1, unknowns[start], False
            if not single and best[end - 1] + self.unknown > best[end]:
                best[end] = best[end - 1] + self.unknown
                new = 0 if open_unknown[end - 1] else 1
                pieces[end], unknowns[end], open_unknown[end] = pieces[end - 1] + new, unknowns[end - 1] + new, True
        return pieces[n], unknowns[n], best[n]

    def count(self, text: str) -> tuple[int, int, float]:
        if not text:
            return 0, 0, 0.0
        marked = text.replace(" ", BLANK_MARK).removeprefix(BLANK_MARK)
        tokens = unknowns = 0
        total = 0.0
        cache = self.cache
        for rest in marked.split(BLANK_MARK):
            found = cache.get(rest)
            if found is None:
                if len(cache) >= CACHED_CHUNKS:
                    cache.clear()
                found = self.chunk(BLANK_MARK + rest)
                if len(rest) < 100:
                    cache[rest] = found
            tokens += found[0]
            unknowns += found[1]
            total += found[2]
        return tokens, unknowns, total


@lru_cache(maxsize=2)
def counter(path: str) -> UnigramCounter:
    return UnigramCounter(vocabulary(path))


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, n_tokens, n_unknown, score) of every row.

    Null and empty texts have no tokens and score 0. Whole texts are counted, in one pass without
    a shuffle; chunks that recur are counted once while they are in a cache of bounded size.
    Repeated rows stay; other columns are not read. ``model_path`` is read on every machine.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = [counter(model_path).count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(map(len, texts), pa.int64()),
                    pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()),
                    pa.array([f[2] for f in found], pa.float64()),
                ],
                ["doc_id", "n_chars", "n_tokens", "n_unknown", "score"],
            )

    schema = f"doc_id {kind}, n_chars bigint, n_tokens bigint, n_unknown bigint, score double"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def op4_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), str(public_tokenizers.path("piece_bpe_32k.model")))
