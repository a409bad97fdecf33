"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates all vocabulary pieces in a text; dynamic
programming over the places carries the best score and the number of pieces on
the best path, never the pieces.  Ties and unknowns follow the public unigram
tokenizers: of paths with equal scores the one whose last piece starts first
stays (a later candidate must be strictly better); a character that is no piece
by itself may also be taken as unknown, at ten below the lowest score, and then
counts as its UTF-8 bytes if the vocabulary has byte pieces, else runs of
unknown characters count as one.

Segments: text is cut before each run of spaces and around characters that
occur in no piece.  No piece crosses such a cut (checked when the vocabulary is
loaded; otherwise texts stay whole), so counts add up, and each task remembers
the counts of the segments it has met, at most ``memo_size`` of them.

Scale: one pass over whole texts without a shuffle; memory is bounded by the
longest text and the memo.

Defined results: a null or empty text has 0 tokens; every input row gives one
output row, repeated rows and null ids included; an empty table gives an empty
table; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from orrery.llm.common import keyed, map_batches

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
MEMO_SIZE = 400_000


@dataclass
class Vocabulary:
    """pieces: (piece, score) of the ordinary pieces; byte_pieces: unknown
    characters fall back to bytes; prefix: a space is put before each text."""

    pieces: list[tuple[str, float]]
    byte_pieces: bool = True
    prefix: bool = True


def load_vocabulary(path: str) -> Vocabulary:
    """The ordinary pieces and scores of a sentencepiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    pieces = [(sp.id_to_piece(i), sp.get_score(i)) for i in ids
              if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i) or sp.is_byte(i))]
    return Vocabulary(pieces, byte_pieces=any(map(sp.is_byte, ids)))


class Counter(dict):
    """segment -> tokens; computes and remembers what it has not met."""

    def __init__(self, vocabulary: Vocabulary, memo_size: int = MEMO_SIZE):
        import ahocorasick

        super().__init__()
        self.memo_size, self.bytes = memo_size, vocabulary.byte_pieces
        self.prefix = SPACE if vocabulary.prefix else ""
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), float(score)))
        if vocabulary.pieces:
            self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary.pieces), default=0.0) - UNKNOWN_PENALTY
        known = {c for p, _ in vocabulary.pieces for c in p}
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _ in vocabulary.pieces)
        # Runs of unknown characters must stay together where they count as one.
        alone = "".join(c for c in "\n\r\t" if c not in known) if self.bytes else ""
        x = re.escape(alone)
        self.cut = None if crossing else re.compile(f"{SPACE}+[^{SPACE}{x}]*|[^{SPACE}{x}]+" + f"|[{x}]" * bool(x))

    def __missing__(self, segment: str) -> int:
        if len(self) >= self.memo_size:
            self.clear()
        n = self.viterbi(segment)
        if len(segment) <= 64:
            self[segment] = n
        return n

    def viterbi(self, s: str) -> int:
        n, low = len(s), float("-inf")
        best, count, run = [low] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        at, single = 1, False

        def close(end: int, single: bool) -> None:
            """All pieces that end here are known; now the unknown character."""
            if not single and best[end - 1] + self.unknown > best[end]:
                best[end] = best[end - 1] + self.unknown
                count[end] = count[end - 1] + (len(s[end - 1].encode()) if self.bytes else not run[end - 1])
                run[end] = True

        for last, (size, score) in self.automaton.iter(s) if len(self.automaton) else ():
            end = last + 1
            while at < end:
                close(at, single)
                at, single = at + 1, False
            single = single or size == 1
            if best[end - size] + score > best[end]:
                best[end], count[end], run[end] = best[end - size] + score, count[end - size] + 1, False
        while at <= n:
            close(at, single)
            at, single = at + 1, False
        return count[n]

    def tokens(self, text: str | None) -> int:
        if not text:
            return 0
        text = self.prefix + text.replace(" ", SPACE)
        if self.cut is None:
            return self.viterbi(text)
        return sum(map(self.__getitem__, self.cut.findall(text)))


def count_tokens(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", memo_size: int = MEMO_SIZE) -> DataFrame:
    """``(id, n_tokens)`` per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(load_vocabulary(vocabulary_path), memo_size)
        for batch in batches:
            n = [counter.tokens(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64())], ["id", "n_tokens"])

    rows = keyed(df, id_col, text_col).drop("rid")
    return map_batches(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens bigint")
