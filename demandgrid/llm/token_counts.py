"""Token counts under a unigram vocabulary, without making tokens.

An Aho-Corasick automaton names every vocabulary piece that ends at each character. The
Viterbi pass keeps two numbers per place: the best score and how many pieces reach it.
Ties follow the tokenizer: places are passed from left to right, and a path replaces
another only if its score is strictly greater, so the longest last piece stays. A character
that no single-character piece covers may also be unknown, for the least score minus 10;
it counts as its UTF-8 bytes where the vocabulary falls back to bytes, else consecutive
unknown characters are one token.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandgrid.llm.common import pick

#: Fixed values of the tokenizer: the mark of a space, the penalty of an unknown character.
SPACE, PENALTY = "▁", 10.0
CACHED_WORDS, CACHED_LENGTH = 400_000, 64


class Vocabulary:
    """Pieces with scores of a sentencepiece file, spaces marked and one mark put before a text.

    The scores are those of the file. Only normal and user-defined pieces stand for text; control, unknown, unused
    and byte pieces match nothing, so their names in a text count as the characters they are made of.
    """

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        self.pieces, self.byte_fallback = pieces, byte_fallback
        self.unknown = min(score for _, score in pieces) - PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        # A text falls apart before a space mark if no piece goes on past one, and at a character of no longer piece.
        self.cuts_at_space = not any(SPACE in p.lstrip(SPACE) for p, _ in pieces)
        alone = "".join(c for c in "\n\r\t" if not any(c in p for p, _ in pieces if len(p) > 1))
        self.parts = re.compile(f"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.known: dict[str, int] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        names = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        pieces = [(model.id_to_piece(i), float(model.get_score(i))) for i in names]
        return cls(pieces, any(model.is_byte(i) for i in range(n)))

    def path_count(self, text: str) -> int:
        """Pieces of the best path over a marked text, as one piece of work."""
        n = len(text)
        best, count, dark = [0.0] + [None] * n, [0] * (n + 1), [False] * (n + 1)
        ending: list[list] = [[] for _ in range(n + 1)]
        for last, (length, score) in self.automaton.iter(text):
            ending[last + 1].append((length, score))
        single = [any(length == 1 for length, _ in ending[i + 1]) for i in range(n)]
        for end in range(1, n + 1):
            top, pieces, unknown = None, 0, False
            # Longer pieces begin further left, hence come first.
            for length, score in sorted(ending[end], reverse=True):
                value = best[end - length] + score
                if top is None or value > top:
                    top, pieces, unknown = value, count[end - length] + 1, False
            if not single[end - 1]:
                value = best[end - 1] + self.unknown
                if top is None or value > top:
                    cost = len(text[end - 1].encode()) if self.byte_fallback else int(not dark[end - 1])
                    top, pieces, unknown = value, count[end - 1] + cost, True
            best[end], count[end], dark[end] = top, pieces, unknown
        return count[n]

    def count(self, text: str) -> int:
        """Tokens of a text."""
        marked = SPACE + text.replace(" ", SPACE) if text else ""
        if not self.cuts_at_space or not self.byte_fallback:
            return self.path_count(marked)
        total, known = 0, self.known
        for word in self.parts(marked):
            if (n := known.get(word)) is None:
                n = self.path_count(word)
                if len(known) >= CACHED_WORDS:
                    known.clear()
                if len(word) <= CACHED_LENGTH:
                    known[word] = n
            total += n
        return total


def count_tokens(docs: DataFrame, model: str) -> DataFrame:
    """One row per document: doc_id, n_tokens. A null or empty text has none.

    Whole texts are counted, however long; repeated rows each; an empty table gives no rows.
    """

    @F.arrow_udf("long")
    def counted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = Vocabulary.load(model)
        for array in texts:
            yield pa.array(np.fromiter((vocabulary.count(t.as_py() or "") for t in array), np.int64, len(array)))

    return pick(docs, "doc_id", "text").select("doc_id", counted("text").alias("n_tokens"))
