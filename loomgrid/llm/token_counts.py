"""Unigram token counts with trie-shared dynamic programming.

The distinct pre-tokens of a batch are sorted, which is the order of a depth-first walk of their
trie, and the best segmentation score of each prefix is computed once for all pre-tokens below it.
The number of pieces at a terminal is stored, and a text's count is the sum over its pre-tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.batches import text_batches

SPACE = "▁"
MEMO = 300_000
UNKNOWN_PENALTY = 10.0


def piece_scores(model_path: str) -> dict[str, float]:
    """Ordinary pieces of a sentencepiece vocabulary with log-probabilities by Zipf's law of the id.

    The public vocabularies hold merge ranks, not unigram probabilities, and none is trained here.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_path)
    pieces = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
    total = log(sum(1.0 / (k + 1) for k in range(len(pieces))))
    return {model.id_to_piece(i): -log(k + 1) - total for k, i in enumerate(pieces)}


class TrieCounter:
    """Counts pieces of pre-tokens under the best unigram segmentation.

    A character in no piece costs the lowest score less ``UNKNOWN_PENALTY`` and counts one token for each
    UTF-8 byte. Equal scores are decided for fewer tokens.
    """

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.seen: dict[str, int] = {}
        self.nodes = 0

    def learn(self, words: set[str]) -> None:
        """Store the counts of new pre-tokens, visiting each shared prefix once."""
        pieces, longest = self.pieces, self.longest
        path = ""
        scores, counts = [0.0], [0]
        for word in sorted(words):
            shared = len(commonprefix((path, word)))
            del scores[shared + 1 :], counts[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                char = word[end - 1]
                best = scores[end - 1] + self.unknown
                tokens = counts[end - 1] + len(char.encode("utf-8", "surrogatepass"))
                for start in range(max(0, end - longest), end):
                    score = pieces.get(word[start:end])
                    if score is not None:
                        score += scores[start]
                        n = counts[start] + 1
                        if score > best or (score == best and n < tokens):
                            best, tokens = score, n
                scores.append(best)
                counts.append(tokens)
                self.nodes += 1
            path = word
            self.seen[word] = counts[-1]

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each whole text; every white-space-separated word is a pre-token."""
        split = [(t or "").split() for t in texts]
        fresh = {SPACE + w for w in set().union(*split)}.difference(self.seen)
        if len(self.seen) + len(fresh) > MEMO:
            self.seen = {}
            fresh = {SPACE + w for w in set().union(*split)}
        self.learn(fresh)
        seen = self.seen
        return [sum([seen[SPACE + w] for w in words]) for words in split]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", batch_chars: int = 2_000_000) -> DataFrame:
    """``id, n_words, n_tokens`` for every row, from its whole text.

    Null and empty texts have no tokens; texts of any length are counted whole. Rows are independent, so repeated rows and null ids need no
    rule; an empty table gives no rows, and other columns are ignored.
    """
    pieces = piece_scores(model_path)
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TrieCounter(pieces)
        for batch in batches:
            tokens: list[int] = []
            words: list[int] = []
            some: list[str] = []
            chars = 0
            for value in batch.column(1):
                some.append(value.as_py() or "")
                chars += len(some[-1])
                if chars >= batch_chars:
                    tokens += counter.count(some)
                    words += [len(t.split()) for t in some]
                    some, chars = [], 0
            tokens += counter.count(some) if some else []
            words += [len(t.split()) for t in some]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], schema=schema)

    wanted = text_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return wanted.mapInArrow(tally, "id long, n_words long, n_tokens long")
