"""Token counts of a unigram tokenizer, by dynamic programming over a trie of distinct pre-tokens.

A text is cut into pre-tokens (a run of spaces with what follows up to the next space); no piece of the vocabulary crosses such a
cut, so the best segmentation of a text is that of its pre-tokens. Distinct pre-tokens go into a trie. The best score of a prefix,
and the number of pieces in it, depend on the prefix only: they are computed once for each node, from the nodes above. The count at
a pre-token's last node is kept, and texts add up the counts of their pre-tokens.

The vocabulary is that of a public tokenizer file, whose path is a parameter; nothing is trained. Its merges are ordered by rank;
as a unigram model, a piece of rank r has the log probability of Zipf's law, -log(r + 1) up to a constant.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcube.llm._shared import small_batches
from sparkcube.llm._text import slices

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: What one unknown character costs more than the rarest piece.
UNKNOWN_PENALTY = 10.0
#: Bounds of the trie and of the kept counts, per worker; beyond them both start anew, which changes no result.
MAX_NODES, MAX_KEPT = 200_000, 400_000
#: Pre-tokens of more characters than this stay out of the trie.
LONG = 4096


def load_pieces(path: str = TOKENIZER) -> dict[str, float]:
    """Scores of the pieces that stand for text (not control, unknown or byte pieces), by Zipf's law of their ranks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found, rank = {}, 0
    for i in range(model.vocab_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            rank += 1
            found[model.id_to_piece(i)] = float(np.float32(-math.log(rank + 1)))
    return found


class Counter:
    """Counts tokens of pre-tokens; keeps a trie of them with the forward score and piece count of each prefix."""

    def __init__(self, pieces: dict[str, float]):
        # the vocabulary as a trie of reversed pieces, to walk from a prefix's end towards its start
        self.back: dict = {}
        for piece, score in pieces.items():
            node = self.back
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = score
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.kept: dict[str, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.score, self.pieces = [0.0], [0]

    def _forward(self, word: str, d: int, scores: list[float], counts: list[int]) -> tuple[float, int]:
        """Best score of word[:d] and its number of pieces; the last entries of scores and counts are those of word[:d-1]."""
        c = word[d - 1]
        best, count, node, size = -math.inf, 0, self.back.get(c), 1
        if node is None or "" not in node:  # a character outside the vocabulary: its bytes are tokens
            best, count = scores[-1] + self.unknown, counts[-1] + len(c.encode("utf-8", "replace"))
        while node is not None:
            if "" in node and (total := scores[-size] + node[""]) >= best:  # of equal scores, the longest last piece
                best, count = total, counts[-size] + 1
            if size == d:
                break
            size += 1
            node = node.get(word[d - size])
        return best, count

    def add(self, word: str) -> int:
        """Puts a pre-token into the trie; the number of its tokens."""
        if len(word) > LONG:
            return self._alone(word)
        if len(self.score) > MAX_NODES:
            self._clear()
        node, scores, counts = 0, [0.0], [0]
        for d, c in enumerate(word, 1):
            below = self.children[node].get(c)
            if below is None:
                score, count = self._forward(word, d, scores, counts)
                below = self.children[node][c] = len(self.score)
                self.children.append({})
                self.score.append(score)
                self.pieces.append(count)
            node = below
            scores.append(self.score[node])
            counts.append(self.pieces[node])
        return counts[-1]

    def _alone(self, word: str) -> int:
        """The same for a very long pre-token: only as many prefixes as the longest piece reaches back are kept."""
        scores, counts = [0.0], [0]
        for d in range(1, len(word) + 1):
            score, count = self._forward(word, d, scores, counts)
            scores.append(score)
            counts.append(count)
            if len(scores) > 2 * LONG:
                del scores[: -self.longest], counts[: -self.longest]
        return counts[-1]

    def count(self, texts: list[str | None]) -> list[int]:
        cut = [pretokens(t) for t in texts]
        if len(self.kept) > MAX_KEPT:
            self.kept.clear()
        for word in sorted({w for words in cut for w in words} - self.kept.keys()):
            self.kept[word] = self.add(word)
        get = self.kept.__getitem__
        return [sum(map(get, words)) for words in cut]


_PRETOKEN = re.compile(f"{SPACE}+[^{SPACE}]*")


def pretokens(text: str | None) -> list[str]:
    """Runs of spaces with the other characters that follow, spaces spelt as the vocabulary does; one is put before the text."""
    return _PRETOKEN.findall(SPACE + text.replace(" ", SPACE)) if text else []


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per input row: doc_id, n_chars, n_words, n_tokens, in one pass without a shuffle.

    A null or empty text has 0 tokens. Null doc_ids and repeated rows keep their rows; an empty table gives none; other columns are
    ignored; texts and pre-tokens of any length count whole.
    """
    small_batches(docs.sparkSession)
    pieces = docs.sparkSession.sparkContext.broadcast(load_pieces(tokenizer))  # the vocabulary of one tokenizer file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(pieces.value)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                counts = counter.count(texts)
                chars = [len(t) if t else 0 for t in texts]
                words = [len(t.encode("utf-8", "replace").split()) if t else 0 for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (chars, words, counts))], names=["doc_id", "n_chars", "n_words", "n_tokens"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_chars long, n_words long, n_tokens long")
