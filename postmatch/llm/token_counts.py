"""Token counts of a unigram model by dynamic programming over a trie of pre-tokens.

Pre-tokens are the words between white space, each with the vocabulary's word mark in front. The distinct
pre-tokens of a task are inserted in one trie; a node holds the forward score (best log probability and
fewest tokens) of the prefix it stands for, so a prefix shared by many pre-tokens is scored once. The
count at a pre-token's last node is its number of tokens. A character that no piece covers is spelled in
bytes. The log probability of a piece follows Zipf's law over the vocabulary's own order of its pieces.

Defined cases: null, empty and blank texts count 0; equal scores prefer fewer tokens; every input row
gives one output row. A task forgets its counts once it holds `MAX_KEPT` of them, which bounds memory and
changes no result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmatch.llm.common import arrow_rows, pieces, utf8

MARK = "▁"
VOCABULARY = "piece_bpe_32k.model"
#: Logarithm of one byte of a character that no piece covers: below that of every piece.
BYTE_SCORE = -16.0
MAX_KEPT = 1_000_000


def zipf_scores(model_file: str) -> dict[str, float]:
    """Log probability of each normal piece of a sentencepiece vocabulary, by its place in the vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    normal = [
        i for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    total = math.log(sum(1 / (rank + 1) for rank in range(len(normal))))
    return {model.id_to_piece(i): -math.log(rank + 1) - total for rank, i in enumerate(normal)}


def piece_trie(scores: dict[str, float]) -> dict:
    """Nested dicts by character; the empty key holds the score of a piece that ends there."""
    root: dict = {}
    for piece, score in scores.items():
        node = root
        for ch in piece:
            node = node.setdefault(ch, {})
        node[""] = score
    return root


class PreTokenTrie(dict):
    """Token counts by pre-token.

    `insert` walks the trie of new pre-tokens depth first, which is their sorted order, so only the nodes
    on the current path are held. A node keeps its forward score and the pieces that may go on beyond it:
    their place in the trie of pieces and the forward score before them.
    """

    def __init__(self, scores: dict[str, float]):
        super().__init__()
        self.root = piece_trie(scores)
        self.nodes = 0

    def insert(self, words: set[str]) -> None:
        root = self.root
        path = [(0.0, 0, [(0.0, 0, root)])]
        self._extend(path, MARK)
        last = ""
        for word in sorted(words):
            shared, most = 0, min(len(last), len(word))
            while shared < most and last[shared] == word[shared]:
                shared += 1
            del path[shared + 2 :]
            self._extend(path, word[shared:])
            self[word] = -path[-1][1]
            last = word

    def _extend(self, path: list, text: str) -> None:
        root = self.root
        score, fewest, going = path[-1]
        self.nodes += len(text)
        for ch in text:
            size = 1 if ch < "\x80" else len(ch.encode("utf-8", "surrogatepass"))
            score += size * BYTE_SCORE
            fewest -= size
            live = []
            for before, used, place in going:
                if ch in place:
                    place = place[ch]
                    live.append((before, used, place))
                    if "" in place:
                        own = place[""] + before
                        if own > score or own == score and used - 1 > fewest:
                            score, fewest = own, used - 1
            live.append((score, fewest, root))
            going = live
            path.append((score, fewest, live))

    def count(self, texts: list[list[str]]) -> list[int]:
        """Tokens of each list of pre-tokens."""
        if len(self) > MAX_KEPT:
            self.clear()
        self.insert({w for words in texts for w in words if w not in self})
        of = self.__getitem__
        return [sum(map(of, words)) for words in texts]


def count_tokens(documents: DataFrame, model_file: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_pretokens, n_tokens) of every row. No shuffle: a pre-token is scored once per task."""
    scores = zipf_scores(model_file)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PreTokenTrie(scores)
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for first, last in pieces(offsets):
                texts = [(value or "").split() for value in batch.column(1)[first:last].to_pylist()]
                yield arrow_rows(**{
                    key: batch.column(0)[first:last], "n_pretokens": np.array(list(map(len, texts)), np.int64),
                    "n_tokens": np.array(trie.count(texts), np.int64),
                })

    rows = documents.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(counted, f"{key} long, n_pretokens long, n_tokens long")
