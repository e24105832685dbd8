"""Token counts under a unigram vocabulary by dynamic programming over a trie (operator 10).

A text's pre-tokens are its white-space chunks, each with the word mark in front. The distinct pre-tokens of a
batch go into one trie, and the forward score of a prefix (the best segmentation up to there) is worked out once
for all pre-tokens that share it, level by level in numpy: partial pieces that run through a node are states of the
vocabulary's own trie and move on together. Counts are stored at the terminal nodes and kept in a bounded cache.

Scores: the vocabulary file's order gives the piece of rank r the integer score -round(2^20 ln(r + 2)) (Zipf's law);
equal scores go to fewer tokens. A character that no piece covers counts as its UTF-8 byte pieces. All arithmetic is
in integers, so counts are exact and reproducible; every ``REBASE`` characters a prefix's count is put aside and its score
starts anew, so a pre-token of any length fits.

Defined results: a null, empty or blank text has no pre-tokens and no tokens. A pre-token of any length is counted
whole. Repeated rows give repeated results. Only the id and the text are read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracewell.llm.common import WordCache, bounded, text_slices

MARK = "▁"
#: Pre-tokens times the characters of the longest that one trie holds at most (a longer one has a trie of its own).
TRIE_TOTAL = 1 << 20
#: Characters after which counts are put aside, and the count that stays with the score then.
REBASE, ASIDE = 1024, 1 << 12
#: A score s and n tokens are held as (s << COUNT_BITS) - n: larger is better, and the count can be read off.
COUNT_BITS = 16
LOW = np.iinfo(np.int64).min // 2


class Unigram:
    """Pieces and scores from a SentencePiece file, as a trie in arrays."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, int] = {}
        byte = [0] * 256
        rank = 0
        for i in range(sp.get_piece_size()):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                continue
            rank += 1
            cost = -round(2**20 * math.log(rank + 1))
            if sp.is_byte(i):
                byte[int(sp.id_to_piece(i)[1:-1], 16)] = cost
            else:
                self.score[sp.id_to_piece(i)] = cost
        self.byte = byte
        self.longest = max(map(len, self.score))
        states = {"": 0}
        for piece in sorted(self.score):
            for k in range(1, len(piece) + 1):
                states.setdefault(piece[:k], len(states))
        move = sorted((states[s[:-1]] << 21 | ord(s[-1]), k) for s, k in states.items() if s)
        self.moves = np.array([m for m, _ in move], np.int64)
        self.to = np.array([k for _, k in move], np.int64)
        self.value = np.full(len(states), LOW)
        for piece, cost in self.score.items():
            self.value[states[piece]] = (cost << COUNT_BITS) - 1

    def fallback(self, char: str) -> int:
        """The value of one character's byte pieces; LOW where the character is a piece itself."""
        if char in self.score:
            return LOW
        raw = char.encode("utf-8", "surrogatepass")
        return (sum(self.byte[b] for b in raw) << COUNT_BITS) - len(raw)

    def trie_best(self, words: list[str]) -> np.ndarray:
        """Tokens of distinct pre-tokens, each prefix worked out once."""
        order = sorted(range(len(words)), key=words.__getitem__)
        lengths = np.array([len(words[i]) for i in order])
        codes = np.zeros((len(words), int(lengths.max())), np.int32)
        flat = np.frombuffer("".join(words[i] for i in order).encode("utf-32-le", "surrogatepass"), np.int32)
        codes[np.arange(codes.shape[1]) < lengths[:, None]] = flat
        # Shared characters with the word before: where a node of a level begins.
        shared = np.zeros(len(words), np.int64)
        shared[1:] = np.argmin(np.c_[(codes[1:] == codes[:-1]) & (np.arange(codes.shape[1]) < np.minimum(lengths[1:], lengths[:-1])[:, None]), np.zeros(len(words) - 1, bool)], axis=1)
        alone = {int(c): self.fallback(chr(c)) for c in np.unique(flat)}
        seen, cost = np.array(list(alone)), np.array(list(alone.values()))
        out = np.zeros(len(words), np.int64)
        mask, rebase = (1 << COUNT_BITS) - 1, REBASE
        rows = np.arange(len(words))  # words that reach this level
        node = np.zeros(len(words), np.int64)  # their node on the level above
        value, aside = np.zeros(1, np.int64), np.zeros(1, np.int64)
        held_node, held_state, held_value = (np.zeros(0, np.int64) for _ in range(3))  # partial pieces at the nodes above
        for depth in range(codes.shape[1]):
            stay = lengths[rows] > depth
            rows, node = rows[stay], node[stay]
            if not len(rows):
                break
            begins = np.r_[True, (shared[rows[1:]] <= depth) | (np.diff(rows) > 1)]
            first = np.flatnonzero(begins)
            parent, char = node[first], codes[rows[first], depth].astype(np.int64)
            # Partial pieces of the parents, and one that begins here, each to all children.
            held_node, held_state, held_value = np.r_[held_node, np.arange(len(value))], np.r_[held_state, np.zeros(len(value), np.int64)], np.r_[held_value, value]
            by = np.argsort(held_node, kind="stable")
            count = np.bincount(held_node, minlength=len(value))
            start = np.cumsum(count) - count
            n = count[parent]
            child = np.repeat(np.arange(len(first)), n)
            pick = by[np.repeat(start[parent], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            key = held_state[pick] << 21 | char[child]
            at = np.minimum(np.searchsorted(self.moves, key), len(self.moves) - 1)
            live = self.moves[at] == key
            held_node, held_state, held_value = child[live], self.to[at[live]], held_value[pick[live]]
            new = value[parent] + cost[np.searchsorted(seen, char)]
            ends = self.value[held_state] > LOW
            np.maximum.at(new, held_node[ends], held_value[ends] + self.value[held_state[ends]])
            value, aside, node = new, aside[parent], np.cumsum(begins) - 1
            last = lengths[rows] == depth + 1
            out[rows[last]] = aside[node[last]] + (-value[node[last]] & mask)
            if depth % rebase == rebase - 1:
                aside = aside + (-value & mask) - ASIDE
                held_value = held_value - (value + ASIDE)[held_node]
                value = np.full(len(value), -ASIDE)
        result = np.empty(len(words), np.int64)
        result[order] = out
        return result

    def counts(self, words: list[str]) -> list[int]:
        """Tokens of each pre-token; tries hold pre-tokens of like length."""
        value = np.zeros(len(words), np.int64)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * len(words[order[end]]) <= TRIE_TOTAL:
                end += 1
            part = order[at:end]
            value[part] = self.trie_best([words[i] for i in part])
            at = end
        return value.tolist()


@functools.cache
def load(path: str) -> Unigram:
    return Unigram(path)


@functools.cache
def count_cache(path: str) -> WordCache:
    unigram = load(path)
    return WordCache(lambda words: unigram.counts([MARK + w for w in words]), limit=600_000)


def token_counts(docs: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """Per document: id, ``n_pretokens`` and ``n_tokens``. A narrow map: no shuffle, no state beyond the cache."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = count_cache(path)
        for batch, texts in text_slices(batches):
            split = [t.split() if t else [] for t in texts]
            known = cache.get_all(split)
            n = [sum(map(known.__getitem__, p)) for p in split]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(p) for p in split], pa.int64()), pa.array(n, pa.int64())], names=[id_column, "n_pretokens", "n_tokens"])

    return docs.select(id_column, "text").mapInArrow(bounded(run, keep_words=True), f"`{id_column}` {kind}, n_pretokens bigint, n_tokens bigint")
