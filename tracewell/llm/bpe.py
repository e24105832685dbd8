"""BPE encoding and decoding by batched numpy merge rounds (operator 3).

The symbols of many distinct words lie in one flat array. A round finds each pair's rank by binary search over
the sorted pair keys, takes the lowest rank of each word, merges its occurrences from the left, and drops the
words that have nothing left to merge. Encoded words are kept in a bounded cache per worker, so a corpus pays for
a word about once per worker and not once per occurrence.

Defined results: a null or empty text has no tokens, and both digests are those of the empty string. A text of
any length is encoded whole; a long word goes through the same rounds, one at a time, on arrays of neighbours that a
round changes only at the places of its pair. Repeated rows give
repeated results. Columns other than the id and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tracewell.llm.common import WORD_CACHES, WordCache, bounded, text_slices

#: Words of more bytes than this take their rounds alone.
LONG_BYTES = 256
#: Symbols that one batch of merge rounds holds at most.
BATCH_SYMBOLS = 1 << 16
#: Pre-tokens that a vocabulary remembers at most.
CACHE_WORDS = 150_000
#: Words that are done leave the arrays when fewer than this share still merge.
RETIRE = 0.7
NONE = np.iinfo(np.int32).max
#: White space that str.split() takes and the tokenizer does not.
ODD_SPACE = regex.compile(r"[\x1c-\x1f]")
SPACE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


@functools.cache
def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Bpe:
    """A word-level BPE vocabulary, read from a tokenizer file whose path is a parameter."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings: list[str] = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for s, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = s
        self.width = len(self.strings)
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + self.end] for c in chars], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.made = key[order], made[order].astype(np.int32)
        self.ranks = np.append(order, NONE).astype(np.int32)  # the last stands for no merge
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.pattern = regex.compile(split)
        self.lined = regex.compile(split + "|\n")
        self.forget()
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")

    def normal(self, text: str) -> str:
        """NFC and lower case, character by character (a final sigma is no special case)."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of pairs among the sorted pair keys; -1 where there is no such merge."""
        keys = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def long_rounds(self, raw: np.ndarray) -> np.ndarray:
        """Ids of one long word: each round merges the pair of lowest rank wherever it stands, and looks up the pairs this makes."""
        n = len(raw)
        ids = np.append(self.inner[raw[:-1]], self.last[raw[-1]])
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        alive = np.ones(n, bool)
        at = np.full(n, -1)  # the merge of each symbol with the next one
        waiting: dict[int, list[np.ndarray]] = {}  # rank -> places
        ranks: list[int] = []

        def look(places: np.ndarray) -> None:
            at[places] = -1
            places = places[after[places] < n]
            at[places] = found = self.find(ids[places], ids[after[places]])
            places, rank = places[found >= 0], self.ranks[found[found >= 0]]
            by = np.argsort(rank, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(rank[by])) + 1) if len(by) else []:
                r = int(rank[part[0]])
                if r not in waiting:
                    heapq.heappush(ranks, r)
                waiting.setdefault(r, []).append(places[part])

        look(np.arange(n))
        while ranks:
            rank = heapq.heappop(ranks)
            places = np.unique(np.concatenate(waiting.pop(rank)))
            places = places[(at[places] >= 0) & (self.ranks[at[places]] == rank)]
            if not len(places):
                continue
            # Equal pairs that overlap (aaa) stand next to each other: every second one of a run merges.
            along = np.arange(len(places))
            begins = np.append(True, places[1:] != after[places[:-1]])
            places = places[(along - np.maximum.accumulate(np.where(begins, along, 0))) % 2 == 0]
            gone = after[places]
            ids[places] = self.made[at[places]]
            alive[gone], at[gone] = False, -1
            after[places] = after[gone]
            some = after[places] < n
            before[after[places[some]]] = places[some]
            left = before[places]
            look(np.unique(np.concatenate([places, left[left >= 0]])))
        return ids[alive]

    def rounds(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, given as their bytes in one array and their lengths: all ids in one array, and how many each word has.

        A round looks up only the pairs that the round before has made.
        """
        ids = self.inner[flat]
        ends = np.cumsum(lengths) - 1
        ids[ends] = self.last[flat[ends]]
        owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        at = np.full(len(ids), -1, np.int32)  # the merge of each symbol with the next one
        at[:-1] = self.find(ids[:-1], ids[1:])
        at[ends] = -1
        done_ids, done_owner = [], []
        while len(ids):
            rank = self.ranks[at]  # at -1 stands a rank above all
            starts = np.flatnonzero(owner[1:] != owner[:-1])
            starts = np.concatenate([starts[:0], [0], starts + 1])
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(ids)))
            live = lowest < NONE
            hit = (rank == np.repeat(lowest, sizes)) & (rank < NONE)
            if np.count_nonzero(live) < RETIRE * len(live):  # words that are done leave the arrays, many at a time
                live = np.repeat(live, sizes)
                done_ids.append(ids[~live])
                done_owner.append(owner[~live])
                ids, owner, at, hit = ids[live], owner[live], at[live], hit[live]
                if not len(ids):
                    break
            # Equal pairs that overlap (aaa) stand next to each other: every second one of a run merges.
            if (hit[1:] & hit[:-1]).any():
                place = np.arange(len(hit))
                hit &= (place - np.maximum.accumulate(np.where(hit, -1, place))) % 2 == 1
            where = np.flatnonzero(hit)
            ids[where] = self.made[at[where]]
            keep = np.ones(len(ids), bool)
            keep[where + 1] = False
            ids, owner, at = ids[keep], owner[keep], at[keep]
            fresh = where - np.arange(len(where))  # each merge before it took one symbol away
            at[fresh] = -1
            before = fresh[fresh > 0] - 1
            at[before] = -1
            look = np.concatenate([fresh[fresh < len(ids) - 1], before])
            look = look[owner[look] == owner[look + 1]]
            at[look] = self.find(ids[look], ids[look + 1])
        ids, owner = np.concatenate([*done_ids, ids[:0]]), np.concatenate([*done_owner, owner[:0]])
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(lengths))

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens in one array, and how many each has, in bounded batches."""
        raw = np.frombuffer("\n".join([*words, ""]).encode(), np.uint8)
        stops = np.flatnonzero(raw == 10)
        lengths = np.diff(np.concatenate([[-1], stops])) - 1
        ids, counts = [], []
        k = 0
        while k < len(words):
            begin = int(stops[k - 1]) + 1 if k else 0
            if lengths[k] > LONG_BYTES:
                ids.append(self.long_rounds(raw[begin : stops[k]]))
                counts.append(np.array([len(ids[-1])]))
                k += 1
                continue
            end = max(k + 1, int(np.searchsorted(stops, begin + BATCH_SYMBOLS)))
            over = np.flatnonzero(lengths[k:end] > LONG_BYTES)
            end = k + int(over[0]) if len(over) else end
            part = raw[begin : stops[end - 1]]
            a, b = self.rounds(part[part != 10], lengths[k:end])
            ids.append(a)
            counts.append(b)
            k = end
        none = np.zeros(0, np.int32)
        return np.concatenate([none, *ids]), np.concatenate([none, *counts]).astype(np.int64)

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks of text without white space, as little-endian 32-bit numbers: no pre-token crosses white space."""
        # All chunks are split by one search; the line feed after each is a token of its own, without ids.
        tokens = self.lined.findall(self.normal("\n".join([*chunks, ""])))
        if len(self.index) > CACHE_WORDS:
            self.forget()
        new = list(set(tokens).difference(self.index))
        if new:
            ids, counts = self.encode_words(new)
            start = len(self.index)
            self.index.update(zip(new, range(start, start + len(new)), strict=True))
            ends = np.cumsum(counts)
            self.first = np.concatenate([self.first, len(self.store) + ends - counts])
            self.count = np.concatenate([self.count, counts])
            self.store = np.concatenate([self.store, ids])
        at = np.fromiter(map(self.index.__getitem__, tokens), np.int64, len(tokens))
        n = self.count[at]
        total = np.cumsum(n)
        flat = self.store[np.repeat(self.first[at] - (total - n), n) + np.arange(int(total[-1]) if len(total) else 0)]
        raw = flat.astype("<u4").tobytes()
        ends = (4 * total[at == 0]).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def forget(self) -> None:
        """Start the memory of pre-tokens anew; the line feed is its first entry, without ids."""
        self.index: dict[str, int] = {"\n": 0}
        self.first, self.count, self.store = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def parts(self, text: str | None) -> list[str]:
        """White-space chunks of a text; special tokens stand as chunks of their own."""
        if not text:
            return []
        if "<|" in text:
            out = []
            for k, piece in enumerate(self.specials.split(text)):
                out += [piece] if k % 2 else self.chunks(piece)
            return out
        return self.chunks(text)

    def chunks(self, text: str) -> list[str]:
        if ODD_SPACE.search(text):
            return [c for c in SPACE.split(text) if c]
        return text.split()

    def values(self, chunks: list[str]) -> list[bytes]:
        """Like encode_chunks, with special tokens as chunks."""
        if self.special.keys().isdisjoint(chunks):
            return self.encode_chunks(chunks) if chunks else []
        plain = [c for c in chunks if c not in self.special]
        known = dict(zip(plain, self.values(plain), strict=True))
        return [known[c] if c in known else np.array([self.special[c]], "<u4").tobytes() for c in chunks]


@functools.cache
def load(path: str) -> Bpe:
    """One vocabulary per worker process; its memory of pre-tokens goes with the caches of words."""
    WORD_CACHES.append(bpe := Bpe(path))
    return bpe


@functools.cache
def id_cache(path: str) -> WordCache:
    """Chunk -> its ids as little-endian 32-bit numbers."""
    return WordCache(load(path).values)


@functools.cache
def text_cache(path: str) -> WordCache:
    """Chunk -> (number of tokens, ids as text, tokens as text)."""
    bpe = load(path)

    def fill(chunks: list[str]) -> list[tuple[int, str, str]]:
        out = []
        for raw in bpe.values(chunks):
            ids = memoryview(raw).cast("I").tolist()
            out.append((len(ids), " ".join(map(str, ids)), " ".join([bpe.strings[i] for i in ids])))
        return out

    return WordCache(fill)


def encode_decode(docs: DataFrame, path: str, id_column: str = "doc_id", digests: bool = True) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns the id, ``n_tokens``, ``ids`` (decimal ids joined by a space) and ``decoded``; with ``digests``
    (the default) ``ids_sha256`` and ``decoded_sha256`` instead of the two texts. Decoding joins the tokens by a
    space, as a tokenizer file without a decoder asks for. A narrow map: no shuffle, no state beyond the cache.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cache = load(path), text_cache(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch, texts in text_slices(batches):
            split = [bpe.parts(t) for t in texts]
            known = cache.get_all(split)
            n, ids, tokens = [], [], []
            for p in split:
                got = [v for v in map(known.__getitem__, p) if v[0]]
                n.append(sum([v[0] for v in got]))
                a, b = " ".join([v[1] for v in got]), " ".join([v[2] for v in got])
                ids.append(sha(a) if digests else a)
                tokens.append(sha(b) if digests else b)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(tokens, pa.string())], names=out)

    out = [id_column, "n_tokens", "ids_sha256", "decoded_sha256"] if digests else [id_column, "n_tokens", "ids", "decoded"]
    return docs.select(id_column, "text").mapInArrow(bounded(run, keep_words=True), f"`{id_column}` {kind}, n_tokens bigint, {out[2]} string, {out[3]} string")
