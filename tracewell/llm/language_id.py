"""Language identification by a bidirectional gated recurrent network over bytes (operator 4).

The network reads the bytes of a white-space chunk in both directions and labels every position with a distribution
over the languages. States start anew at white space. A chunk of more than ``WINDOW`` bytes, as texts without spaces
have, is read in windows that overlap: each is entered ``CONTEXT`` bytes before its own positions and left as many
after them, so every position is labelled once and with its context. A document's probabilities are the mean over all
its positions, of the whole text. The network is trained in numpy by backpropagation through time, on the driver, from
a bounded sample of labelled documents: about ``PER_LANGUAGE`` of each language, fewer where there are many languages
(``SAMPLE_DOCS`` in all, one of each language at least), chosen by a hash of their id, and of each an excerpt of
``EXCERPT`` characters at a place that the hash chooses. Every labelled language is learned. As a chunk's labels depend
on the chunk alone, workers keep the sums of a bounded number of distinct chunks.

Defined results: a text that is null, or has no letter, is ``und`` with score 0. Chunks without letters do not vote.
The rows of a language without letters teach nothing, so it is never predicted. Without labelled documents to learn from, every document is ``und``. Held out are the documents whose CRC-32 of the id
as text leaves 0 modulo 5 (a null id counts as empty text); the sample never holds them. Equal pooled probabilities go
to the language that sorts first. Repeated rows give repeated results. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import bounded, boxed, text_slices, unboxed

PER_LANGUAGE, SAMPLE_DOCS, EXCERPT = 300, 12_000, 4000
HIDDEN, WINDOW, CONTEXT, STEPS, BATCH, RATE, SEED = 16, 32, 16, 400, 256, 0.02, 5
FOLDS = 5
#: Chunks that a worker remembers at most, chunk windows that run through the network at once, and bytes of a slice of texts.
CACHE_CHUNKS, RUN_WINDOWS, SLICE_BYTES = 200_000, 4096, 1 << 20
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


@dataclass
class Model:
    """Languages and weights; w: bytes to the gates (z, r, n) by direction, u: states to the gates, v: states to labels."""

    languages: list[str]
    w: np.ndarray  # 2, 256, 3H
    u: np.ndarray  # 2, H, 3H
    v: np.ndarray  # 2, H, L
    c: np.ndarray  # L

    def parameters(self) -> list[np.ndarray]:
        return [self.w, self.u, self.v, self.c]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def windows(chunks: list[bytes], width: int = WINDOW, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte matrix, lengths and owner of the windows that make up the chunks, and which positions are their own."""
    sizes = np.array([len(c) for c in chunks], np.int64)
    parts = -(-sizes // width)
    owner = np.repeat(np.arange(len(chunks)), parts)
    along = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first = along * width
    enter = np.maximum(first - context, 0)
    length = np.minimum(first + width + context, sizes[owner]) - enter
    flat = np.frombuffer(b"".join(chunks), np.uint8)
    start = (np.cumsum(sizes) - sizes)[owner] + enter
    at = np.arange(int(length.max(initial=0)))
    inside = at < length[:, None]
    matrix = np.zeros(inside.shape, np.uint8)
    matrix[inside] = flat[(start[:, None] + at)[inside]]
    own = (at >= (first - enter)[:, None]) & (at < (np.minimum(first + width, sizes[owner]) - enter)[:, None])
    return matrix, length, owner, own


def forward(model: Model, matrix: np.ndarray, length: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """Position probabilities (batch, time, language); with ``keep`` also what backpropagation needs."""
    n, time = matrix.shape
    h = model.u.shape[1]
    logits = np.broadcast_to(model.c, (n, time, len(model.c))).copy()
    tape: list = []
    for d in range(2):
        state = np.zeros((n, h), np.float32)
        steps = range(time) if d == 0 else range(time - 1, -1, -1)
        for t in steps:
            live = (t < length)[:, None]
            x = model.w[d][matrix[:, t]]
            zr = sigmoid(x[:, : 2 * h] + state @ model.u[d][:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            back = state @ model.u[d][:, 2 * h :]
            new = np.tanh(x[:, 2 * h :] + r * back)
            after = np.where(live, new + z * (state - new), state)
            if keep:
                tape.append((d, t, state, z, r, back, new, live))
            state = after
            logits[:, t] += state @ model.v[d]
            if keep:
                tape[-1] += (state,)
    logits -= logits.max(axis=2, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=2, keepdims=True)
    return logits, tape


def gradients(model: Model, matrix: np.ndarray, length: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy of the positions and its gradients, backwards through time in both directions."""
    p, tape = forward(model, matrix, length, keep=True)
    n, time = matrix.shape
    inside = (np.arange(time) < length[:, None]).astype(np.float32) / length.sum()
    own = p[np.arange(n)[:, None], np.arange(time), label[:, None]]
    loss = float(-(np.log(own + 1e-9) * inside).sum())
    p[np.arange(n)[:, None], np.arange(time), label[:, None]] -= 1
    p *= inside[:, :, None]
    w, u, v, c = (np.zeros_like(x) for x in model.parameters())
    c += p.sum(axis=(0, 1))
    h = model.u.shape[1]
    carried = [np.zeros((n, h), np.float32) for _ in range(2)]
    for d, t, state, z, r, back, new, live, after in reversed(tape):
        v[d] += after.T @ p[:, t]
        grad = carried[d] + p[:, t] @ model.v[d].T
        dead = np.where(live, 0, grad)
        grad = np.where(live, grad, 0)
        d_new = grad * (1 - z) * (1 - new * new)
        d_z = grad * (state - new) * z * (1 - z)
        d_r = d_new * back * r * (1 - r)
        gates = np.concatenate([d_z, d_r, d_new], axis=1)
        np.add.at(w[d], matrix[:, t], gates)
        u[d][:, : 2 * h] += state.T @ gates[:, : 2 * h]
        u[d][:, 2 * h :] += state.T @ (d_new * r)
        carried[d] = dead + grad * z + gates[:, : 2 * h] @ model.u[d][:, : 2 * h].T + (d_new * r) @ model.u[d][:, 2 * h :].T
    return loss, [w, u, v, c]


def train(texts: list[str], languages: list[str], steps: int = STEPS, seed: int = SEED) -> Model:
    """Fit by Adam on chunks drawn evenly from the languages."""
    names = sorted(set(languages))
    rng = np.random.default_rng(seed)
    chunks = {n: [] for n in names}
    for text, language in zip(texts, languages, strict=True):
        chunks[language] += [w.encode() for w in text.lower().split() if LETTER.search(w)]
    names = [n for n in names if chunks[n]]
    shape = [(2, 256, 3 * HIDDEN), (2, HIDDEN, 3 * HIDDEN), (2, HIDDEN, len(names)), (len(names),)]
    scale = [0.3, HIDDEN**-0.5, 0.3, 0.0]
    model = Model(names, *[(s * rng.standard_normal(x)).astype(np.float32) for s, x in zip(scale, shape, strict=True)])
    if len(names) < 2:
        return model
    first, second = ([np.zeros_like(x) for x in model.parameters()] for _ in range(2))
    for step in range(1, steps + 1):
        label = rng.integers(0, len(names), BATCH)
        drawn = [chunks[names[k]][rng.integers(len(chunks[names[k]]))] for k in label]
        matrix, length, owner, _ = windows(drawn)
        _, grads = gradients(model, matrix, length, label[owner])
        rate = RATE * (1 - 0.9 * step / steps)
        for x, g, a, b in zip(model.parameters(), grads, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            x -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return model


class Labeller:
    """Pooled labels of texts, with a bounded memory of chunks."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.sums = np.zeros((1024, len(self.model.languages) + 1), np.float32)

    def chunk_sums(self, chunks: list[str]) -> np.ndarray:
        """For each chunk the sums of its positions' probabilities, and the number of positions; zero without letters."""
        out = np.zeros((len(chunks), self.sums.shape[1]), np.float32)
        spoken = [i for i, c in enumerate(chunks) if LETTER.search(c)] if self.model.languages else []
        spoken.sort(key=lambda i: len(chunks[i]))
        step = max(16, RUN_WINDOWS * 8 // max(8, len(self.model.languages)))
        for at in range(0, len(spoken), RUN_WINDOWS):
            part = spoken[at : at + RUN_WINDOWS]
            matrix, length, owner, own = windows([chunks[i].encode("utf-8", "replace") for i in part])
            for k in range(0, len(owner), step):
                m, n, o, mine = (x[k : k + step] for x in (matrix, length, owner, own))
                p, _ = forward(self.model, m, n)
                p *= mine[:, :, None]
                np.add.at(out, np.array(part)[o], np.c_[p.sum(axis=1), mine.sum(axis=1)].astype(np.float32))
        return out

    def places(self, chunks: list[str]) -> np.ndarray:
        """Rows of ``sums`` that hold the chunks."""
        unseen = list({c for c in chunks if c not in self.place})
        if unseen and len(self.place) + len(unseen) > CACHE_CHUNKS:
            self.forget()
            unseen = list(set(chunks))
        if unseen:
            unseen.sort()
            start = len(self.place)
            while len(self.sums) < start + len(unseen):
                self.sums = np.r_[self.sums, np.zeros_like(self.sums)]
            self.sums[start : start + len(unseen)] = self.chunk_sums(unseen)
            self.place.update(zip(unseen, range(start, start + len(unseen)), strict=True))
        return np.fromiter(map(self.place.__getitem__, chunks), np.int64, len(chunks))

    def label(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        split = [t.lower().split() if t else [] for t in texts]
        sizes = np.array([len(s) for s in split], np.int64)
        total = np.zeros((len(texts), self.sums.shape[1]), np.float64)
        at = self.places([c for s in split for c in s])
        ends = np.cumsum(sizes)
        some = np.flatnonzero(sizes)
        for i, a, b in zip(some.tolist(), (ends - sizes)[some].tolist(), ends[some].tolist(), strict=True):
            total[i] = self.sums[at[a:b]].sum(axis=0, dtype=np.float64)
        if total.shape[1] == 1:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        pooled = total[:, :-1] / np.maximum(total[:, -1:], 1)
        best = pooled.argmax(axis=1)
        known = total[:, -1] > 0
        names = [self.model.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known.tolist(), strict=True)]
        return names, np.where(known, np.clip(pooled.max(axis=1), 0, 1), 0.0)


def held_out(id_column: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, id_column: str = "doc_id") -> tuple[list[str], list[str]]:
    """Excerpts and languages to learn from: at most ``per_language`` documents of each, by a hash of the id."""
    usable = docs.where(~held_out(id_column) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()
    if not counts:
        return [], []
    most = max(1, min(per_language, SAMPLE_DOCS // len(counts)))
    parts = 1 << 30
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(parts, -(-2 * most * parts // r["n"]) + parts // 64))])
    order = F.pmod(F.xxhash64(id_column, F.lit("order")), F.lit(parts))
    begin = F.pmod(F.xxhash64(id_column), F.greatest(F.length("text") - EXCERPT, F.lit(0)) + 1)
    excerpt = F.expr("substring(text, 1 + begin, size)")
    drawn = usable.where(order < share[F.col("lang")]).select("text", "lang", order.alias("o"), begin.cast("int").alias("begin"), F.lit(EXCERPT).alias("size"), F.xxhash64("text").alias("t"))
    # The hash leaves about twice ``most`` rows of each language, however common it is.
    place = F.row_number().over(Window.partitionBy("lang").orderBy("o", "t"))
    rows = drawn.select(excerpt.alias("text"), "lang", "o", "t").withColumn("place", place).where(F.col("place") <= most).orderBy("lang", "place").collect()
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def fit(docs: DataFrame, id_column: str = "doc_id") -> Model:
    return train(*sample(docs, id_column=id_column))


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id") -> DataFrame:
    """Per document: id, held_out, lang_pred, score. A narrow map; the model's few thousand weights go with the tasks."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        for batch, texts in text_slices(batches, most=SLICE_BYTES):
            names, score = labeller.label(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[id_column, "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_column), F.col("text"), held_out(id_column).alias("held_out"))
    return rows.mapInArrow(bounded(run), f"`{id_column}` {kind}, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, model: Model, least_score: float) -> DataFrame:
    """The documents, with all their columns of any name, that have a language and at least ``least_score`` for it."""
    rows = boxed(docs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        for batch, texts in text_slices(batches, most=SLICE_BYTES):
            names, score = labeller.label(texts)
            yield batch.filter(pa.array([n != UNKNOWN and s >= least_score for n, s in zip(names, score.tolist(), strict=True)], pa.bool_()))

    return unboxed(rows.mapInArrow(bounded(run), rows.schema), docs.columns)
