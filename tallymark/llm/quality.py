"""Quality: a byte-level convolutional network over overlapping chunks of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, training_texts

#: At most this many labelled documents are learned from, this many chunks of each.
SAMPLE, SAMPLE_CHUNKS = 6_000, 4
#: Bytes of a chunk and from one chunk to the next; bytes a filter sees; filters; size of a byte's vector.
CHUNK, STEP, WIDTH, FILTERS, VECTOR = 512, 448, 8, 24, 8
EPOCHS, BATCH, RATE, SEED = 8, 64, 0.01, 7
#: Chunks of a long text that are convolved at once.
AT_ONCE = 64


def sigmoid(x: np.ndarray) -> np.ndarray:
    """Logistic function without overflow."""
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60.0, 60.0)))


class Adam:
    """Gradient steps with rates adapted to each parameter."""

    def __init__(self, values: list[np.ndarray], rate: float) -> None:
        self.values, self.rate, self.steps = values, rate, 0
        self.first = [np.zeros_like(v) for v in values]
        self.second = [np.zeros_like(v) for v in values]

    def step(self, slopes: list[np.ndarray]) -> None:
        """Move every value, in place."""
        self.steps += 1
        for value, slope, first, second in zip(self.values, slopes, self.first, self.second):
            first += 0.1 * (slope - first)
            second += 0.01 * (slope * slope - second)
            mean = first / (1 - 0.9**self.steps)
            value -= self.rate * mean / (np.sqrt(second / (1 - 0.99**self.steps)) + 1e-8)


class ByteNetwork:
    """Byte vectors, one layer of filters, maximum over a chunk, one logit per chunk.

    A filter's response is a sum over its positions of a vector product with the
    byte there, so it is read from a table of 256 rows for each position. Since
    only the maximum passes on, gradients touch one window per chunk and filter.
    """

    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        self.bytes = rng.normal(0, 0.5, (256, VECTOR)).astype(np.float32)
        self.filters = rng.normal(0, 0.3, (WIDTH, VECTOR, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, FILTERS).astype(np.float32)
        self.out_bias = np.zeros(1, np.float32)
        # Weights of the mean, largest and smallest chunk logit of a document, and a bias.
        self.combined = np.array([1.0, 0.0, 0.0, 0.0])

    def tables(self) -> np.ndarray:
        """Response of each filter to each byte at each of its positions."""
        return np.einsum("bv,wvf->wbf", self.bytes, self.filters)

    @staticmethod
    def responses(tables: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Responses at every window of a run of bytes (or of several equally long)."""
        windows = text.shape[-1] - WIDTH + 1
        total = tables[0][text[..., :windows]]
        for at in range(1, WIDTH):
            total += tables[at][text[..., at : at + windows]]
        return total

    def learn(self, chunks: np.ndarray, labels: np.ndarray) -> None:
        """Fit the layers to chunks that carry their documents' labels."""
        rng = np.random.default_rng(SEED)
        adam = Adam([self.bytes, self.filters, self.bias, self.out, self.out_bias], RATE)
        for _ in range(EPOCHS):
            order = rng.permutation(len(chunks))
            for at in range(0, len(order), BATCH):
                picked = order[at : at + BATCH]
                text, truth = chunks[picked], labels[picked]
                responses = self.responses(self.tables(), text)
                where = responses.argmax(axis=1)  # (batch, filters)
                top = np.take_along_axis(responses, where[:, None, :], axis=1)[:, 0, :] + self.bias
                active = np.maximum(top, 0.0)
                wrong = (sigmoid(active @ self.out + self.out_bias) - truth).astype(np.float32) / len(picked)
                to_top = wrong[:, None] * self.out * (top > 0)
                seen = np.take_along_axis(
                    text[:, :, None], (where[:, None, :] + np.arange(WIDTH)[None, :, None]).reshape(len(picked), -1, 1), axis=1
                ).reshape(len(picked), WIDTH, FILTERS)
                vectors = self.bytes[seen]  # (batch, width, filters, vector)
                to_filters = np.einsum("bwfv,bf->wvf", vectors, to_top)
                to_bytes = np.zeros_like(self.bytes)
                np.add.at(to_bytes, seen, np.einsum("wvf,bf->bwfv", self.filters, to_top))
                adam.step([to_bytes, to_filters, to_top.sum(axis=0), active.T @ wrong, wrong.sum(keepdims=True)])

    def chunk_logits(self, tables: np.ndarray, text: bytes) -> np.ndarray:
        """One logit per chunk; every byte of the text is in a chunk, every window too."""
        raw = np.frombuffer(text if len(text) >= WIDTH else text.ljust(WIDTH, b"\0"), np.uint8)
        starts = chunk_starts(len(raw))
        logits = np.empty(len(starts), np.float32)
        for at in range(0, len(starts), AT_ONCE):
            begin = starts[at : at + AT_ONCE]
            end = np.minimum(begin + CHUNK, len(raw))
            responses = self.responses(tables, raw[begin[0] : end[-1]])
            spans = np.stack([begin, end - WIDTH + 1], axis=1).reshape(-1) - begin[0]
            padded = np.append(responses, responses[-1:], axis=0)  # an end may lie just past the last window
            top = np.maximum.reduceat(padded, spans, axis=0)[::2]
            logits[at : at + AT_ONCE] = np.maximum(top + self.bias, 0.0) @ self.out + self.out_bias
        return logits

    def summary(self, tables: np.ndarray, text: bytes) -> tuple[float, float, float]:
        """Mean, largest and smallest chunk logit of a text."""
        logits = self.chunk_logits(tables, text)
        return float(logits.mean()), float(logits.max()), float(logits.min())


def chunk_starts(size: int) -> np.ndarray:
    """Chunks start every ``STEP`` bytes until one reaches the end."""
    return np.arange(0, max(1, size - CHUNK + STEP), STEP)


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> ByteNetwork | None:
    """Learn from at most ``most`` labelled documents; None if there are none.

    The driver gets ``SAMPLE_CHUNKS`` evenly spaced chunks of each at most, and
    then three numbers per document, over all its chunks, to combine.
    """
    sample = training_texts(docs, labels, "quality", most, id_col, text_col)

    def chunk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text, label in zip(frame["text"], frame["label"]):
                raw = text.encode("utf-8", "replace")
                starts = chunk_starts(len(raw))
                for at in starts[np.unique(np.linspace(0, len(starts) - 1, SAMPLE_CHUNKS).astype(int))]:
                    rows.append((raw[at : at + CHUNK].ljust(CHUNK, b"\0"), label))
            yield pd.DataFrame(rows, columns=["chunk", "label"])

    rows = sample.mapInPandas(chunk, "chunk binary, label int").toPandas()
    if not len(rows):
        return None
    rows = rows.sort_values(["chunk", "label"], ignore_index=True)  # the same fit from any partitioning
    chunks = np.frombuffer(b"".join(map(bytes, rows["chunk"])), np.uint8).reshape(-1, CHUNK)
    network = ByteNetwork()
    network.learn(chunks, rows["label"].to_numpy(np.float32))

    def summarise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = network.tables()
        for frame in frames:
            found = [network.summary(tables, t.encode("utf-8", "replace")) for t in frame["text"]]
            yield pd.DataFrame(found, columns=["mean", "most", "least"]).assign(label=frame["label"].to_numpy())

    rows = sample.mapInPandas(summarise, "mean double, most double, least double, label int").toPandas()
    seen = np.column_stack([rows[["mean", "most", "least"]].to_numpy(float), np.ones(len(rows))])
    truth, weights = rows["label"].to_numpy(float), network.combined
    adam = Adam([weights], 0.02)
    for _ in range(500):
        wrong = sigmoid(seen @ weights) - truth
        adam.step([seen.T @ wrong / len(truth) + 1e-4 * weights])
    return network


def score_quality(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Probability that a document's quality label is 1, from its bytes alone.

    Filters over byte vectors run along chunks of 512 bytes that overlap and
    cover the whole UTF-8 text; a chunk keeps each filter's maximum and gets a
    logit, and the mean, largest and smallest logit of all chunks give the
    probability. Learned from at most ``most`` labelled documents that are not
    held out; long texts are convolved a few chunks at a time.

    Returns ``row`` (struct of all input columns), ``held_out``, ``score``.

    A null or empty text counts as eight zero bytes. Without labels every score
    is 0.5. Null ids are scored, are not held out, and teach nothing. Repeated
    rows get equal scores. An empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most, id_col, text_col))  # some 10 KB

    @F.pandas_udf("double")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        network = model.value
        tables = network.tables() if network else None
        for text in texts:
            if network is None:
                yield pd.Series(np.full(len(text), 0.5))
                continue
            found = np.array([network.summary(tables, t.encode("utf-8", "replace")) for t in text]).reshape(-1, 3)
            yield pd.Series(sigmoid(found @ network.combined[:3] + network.combined[3]))

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        held_out(F.col(f"`{id_col}`")).alias("held_out"),
        judge(text).alias("score"),
    )
