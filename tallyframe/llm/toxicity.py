"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input is its own embedding and the mean embedding of its character trigrams. Two GRUs read
a window of WINDOW words from both ends; attention weighs their states, and a logistic unit scores
the weighted mean. Windows overlap by half, all windows of a text are scored, and the worst one is the
text's score. Embeddings are found by hash, so any word has an input. Everything is numpy: fitted on a
bounded labelled sample on the driver, applied to all texts in Spark tasks.

A toxic text need not be toxic throughout. First every window bears its text's label, then only the
window that scores highest, of toxic and clean texts alike.

Defined cases: a null or empty text, or one without a word, has score 0; a sample without rows of both
classes gives every other text the score of the class it has (without any row: 0).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common as c

WINDOW, STRIDE = 32, 16
WORDS, TRIGRAMS = 1 << 14, 1 << 12  # rows of the embedding tables
WIDTH, HIDDEN, ATTEND = 8, 8, 8  # of an embedding, of a state, of the attention
EPOCHS, BATCH, RATE = 12, 256, 0.01
FIRST_EPOCHS, FIRST_WINDOWS = 2, 6_000  # epochs in which every window bears its text's label, and windows of a class drawn in each
BLOCK = 4_096  # windows that a worker scores at once
#: Signs that are cut off both ends of a word.
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass
class Vocabulary:
    """Distinct words of some texts: rows of the embeddings of each."""

    word: np.ndarray
    trigrams: np.ndarray
    owner: np.ndarray  # the word of each trigram
    counts: np.ndarray  # trigrams of each word


def _hashed(codes: np.ndarray, rows: int) -> np.ndarray:
    codes = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((codes ^ codes >> np.uint64(29)) % np.uint64(rows)).astype(np.int64)


def vocabulary(words: pa.Array) -> Vocabulary:
    """Of lower-cased words without signs at their ends."""
    raw = [b"<" + (x or b"") + b">" for x in words.cast(pa.large_binary()).to_pylist()]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    ends = np.cumsum([len(x) for x in raw]).astype(np.int64)
    starts = np.concatenate([[0], ends])[: len(ends)].astype(np.int64)
    weights = np.uint64(0x100000001B3) ** (np.arange(len(data)) - np.repeat(starts, ends - starts)).astype(np.uint64)
    whole = np.add.reduceat(data * weights, starts) if len(raw) else np.empty(0, np.uint64)
    first = np.ones(len(data), bool)
    for back in (1, 2):
        first[np.maximum(ends - back, 0)] = False  # no trigram begins at a word's last two signs
    at = np.flatnonzero(first[: max(0, len(data) - 2)])
    codes = data[at] | data[at + 1] << np.uint64(8) | data[at + 2] << np.uint64(16)
    owner = np.searchsorted(ends, at, "right")
    return Vocabulary(_hashed(whole, WORDS), _hashed(codes, TRIGRAMS), owner, np.bincount(owner, minlength=len(raw)))


def windows(texts: pa.Array) -> tuple[Vocabulary, np.ndarray, np.ndarray]:
    """Distinct words; their places in all windows (-1 past the end); the text of each window."""
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(texts.fill_null(""))))
    folded = lists.flatten().dictionary_encode()
    bare = pc.utf8_trim(folded.dictionary.cast(pa.large_string()), characters=EDGES)
    bare = pc.if_else(pc.equal(bare, ""), folded.dictionary.cast(pa.large_string()), bare)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    words = folded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if len(words) and pc.any(pc.equal(folded.dictionary, "")).as_py():  # an empty text splits into an empty word
        empty = int(pc.index(folded.dictionary, pa.scalar("", folded.dictionary.type)).as_py())
        real = words != empty
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[real], minlength=len(sizes))
        words = words[real]
    ends = np.cumsum(sizes)
    number = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE)), 0)
    owner = np.repeat(np.arange(len(sizes)), number)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
    places = (ends - sizes)[owner][:, None] + nth[:, None] * STRIDE + np.arange(WINDOW)
    inside = places < ends[owner][:, None]
    grid = np.full(places.shape, -1, np.int64)
    grid[inside] = words[places[inside]]
    return vocabulary(bare), grid, owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Weights by name, all of 32 bits."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        h, d = HIDDEN, 2 * WIDTH

        def draw(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.w = {
            "word": (rng.standard_normal((WORDS, WIDTH)) * 0.1).astype(np.float32),
            "trigram": (rng.standard_normal((TRIGRAMS, WIDTH)) * 0.1).astype(np.float32),
            "attend": draw(2 * h, ATTEND),
            "attend_bias": np.zeros(ATTEND, np.float32),
            "attend_to": draw(ATTEND),
            "out": draw(2 * h),
            "bias": np.zeros(1, np.float32),
        }
        for way in ("f", "b"):
            self.w |= {f"in_{way}": draw(d, 3 * h), f"in_bias_{way}": np.zeros(3 * h, np.float32), f"gate_{way}": draw(h, 2 * h), f"new_{way}": draw(h, h)}
        self.curve = (1.0, 0.0)

    def inputs(self, words: Vocabulary) -> np.ndarray:
        """Input of every distinct word; a last row of zeros stands for what lies past the end."""
        chars = np.zeros((len(words.word), WIDTH), np.float32)
        if len(words.trigrams):
            some = np.flatnonzero(words.counts)
            begin = (np.cumsum(words.counts) - words.counts)[some]
            chars[some] = np.add.reduceat(self.w["trigram"][words.trigrams], begin) / words.counts[some][:, None]
        return np.vstack([np.hstack([self.w["word"][words.word], chars]), np.zeros((1, 2 * WIDTH), np.float32)])

    def forward(self, inputs: np.ndarray, grid: np.ndarray, keep: bool = False):
        """Scores (before the logistic curve) of windows; with ``keep`` also what ``backward`` needs."""
        h, n, steps = HIDDEN, len(grid), grid.shape[1]
        valid = (grid >= 0).astype(np.float32)
        states = np.empty((steps, n, 2 * h), np.float32)
        held = {}
        for way, place in (("f", 0), ("b", h)):
            given = inputs @ self.w[f"in_{way}"] + self.w[f"in_bias_{way}"]
            state = np.zeros((n, h), np.float32)
            for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
                g = given[grid[:, t]]
                gates = _sigmoid(g[:, : 2 * h] + state @ self.w[f"gate_{way}"])
                z, r = gates[:, :h], gates[:, h:]
                u = state @ self.w[f"new_{way}"]
                new = np.tanh(g[:, 2 * h :] + r * u)
                take = (1 - z) * valid[:, t : t + 1]
                if keep:
                    held[way, t] = (state, z, r, u, new)
                state = state + take * (new - state)
                states[t, :, place : place + h] = state
        hidden = np.tanh(states @ self.w["attend"] + self.w["attend_bias"])
        weight = np.exp(hidden @ self.w["attend_to"]) * valid.T
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        pooled = (weight[:, :, None] * states).sum(axis=0)
        score = pooled @ self.w["out"] + self.w["bias"][0]
        return (score, (valid, states, held, hidden, weight, pooled)) if keep else score

    def backward(self, words: Vocabulary, inputs: np.ndarray, grid: np.ndarray, kept, slope: np.ndarray) -> dict[str, np.ndarray]:
        """Slopes of all weights from those of the scores."""
        h, steps = HIDDEN, grid.shape[1]
        valid, states, held, hidden, weight, pooled = kept
        out = {"out": pooled.T @ slope, "bias": slope.sum(keepdims=True)}
        d_pooled = slope[:, None] * self.w["out"]
        d_states = weight[:, :, None] * d_pooled
        d_weight = (states * d_pooled).sum(axis=2)
        d_energy = weight * (d_weight - (weight * d_weight).sum(axis=0))
        out["attend_to"] = np.einsum("tna,tn->a", hidden, d_energy)
        d_hidden = d_energy[:, :, None] * self.w["attend_to"] * (1 - hidden**2)
        out["attend"] = np.einsum("tns,tna->sa", states, d_hidden)
        out["attend_bias"] = d_hidden.sum(axis=(0, 1))
        d_states = d_states + d_hidden @ self.w["attend"].T
        d_inputs = np.zeros_like(inputs)
        for way, place in (("f", 0), ("b", h)):
            d_given = np.zeros((len(inputs), 3 * h), np.float32)
            d_gate, d_new_w = np.zeros_like(self.w[f"gate_{way}"]), np.zeros_like(self.w[f"new_{way}"])
            after = np.zeros((len(grid), h), np.float32)
            for t in range(steps - 1, -1, -1) if way == "f" else range(steps):
                state, z, r, u, new = held[way, t]
                d = after + d_states[t, :, place : place + h]
                on = valid[:, t : t + 1]
                d_new = d * (1 - z) * on * (1 - new**2)
                d_z = d * (state - new) * on * z * (1 - z)
                d_r = d_new * u * r * (1 - r)
                d_u = d_new * r
                d_gates = np.hstack([d_z, d_r])
                d_gate += state.T @ d_gates
                d_new_w += state.T @ d_u
                np.add.at(d_given, grid[:, t], np.hstack([d_gates, d_new]))
                after = d * (1 - (1 - z) * on) + d_gates @ self.w[f"gate_{way}"].T + d_u @ self.w[f"new_{way}"].T
            out |= {f"gate_{way}": d_gate, f"new_{way}": d_new_w, f"in_{way}": inputs.T @ d_given, f"in_bias_{way}": d_given.sum(axis=0)}
            d_inputs += d_given @ self.w[f"in_{way}"].T
        out["word"] = np.zeros_like(self.w["word"])
        np.add.at(out["word"], words.word, d_inputs[:-1, :WIDTH])
        out["trigram"] = np.zeros_like(self.w["trigram"])
        share = d_inputs[:-1, WIDTH:] / np.maximum(words.counts, 1)[:, None]
        np.add.at(out["trigram"], words.trigrams, share[words.owner])
        return out

    def window_scores(self, inputs: np.ndarray, grid: np.ndarray) -> np.ndarray:
        parts = [self.forward(inputs, grid[a : a + BLOCK]) for a in range(0, len(grid), BLOCK)]
        return np.concatenate([np.empty(0, np.float32), *parts])

    def text_scores(self, texts: pa.Array) -> np.ndarray:
        """Chance that each text is toxic."""
        words, grid, owner = windows(texts)
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, owner, self.window_scores(self.inputs(words), grid).astype(np.float64))
        score = 1 / (1 + np.exp(-np.clip(self.curve[0] * worst + self.curve[1], -30, 30)))
        return np.where(np.isfinite(worst), score, 0.0)


def _only(words: Vocabulary, grid: np.ndarray) -> tuple[Vocabulary, np.ndarray]:
    """The words of some windows, numbered anew."""
    used, place = np.unique(grid[grid >= 0], return_inverse=True)
    small = np.full(grid.shape, -1, np.int64)
    small[grid >= 0] = place
    number = np.full(len(words.word), -1, np.int64)
    number[used] = np.arange(len(used))
    mine = number[words.owner] >= 0
    return Vocabulary(words.word[used], words.trigrams[mine], number[words.owner[mine]], words.counts[used]), small


def fit(sample: list[tuple[str, int]], seed: int = 7) -> Network:
    """A network from (text, label) pairs, label 1 for toxic."""
    net, rng = Network(seed), np.random.default_rng(seed)
    words, grid, owner = windows(pa.array([t for t, _ in sample], pa.string()))
    marks = np.array([y for _, y in sample], np.float32)
    if len(set(marks.tolist())) < 2 or not len(grid):
        net.curve = (0.0, 30.0 if marks.any() else -30.0)
        return net
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.w.items()}
    step, some = 0, np.unique(owner)
    begin = np.searchsorted(owner, some)
    for epoch in range(EPOCHS):
        if epoch < FIRST_EPOCHS:
            chosen = np.concatenate([rng.choice(np.flatnonzero(marks[owner] == y), FIRST_WINDOWS) for y in (0, 1) if (marks[owner] == y).any()])
        else:
            scores = net.window_scores(net.inputs(words), grid)
            top = np.maximum.reduceat(scores, begin)
            best = np.flatnonzero(scores == np.repeat(top, np.diff(np.append(begin, len(owner)))))
            chosen = best[np.unique(owner[best], return_index=True)[1]]
        weight = np.where(marks[owner[chosen]] == 1, 0.5 / max(1, (marks[owner[chosen]] == 1).sum()), 0.5 / max(1, (marks[owner[chosen]] == 0).sum())) * len(chosen)
        for part in np.array_split(rng.permutation(len(chosen)), -(-len(chosen) // BATCH)):
            few, places = _only(words, grid[chosen[part]])
            inputs = net.inputs(few)
            score, kept = net.forward(inputs, places, keep=True)
            slope = ((_sigmoid(score) - marks[owner[chosen[part]]]) * weight[part] / len(part)).astype(np.float32)
            step += 1
            for name, value in net.backward(few, inputs, places, kept, slope).items():
                m, v = moments[name]
                m += 0.1 * (value - m)
                v += 0.001 * (value**2 - v)
                net.w[name] -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
    worst = np.maximum.reduceat(net.window_scores(net.inputs(words), grid), begin).astype(np.float64)
    net.curve = _curve(worst, marks[some])
    return net


def _curve(worst: np.ndarray, marks: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve over the worst windows, both classes of equal weight."""
    x = np.stack([worst, np.ones(len(worst))], 1)
    line = np.array([1.0, 0.0])
    weight = np.where(marks == 1, 0.5 / max(1, (marks == 1).sum()), 0.5 / max(1, (marks == 0).sum()))
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        line -= np.linalg.solve(bend, x.T @ (weight * (p - marks)) + 1e-3 * (line - [1.0, 0.0]))
    return float(line[0]), float(line[1])


def scored(docs: DataFrame, net: Network, text: str = "text", out: str = "score") -> DataFrame:
    """Append the score of every whole text."""
    schema = c.schema_with(docs, (out, T.DoubleType()))
    shared = docs.sparkSession.sparkContext.broadcast((net.w, net.curve))  # under 1 MB, whatever the input
    ready: list[Network] = []

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        if not ready:
            own = Network.__new__(Network)
            own.w, own.curve = shared.value
            ready.append(own)
        return [pa.array(ready[0].text_scores(pa.array(c.as_texts(c.column(batch, text)), pa.large_string())))]

    return c.passing(docs, text, schema, work)
