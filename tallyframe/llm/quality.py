"""Document quality by a linear-chain conditional random field over lines.

Every line that is not blank is good or bad. Its features are shares of kinds of characters and of
repeated words, of the line itself and of the lines before and after it; neighbouring labels have
weights of their own. Forward-backward gives each line's chance to be good; the mean over lines,
weighted by their lengths, is the document's quality, which a logistic curve turns into the score.

Only documents have labels. All lines of a good document are taken as good; of a bad one, the lines
that the last fit calls bad (at first all), and always the worst.

Defined cases: a null, empty or blank text has score 0; without labelled rows of both classes the
score is the mean chance under weights of zero, one half.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common as c

KINDS = {
    "lower": bytes(range(97, 123)),
    "upper": bytes(range(65, 91)),
    "digit": b"0123456789",
    "stop": b".,;:?",
    "quote": b"'\"()-",
    "sign": b"#$%&*|!<>{}[]\\/=+~^@_`",
}
SHARES = np.array([0.02, 0.08, 0.2, 0.5])
PASSES, STEPS, RATE, DECAY = 3, 60, 0.1, 1e-3
#: Lines that a model is fitted on; documents that would pass it are passed over for the next ones.
LINES = 200_000
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_TABLES = np.stack([np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in KINDS.values()]).astype(np.uint8)


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines that are not blank, their lengths, and where the lines of each text begin."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    text_ends = np.cumsum([len(x) + 1 for x in texts])
    ends = np.flatnonzero(data == 0x0A)
    begin = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    white = _WHITE[data]
    solid = np.add.reduceat(~white, begin, dtype=np.int64) if len(begin) else begin
    filled = solid > 0
    starts = begin[filled]
    lengths = (ends - begin)[filled].astype(np.float64)
    bounds = np.searchsorted(starts, np.concatenate([[0], text_ends]))
    if not len(starts):
        return np.empty((0, _own_width()), np.float32), lengths, bounds
    line_of = np.cumsum(np.bincount(starts, minlength=len(data))) - 1  # blank lines fall to the line before; they add no letters
    counts = np.stack([np.add.reduceat(table[data], starts, dtype=np.int64) for table in _TABLES], 1).astype(np.float64)
    letters = counts[:, 0] + counts[:, 1]
    first = ~white
    first[1:] &= white[:-1]
    at = np.flatnonzero(first)
    at = at[at >= starts[0]]
    words = np.bincount(line_of[at], minlength=len(starts)).astype(np.float64)
    place = np.cumsum(~white)[at] - 1
    bytes_of = data[~white].tobytes()
    folded = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(at), [None, pa.py_buffer(np.append(place, len(bytes_of)).astype(np.int64)), pa.py_buffer(bytes_of)]
    ).dictionary_encode()
    word, line = folded.indices.to_numpy().astype(np.int64), line_of[at]
    again = np.concatenate([[False], (word[1:] == word[:-1]) & (line[1:] == line[:-1])])
    pairs = np.sort(line * (len(folded.dictionary) + 1) + word)
    distinct = np.bincount(pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] // (len(folded.dictionary) + 1), minlength=len(starts))
    shares = np.stack(
        [
            counts[:, 1] / np.maximum(letters, 1),
            counts[:, 2] / lengths,
            counts[:, 3] / lengths,
            counts[:, 4] / lengths,
            counts[:, 5] / lengths,
            np.bincount(line, again, len(starts)) / words,
            1 - distinct / words,
            1 - letters / lengths,
        ],
        1,
    )
    steps = (shares[:, :, None] > SHARES).reshape(len(shares), -1)
    size = np.log1p(lengths)[:, None] / 5
    return np.hstack([shares, steps, size, (words < 4)[:, None]]).astype(np.float32), lengths, bounds


def _own_width() -> int:
    return 8 * (1 + len(SHARES)) + 2


def with_neighbours(own: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and after in the same text, and marks of its ends."""
    n = len(own)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    some = bounds[:-1][np.diff(bounds) > 0]
    first[some] = True
    last[np.append(some[1:], n)[: len(some)] - 1] = True
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:] = own[:-1]
    after[:-1] = own[1:]
    before[first] = 0
    after[last] = 0
    return np.hstack([own, before, after, first[:, None], last[:, None], np.ones((n, 1))]).astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray  # of "good" against "bad", per feature
    pairs: np.ndarray  # of (label, next label)
    curve: tuple[float, float] = (1.0, 0.0)


def marginals(model: Model, features: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of "good" per line, and the expected number of each pair of neighbouring labels."""
    n = len(features)
    score = np.zeros((n, 2))
    score[:, 1] = features @ model.weights
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = bounds[:-1][order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = [int(np.searchsorted(-sizes, -t, "left")) for t in range(longest)]  # texts of more than t lines
    ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
    for t in range(longest):
        at = starts[: active[t]] + t
        ahead[at] = score[at]
        if t:
            ahead[at] += np.logaddexp(ahead[at - 1, :1] + model.pairs[0], ahead[at - 1, 1:] + model.pairs[1])
    expected = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        onward = score[at + 1] + behind[at + 1]
        behind[at] = np.logaddexp(model.pairs[:, 0] + onward[:, :1], model.pairs[:, 1] + onward[:, 1:])
    both = ahead + behind
    total = np.logaddexp(both[:, 0], both[:, 1])
    inner = np.ones(n, bool)
    ends = bounds[1:][np.diff(bounds) > 0] - 1
    inner[ends] = False
    at = np.flatnonzero(inner)
    if len(at):
        joint = ahead[at][:, :, None] + model.pairs + (score[at + 1] + behind[at + 1])[:, None, :] - total[at][:, None, None]
        expected = np.exp(joint).sum(axis=0)
    return np.exp(both[:, 1] - total), expected


def document_quality(good: np.ndarray, lengths: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean chance of "good", weighted by length; 0 without a line."""
    joint = np.concatenate([[0], np.cumsum(good * lengths)])
    whole = np.concatenate([[0], np.cumsum(lengths)])
    weight = whole[bounds[1:]] - whole[bounds[:-1]]
    return np.where(weight > 0, (joint[bounds[1:]] - joint[bounds[:-1]]) / np.maximum(weight, 1), 0.0)


def fit(sample: list[tuple[str, int]]) -> Model:
    """Weights from (text, label) pairs, label 1 for good; on at most LINES lines."""
    sample = _fitting(sample)
    own, lengths, bounds = line_features([t.encode() for t, _ in sample])
    features = with_neighbours(own, bounds) if len(own) else np.zeros((0, 3 * _own_width() + 3), np.float32)
    model = Model(np.zeros(3 * _own_width() + 3), np.zeros((2, 2)))
    marks = np.array([y for _, y in sample])
    if len(set(marks.tolist())) < 2 or not len(own):
        return model
    text_of = np.repeat(np.arange(len(sample)), np.diff(bounds))
    label = marks[text_of].astype(np.float64)
    rows = np.where(marks[text_of] == 1, 0.5 / max(1, (marks == 1).sum()), 0.5 / max(1, (marks == 0).sum()))
    per_text = rows / np.diff(bounds)[text_of]  # every text weighs the same within its class
    inner = np.flatnonzero(text_of[1:] == text_of[:-1])
    for _ in range(PASSES):
        seen = np.zeros((2, 2))
        np.add.at(seen, (label[inner].astype(int), label[inner + 1].astype(int)), 1)
        moment = [np.zeros_like(model.weights), np.zeros_like(model.weights), np.zeros((2, 2)), np.zeros((2, 2))]
        for step in range(1, STEPS + 1):
            good, expected = marginals(model, features, bounds)
            slopes = [features.T @ ((good - label) * per_text) + DECAY * model.weights, (expected - seen) / max(1, len(inner)) + DECAY * model.pairs]
            for k, (values, slope) in enumerate(zip((model.weights, model.pairs), slopes)):
                moment[2 * k] += 0.1 * (slope - moment[2 * k])
                moment[2 * k + 1] += 0.01 * (slope**2 - moment[2 * k + 1])
                values -= RATE * (moment[2 * k] / (1 - 0.9**step)) / (np.sqrt(moment[2 * k + 1] / (1 - 0.99**step)) + 1e-8)
        good, _ = marginals(model, features, bounds)
        label = np.where(marks[text_of] == 1, 1.0, (good >= 0.5).astype(np.float64))
        some = np.diff(bounds) > 0
        worst = np.minimum.reduceat(good, bounds[:-1][some])
        label[(marks[text_of] == 0) & (good <= np.repeat(worst, np.diff(bounds)[some]))] = 0.0
    quality = document_quality(good, lengths, bounds)
    model.curve = _curve(quality, marks)
    return model


def _fitting(sample: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The documents, in order, that have room for all their lines. A class that loses all of its own raises."""
    taken, left = [], LINES
    for text, label in sample:
        lines = text.count("\n") + 1
        if lines <= left:
            taken.append((text, label))
            left -= lines
    if {y for _, y in taken} != {y for _, y in sample}:
        raise ValueError(f"no document of a class has at most {LINES} lines")
    return taken


def _curve(quality: np.ndarray, marks: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton's method with a small ridge."""
    x = np.stack([quality - 0.5, np.ones(len(quality))], 1)
    line = np.zeros(2)
    weight = np.where(marks == 1, 0.5 / (marks == 1).sum(), 0.5 / (marks == 0).sum())
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-4, 1e-4])
        line -= np.linalg.solve(bend, x.T @ (weight * (p - marks)) + 1e-4 * line)
    return float(line[0]), float(line[1])


def scored(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Append the score of every whole text."""
    schema = c.schema_with(docs, (out, T.DoubleType()))

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        own, lengths, bounds = line_features(c.as_bytes(c.column(batch, text)))
        if not len(own):
            return [pa.array(np.zeros(batch.num_rows))]
        good, _ = marginals(model, with_neighbours(own, bounds), bounds)
        quality = document_quality(good, lengths, bounds)
        slope, offset = model.curve
        score = 1 / (1 + np.exp(-np.clip(slope * (quality - 0.5) + offset, -30, 30)))
        return [pa.array(np.where(np.diff(bounds) > 0, score, 0.0))]

    return c.passing(docs, text, schema, work)
