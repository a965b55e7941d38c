"""Language by rank order of n-grams.

A profile is the list of a language's most frequent n-grams of one to three letters, most frequent
first (ties: smaller gram first); word ends count as a mark. A document's own list is compared with
every profile: a gram at rank i of the one and rank j of the other costs |i - j|, a gram that the
profile lacks costs PROFILE. The nearest profile is the language (ties: first in the alphabet).

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is everything when
nothing was learned; rows without a language are not learned from; repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

PROFILE = 300
UNKNOWN = "und"
#: Distinct grams that a training task holds before it passes its counts on.
HELD = 1 << 20

_LETTER: list[np.ndarray] = []


def grams(text: str) -> np.ndarray:
    """All n-grams of one to three letters, as one number each: 21 bits a letter, 0 for a word end."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")
    codes = np.where(_LETTER[0][codes], codes, 0).astype(np.int64)
    keep = codes != 0
    keep[1:] |= codes[:-1] != 0  # of a run of other characters one stays
    keep[0] = True
    codes = codes[keep]
    one = codes[codes != 0]
    a, b = codes[:-1], codes[1:]
    two = a << 21 | b
    three = (two[:-1] << 21 | codes[2:])[b[:-1] != 0]
    # a mark in front of the letters tells the lengths apart: "_a" is not "a"
    return np.concatenate([one, two[(a != 0) | (b != 0)] | 1 << 42, three | -1 << 63])


def ranked(text: str, size: int = PROFILE) -> np.ndarray:
    """The text's most frequent grams, most frequent first."""
    found, counts = np.unique(grams(text), return_counts=True)
    return found[np.argsort(-counts, kind="stable")[:size]]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles from all rows with a language: counts per task, added up by Spark; only the tops are collected."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        waiting = 0

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return keys, np.bincount(place, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                keys, counts = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], names=["lang", "gram", "n"])

        for batch in c.small_batches(batches, "text"):
            by: dict[str, list[np.ndarray]] = {}
            for one, name in zip(c.as_texts(batch.column(0)), batch.column(1).to_pylist()):
                by.setdefault(name, []).append(grams(one))
            for name, parts in by.items():
                keys, counts = np.unique(np.concatenate(parts), return_counts=True)
                held.setdefault(name, []).append((keys, counts))
                waiting += len(keys)
            if waiting > HELD:
                held = {name: [merged(parts)] for name, parts in held.items()}
                waiting = sum(len(p[0][0]) for p in held.values())
                if waiting > HELD // 2:
                    yield from out()
                    held, waiting = {}, 0
        yield from out()

    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).filter("lang is not null and text is not null")
    sums = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    tops = sums.withColumn("rank", rank).filter(F.col("rank") <= size).collect()  # at most size rows a language
    profiles: dict[str, list] = {}
    for row in tops:
        profiles.setdefault(row["lang"], []).append((row["rank"], row["gram"]))
    return {name: np.array([g for _, g in sorted(profiles[name])], np.int64) for name in sorted(profiles)}


class Distances:
    """Out-of-place distances of one text to all profiles."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.names, self.size = list(profiles), size
        self.known = np.unique(np.concatenate([*profiles.values(), np.empty(0, np.int64)]))
        self.ranks = np.full((len(self.known) + 1, len(self.names)), -1, np.int64)  # the last row: no profile has it
        for k, profile in enumerate(profiles.values()):
            self.ranks[np.searchsorted(self.known, profile), k] = np.arange(len(profile))

    def __call__(self, own: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, own)
        at[at == len(self.known)] = -1
        at[self.known[at] != own] = len(self.known)
        ranks = self.ranks[at]
        return np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)

    def nearest(self, text: str) -> tuple[str, float]:
        """The language, and by how much its distance falls short of the largest there can be."""
        own = ranked(text, self.size) if self.names else ()
        if not len(own):
            return UNKNOWN, 0.0
        away = self(own)
        best = int(away.argmin())
        return self.names[best], 1.0 - float(away[best]) / (self.size * len(own))


def identified(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", out: tuple[str, str] = ("lang_pred", "score"), size: int = PROFILE) -> DataFrame:
    """Append the language and its score to every row."""
    schema = c.schema_with(docs, (out[0], T.StringType()), (out[1], T.DoubleType()))
    ready: list[Distances] = []

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        if not ready:
            ready.append(Distances(profiles, size))
        found = [ready[0].nearest(x) for x in c.as_texts(c.column(batch, text))]
        return [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]

    return c.passing(docs, text, schema, work)
