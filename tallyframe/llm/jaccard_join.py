"""Links between documents whose word n-grams are alike, by a token-group matrix.

A document is the set of its distinct shingles (runs of ``words`` words); two documents link when the
Jaccard similarity of their sets is at least ``num`` / ``den``. Equal sets form one class, and only
classes are compared.

1. Meeting places. Sets that link differ in at most D shingles. The shingles are dealt into D + 1 + e
   parts by hash, so 1 + e parts agree; each part of a set becomes one signature. D follows from the
   size class of the smaller set, and a set also deals itself as the next smaller class does. Empty
   parts are left out unless a set has more than e of them, so no link is lost and no part is common
   to all. Sets that share no signature need no look at each other.
2. Groups. The class that meets most others leads each meeting place. A class belongs to the family of
   the leader that it meets most often, and is compared with that leader at once; these links give
   the components so far. A family is cut into pieces of bounded size.
3. Token-group matrix. For each piece the union of its members' shingles is stored, and which member has
   which. A class that met members of another, larger component in a family at as many places as a link
   makes certain (1 + e, less its empty parts that are left out) asks that family's pieces: its overlap with the union bounds that with every member. Only a piece that reaches what a link
   needs is opened, and the overlaps with its members are counted.
4. Links join the components.

Step 2 is the same search with pieces of one member. No step lists the pairs within a group. Pieces
with many queries are dealt to several tasks. A signature is 63 bits and the parity of its size class, a
class 64 bits; the chance that any two of n different classes share a number is n^2 / 2^65.

Defined cases: null or empty texts, and texts of white space, have no shingles and link with nothing;
with fewer words than ``words`` the whole sequence is the one shingle; rows of equal keys are rows of
their own with equal results; a null key is never a component's name unless all its keys are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as c

#: Members of a piece at most about; queries of a piece that one task takes.
PIECE, QUERIES = 256, 1_000
#: Portions of the pieces that are searched one after the other, and questions of a portion at about while they are
#: at most as many as the last; fewer bytes on disk at a time, the same work.
PORTIONS, ASKED, MAX_PORTIONS = 3, 200_000, 64
#: Rows of two numbers that a broadcast may hold; beyond it the join is shuffled.
BROADCAST_ROWS = 2_000_000
#: Classes that a task remembers to have dealt already.
SEEN = 1 << 20

_UPPER = bytes(range(65, 91))
_FOLD = bytes.maketrans(_UPPER, _UPPER.lower())
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _spread(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct shingles of every text, as 64-bit numbers."""
    data = np.frombuffer(b" ".join([*texts, b""]).translate(_FOLD), np.uint8)
    ends = np.cumsum([len(x) + 1 for x in texts])
    white = _SPACE[data]
    first = ~white
    first[1:] &= white[:-1]
    begin = np.flatnonzero(first)
    if not len(begin):
        return [np.empty(0, np.uint64)] * len(texts)
    solid = data[~white].tobytes()
    place = np.cumsum(~white)[begin] - 1
    offsets = np.append(place, len(solid)).astype(np.int64)
    folded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(solid)]).dictionary_encode()
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, folded.dictionary.to_pylist()), np.uint64, len(folded.dictionary))
    own = known[folded.indices.to_numpy()]
    factors = _spread(words)
    runs = np.zeros(len(own), np.uint64)
    for k in range(words):
        runs[: len(own) - k] += own[k:] * factors[k]
    runs = mixed(runs)
    bounds = np.searchsorted(begin, np.concatenate([[0], ends]))
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= words:
            one = np.sort(runs[a : b - words + 1])
            sets.append(one[np.concatenate([[True], one[1:] != one[:-1]])])
        elif b > a:
            sets.append(mixed((own[a:b] * factors[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            sets.append(own[:0])
    return sets


def class_of(one: np.ndarray) -> int:
    """The number of a set, equal for equal sets."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(one.tobytes())).astype(np.int64))


_DEAL = np.uint64(0x632BE59BD9B4E019)


def _part_of(shingles: np.ndarray, parts: np.ndarray | int) -> np.ndarray:
    """Which of so many parts each shingle is dealt into."""
    return (mixed(shingles + _DEAL) >> np.uint64(33)).astype(np.int64) % parts


class Parts:
    """How sets are dealt into parts: by size class, with as many parts as a link leaves one equal."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.first = [1]  # smallest size of every size class

    def size_class(self, size: int) -> int:
        while self.first[-1] <= size:
            self.first.append(self.first[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.first, size, "right")) - 1

    def parts(self, k: int) -> tuple[int, int]:
        """Number of parts of a size class, and how many of them may be empty and left out; 0 where links need equal sets."""
        largest = self.first[k + 1] - 1
        differ = (largest + largest * self.den // self.num) * (self.den - self.num) // (self.den + self.num)
        spare = 1 + differ // 12
        return (differ + 1 + spare, spare) if differ else (0, 0)

    def signatures(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(signature, index of its set) of all sets."""
        own = [self.size_class(len(x)) if len(x) else 0 for x in sets]
        found = [self._dealt(sets, [k - back for k in own]) for back in (0, 1)]
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])

    def needs(self, one: np.ndarray) -> list[int]:
        """For the even and the odd one of the size classes a set is dealt as: the least signatures it shares with a linked set."""
        found, own = [1, 1], self.size_class(len(one))
        for k in (own, own - 1):
            m, spare = self.parts(k) if k >= 0 else (0, 0)
            if m:
                empty = m - len(np.unique(_part_of(one, m)))
                found[k & 1] = 1 + spare - empty if empty <= spare else 1
        return found

    def _dealt(self, sets: list[np.ndarray], classes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        shape = [self.parts(k) if k >= 0 and len(x) else (0, 0) for k, x in zip(classes, sets)]
        use = [i for i, (m, _) in enumerate(shape) if m]
        if not use:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        sizes = np.array([len(sets[i]) for i in use])
        parts = np.array([shape[i][0] for i in use])
        begin = np.cumsum(parts) - parts
        joint = np.concatenate([sets[i] for i in use])
        part = _part_of(joint, np.repeat(parts, sizes)) + np.repeat(begin, sizes)
        total = int(parts.sum())
        tokens = mixed(mixed(joint + _DEAL))
        # sums of 32-bit halves stay exact in floating point below 2^21 shingles; larger sets add in turn
        sums = np.zeros(total, np.uint64)
        if int(sizes.max()) < 1 << 20:
            low = np.bincount(part, (tokens & np.uint64(0xFFFFFFFF)).astype(np.float64), total).astype(np.uint64)
            high = np.bincount(part, (tokens >> np.uint64(32)).astype(np.float64), total).astype(np.uint64)
            sums = low + (high << np.uint64(32))
        else:
            np.add.at(sums, part, tokens)
        empty = np.bincount(part, minlength=total) == 0
        owner = np.repeat(np.arange(len(use)), parts)
        many = np.bincount(owner, empty, len(use)) > np.array([shape[i][1] for i in use])
        keep = ~empty | many[owner]
        number = np.arange(total) - begin[owner] + np.repeat([classes[i] + 1 << 32 for i in use], parts)
        parity = np.repeat(np.array([classes[i] & 1 for i in use], np.uint64), parts)
        signature = mixed(sums ^ mixed(number.astype(np.uint64))) & ~np.uint64(1) | parity
        return signature[keep], np.array(use)[owner[keep]]


def _set_table(docs: DataFrame, words: int) -> DataFrame:
    """(key, n, class): every row, with the number of its set (null: no shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.small_batches(batches, "text"):
            sets = shingle_sets(c.as_bytes(batch.column(1)), words)
            numbers = [class_of(x) if len(x) else None for x in sets]
            columns = [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(numbers, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "class"])

    return docs.mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, n long, class long")


def _signature_table(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(signature, class): copies of a class within a task are dealt once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        parts = Parts(num, den)
        for batch in c.small_batches(batches, "text"):
            sets = {class_of(x): x for x in shingle_sets(c.as_bytes(batch.column(1)), words) if len(x)}
            new = [k for k in sets if k not in seen]
            if len(seen) > SEEN:
                seen.clear()
            seen.update(new)
            found, owner = parts.signatures([sets[k] for k in new])
            numbers = np.array(new, np.int64)[owner]
            for a in range(0, len(found), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(found[a : a + (1 << 17)].view(np.int64)), pa.array(numbers[a : a + (1 << 17)])], names=["signature", "class"])

    return docs.mapInArrow(run, "signature long, class long")


def _sets_of(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(class, shingles) of the named classes; a class may come once from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in c.small_batches(batches, "text"):
            sets = {class_of(x): x for x in shingle_sets(c.as_bytes(batch.column(1)), words) if len(x)}
            new = [k for k in sets if k not in seen]
            if len(seen) > SEEN:
                seen.clear()
            seen.update(new)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64()), pa.array([sets[k].tobytes() for k in new], pa.binary())], names=["class", "shingles"])

    return docs.mapInArrow(run, "class long, shingles binary").join(_small(classes), "class")


def _needs_of(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(class, needs): what ``Parts.needs`` says of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Parts(num, den)
        for batch in batches:
            needs = [parts.needs(np.frombuffer(x, np.uint64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(needs, pa.list_(pa.int64()))], names=["class", "needs"])

    return sets.select("class", "shingles").mapInArrow(run, "class long, needs array<long>")


def _small(df: DataFrame) -> DataFrame:
    """With a broadcast hint if it has few rows; its columns are numbers."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def needed(a: int, b: np.ndarray | int, num: int, den: int):
    """Least common shingles of linked sets of these sizes."""
    return -(-num * (a + b) // (den + num))


class Piece:
    """Members (number, order, shingles) of a group: the union of their shingles, and who has which."""

    def __init__(self, members: list[tuple[int, tuple[int, int], np.ndarray]]):
        self.numbers = np.array([x[0] for x in members], np.int64)
        self.rank = np.array([x[1][0] for x in members], np.int64)
        self.group = np.array([x[1][1] for x in members], np.int64)
        self.sizes = np.array([len(x[2]) for x in members])
        joint = np.concatenate([x[2] for x in members])
        self.union = np.unique(joint) if len(members) > 1 else joint
        self.place = np.searchsorted(self.union, joint)
        self.begin = np.cumsum(self.sizes) - self.sizes

    def links(self, order: tuple[int, int], query: np.ndarray, num: int, den: int) -> list[int]:
        """Members of a higher order that link with the query."""
        size = len(query)
        able = (self.sizes * den >= size * num) & (size * den >= self.sizes * num)
        able &= (self.rank > order[0]) | (self.rank == order[0]) & (self.group > order[1])
        if not able.any():
            return []
        at = np.searchsorted(self.union, query)
        at[at == len(self.union)] = 0
        at = at[self.union[at] == query]
        if len(at) < needed(size, int(self.sizes[able].min()), num, den):
            return []  # no member can have enough in common
        has = np.zeros(len(self.union), bool)
        has[at] = True
        common = np.add.reduceat(has[self.place], self.begin, dtype=np.int64)
        return self.numbers[able & (common >= needed(size, self.sizes, num, den))].tolist()


def search(sets: DataFrame, queries: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between queries and members (piece, class, rank, group) of the same piece.

    A query looks for members of a higher (rank, group) than its own. A piece goes, with all its
    members, to as many tasks as its queries fill; a task holds one piece at a time. The links are written.
    """
    spark, own = sets.sparkSession, c.Scratch(sets.sparkSession)
    tasks = own.written(queries.groupBy("piece").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("tasks")))
    columns = ["class", "piece", "rank", "group"]
    asked = queries.join(_small(tasks), "piece").select(*columns, F.pmod(F.xxhash64("class"), "tasks").cast("int").alias("task"), F.lit(1).alias("kind"))
    held = members.join(_small(tasks), "piece").select(*columns, F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(0).alias("kind"))
    rows = sets.join(_small(own.written(asked.unionByName(held))), "class")
    rows = rows.select("piece", "task", "kind", "class", "rank", "group", "shingles").repartition(c.partitions(spark), "piece", "task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members, piece = None, {}, None
        for batch in batches:
            found: list[tuple[int, int]] = []
            for p, t, kind, number, rank, group, data in zip(*(x.to_pylist() for x in batch.columns)):
                if (p, t) != at:
                    at, members, piece = (p, t), {}, None
                one = np.frombuffer(data, np.uint64)
                if kind == 0:
                    members[number] = (number, (rank, group), one)
                elif members:
                    piece = piece or Piece(list(members.values()))
                    found += [(max(number, x), min(number, x)) for x in piece.links((rank, group), one, num, den)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    links = c.written(rows.sortWithinPartitions("piece", "task", "kind").mapInArrow(run, "a long, b long").distinct())
    own.drop()
    return links


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every vertex that is not its component's smallest, and that smallest; from edges (a, b).

    Large stars and small stars by turns, until nothing changes; every round is written, and the one before it dropped.
    """
    own = c.Scratch(edges.sparkSession)
    edges = own.written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = None
    while (now := state(edges)) != before and now[0]:
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("low"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        last, edges = edges, own.written(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct())
        own.drop(last)
    return edges


def class_links(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(a, b): links between classes that make up all components of linked classes."""
    own = c.Scratch(docs.sparkSession)
    dealt = _signature_table(docs, words, num, den)
    same = Window.partitionBy("signature")
    met = dealt.withColumn("low", F.min("class").over(same)).withColumn("high", F.max("class").over(same))
    met = own.written(met.filter("low < high").select("signature", "class").distinct())
    # families: the leader of a place is the class that meets most others, here and elsewhere
    places = own.written(met.groupBy("signature").agg(F.count("*").alias("n")))
    weight = own.written(met.join(places, "signature").groupBy("class").agg(F.sum("n").alias("weight")))
    weighed = met.join(_small(weight), "class")
    leads = weighed.groupBy("signature").agg(F.max(F.struct("weight", "class")).alias("top"))
    pairs = met.join(leads.select("signature", F.col("top.class").alias("leader")), "signature").groupBy("class", "leader").agg(F.count("*").alias("n"))
    best = F.max(F.when(F.col("class") != F.col("leader"), F.struct("n", "leader"))).alias("best")
    family = F.coalesce("best.leader", "class").alias("family")
    families = own.written(pairs.groupBy("class").agg(best).select("class", family))
    own.drop(places, weight)
    sets = own.written(_sets_of(docs, families.select("class"), words))
    # every class with its leader
    zero = F.lit(0).cast("long")
    asked = families.filter("class <> family").select("class", F.col("family").alias("piece"), zero.alias("rank"), zero.alias("group"))
    leaders = asked.select("piece").distinct().select("piece", F.col("piece").alias("class"), F.lit(1).cast("long").alias("rank"), zero.alias("group"))
    first = search(sets, asked, leaders, num, den)
    groups = components(first).withColumnRenamed("a", "class")
    groups = families.join(groups, "class", "left").select("class", "family", F.coalesce("b", "class").alias("group"))
    sizes = groups.groupBy("group").agg(F.count("*").alias("rank"))
    needs = _needs_of(sets, num, den).dropDuplicates(["class"])  # a class may have come from several tasks
    groups = own.written(groups.join(sizes, "group").join(needs, "class"))
    pieces = own.written(groups.groupBy("family").agg(F.ceil(F.count("*") / PIECE).alias("pieces")))
    # who met a member of a higher component in a family asks all pieces of that family
    several = met.join(_small(groups), "class")
    apart = own.written(several.groupBy("signature").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low < high").select("signature"))
    several = own.written(several.join(_small(apart), "signature"))
    own.drop(met, apart)
    there = several.groupBy("signature", F.col("family").alias("other")).agg(F.max(F.struct("rank", "group")).alias("top"))
    asked = several.join(there, "signature").filter(F.struct("rank", "group") < F.col("top"))
    # at as many places of one size class as a link makes certain
    odd = F.pmod("signature", F.lit(2))
    asked = asked.withColumn("need", F.col("needs")[odd.cast("int")]).groupBy("class", "rank", "group", F.col("other").alias("family"), "need", odd).agg(F.count("*").alias("places"))
    asked = asked.filter(F.col("places") >= F.col("need")).select("class", "rank", "group", "family").distinct()
    number = lambda n: F.xxhash64("family", n)
    asked = asked.join(_small(pieces), "family").withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    asked = own.written(asked.select("class", "rank", "group", number(F.col("n")).alias("piece")))
    own.drop(several)
    members = groups.join(_small(pieces), "family").withColumn("n", F.pmod(F.xxhash64(F.lit(5), "class"), F.col("pieces")))
    members = own.written(members.select("class", "rank", "group", number(F.col("n")).alias("piece")))
    links = first  # pieces know nothing of each other: a portion's sets leave the disks before the next is shuffled
    portions = min(max(PORTIONS, -(-asked.count() // ASKED)), MAX_PORTIONS)
    for k in range(portions):
        asked_here, members_here = (x.filter(F.pmod(F.xxhash64(F.lit(11), "piece"), F.lit(portions)) == k) for x in (asked, members))
        links = links.unionByName(search(sets, asked_here, members_here, num, den))
    own.drop()
    return links


def joined(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(key, n_shingles, component_id) for every row: the smallest key that links reach."""
    if not 0 < num <= den or words < 1:
        raise ValueError("the similarity must be above 0 and at most 1, of at least one word")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    table = c.written(_set_table(rows, words))
    ends = components(class_links(rows, words, num, den)).select(F.col("a").alias("class"), F.col("b").alias("root"))
    classes = table.filter("class is not null").groupBy("class").agg(F.min("key").alias("first"))
    rooted = classes.join(ends, "class", "left").withColumn("root", F.coalesce("root", "class"))
    names = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.join(names, "root").select("class", "component")
    return table.join(named, "class", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component_id")
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows that stay when one document of every component does: that with the smallest key.

    Rows go by themselves, not by their key: of rows that share the smallest key of a component one
    stays, and a row of no component stays whatever becomes of others with its key. Rows of a null
    key stay.
    """
    row, own = c.fresh(docs, "row"), F.col(key)
    tagged = c.written(docs.withColumn(row, F.monotonically_increasing_id()))  # numbers that stay the same
    ends = joined(tagged, row, text, words, num, den).select(row, "component_id")
    keys = tagged.filter(own.isNotNull()).select(F.col(row), own.alias("__key"))
    named = c.written(keys.join(ends, row))
    firsts = named.groupBy("component_id").agg(F.count("*").alias("rows"), F.min(F.struct("__key", row)).alias("first"))
    firsts = c.written(firsts.filter("rows > 1").select("component_id", F.col(f"first.{row}").alias("first")))
    gone = c.written(named.join(_small(firsts), "component_id").filter(F.col(row) != F.col("first")).select(row))
    return tagged.join(_small(gone), row, "left_anti").select(*docs.columns)
