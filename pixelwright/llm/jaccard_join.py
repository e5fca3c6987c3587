"""Exact n-gram Jaccard self-join with prefix trees, and the components of its links.

A document is the set of 64-bit hashes of its word shingles. Two sets link when their Jaccard
index is at least 0.8. The join is exact; no candidate, partner or bucket is capped.

1. One scan gives each document its set's size and digest (equal sets are one class from here
   on, however many copies there are) and counts shingles, packed as bytes. The counts are kept
   as two tables of bits of fixed size: shingles of several classes, and of at least COMMON. Two
   shingles may fall on one bit, which only makes the order below worse.
2. In the global order come the shingles of one class only, then the others by hash, the common
   ones last. Linked sets share one of the first n - ceil(0.8 n) + 1 in any such order; of these
   the shingles of one class can't be the shared one, so they need no key, and most documents,
   having enough of them, need no key at all. Classes that meet in a key, and whose sizes lie in
   one stretch without a gap wider than the threshold allows, form a group under the least of
   them, the leader; a class is in as many groups as it has leaders. Any two linked classes meet
   in the group of their shared key's leader. Leaders are found by minima per key and size,
   which are pre-aggregated before the shuffle, so that no key's classes come together in a task.
3. A group's sets are stored in a compressed prefix tree, in an order of its own with shared
   shingles first, so that near copies share long paths. Each set walks the tree: a node's
   overlap is computed once for all sets below it, and a subtree is left when the overlap and
   the remaining lengths can no longer reach the threshold, or all its sets are already known
   to be in the walker's component. Groups give forests of links, not all pairs.
4. A group of more than CHUNK shingles or CHUNK_ROWS classes is dealt out by hash to chunks; each
   chunk is joined in itself and with a few pivots of the group, so a huge group of near copies
   costs little more than its size. Any link still missing has an end outside the group's largest
   component. Where few classes are outside, they meet every chunk. Where that would be more rows
   than DEALT times the group, the group is keyed again by itself: its shingles are counted
   within the group, each class sends those of its first ones in the order of these counts that
   are not its own alone, and the classes that meet in one form smaller groups, which are treated
   alike (and there the few meet every chunk). Both ways are exact. Rows of a group meet its
   figures by group and salt.
5. Links are between the classes' least doc_ids; components come from alternating stars, whose
   roots are the least doc_ids and so the components' ids.

Cases: null text, or text without words, is the empty set and linked with nothing; fewer words
than a shingle are one shingle; equal sets always link; repeated rows are equal sets; the sets
of rows with the same id count as linked where that id is their classes' least; very long texts are
handled whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_files, lean, materialize, pick, table, text_parts, utf8
from .components import components

WORDS = 5
#: The threshold as a fraction: 100 * intersection >= 80 * union, so 9 * intersection >= 4 * (sizes together).
NUMERATOR, DENOMINATOR = 4, 5
#: Two tables of bits say which shingles are shared by several classes, and which by at least COMMON. The first has a bit
#: for each shingle of the corpus, within these bounds (2 and 128 MB); the second, an eighth of that, is at most an eighth full.
LEAST_BITS, MOST_BITS = 1 << 24, 1 << 30
COMMON = 48
#: Shingles, and classes, of one chunk of a group.
CHUNK = 1 << 21
CHUNK_ROWS = 512
PIVOTS = 8
#: Rows that classes outside the largest component may make in a group's chunks, as a multiple of its classes.
DEALT = 4
#: A large group's rows are dealt out to so many tasks where they meet its figures.
SALTS = 64
#: Bytes of input for each target of counted shingles; and the most targets.
TARGET_BYTES, MOST_TARGETS = 1 << 24, (1 << 16) - 1
#: Shingles that a task holds before it hands them on.
BUFFER = 1 << 19

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _WordHashes(dict):
    """word -> 64-bit hash; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 17:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(data: bytes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text's UTF-8 bytes."""
    found = []
    for part in text_parts(data):
        words = part.lower().split()  # on bytes: A-Z only, and splits at 0x20 and 0x09 to 0x0D
        found.append(np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words)))
    w = found[0] if len(found) == 1 else np.concatenate(found)
    n = len(w)
    if not n:
        return np.empty(0, np.uint64)
    k = min(n, WORDS)
    h = np.full(n - k + 1, 0 if n >= WORDS else n * 0x51ED270B, np.uint64)
    for i in range(k):
        h += w[i : n - k + 1 + i] * _MULTIPLIERS[i]
    return np.unique(_mix(h))


def digest(s: np.ndarray) -> int:
    """A signed 64-bit digest of a set."""
    return xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s)) - (1 << 63)


# -- 1. sizes, digests and counts -------------------------------------------------------


def _target(s: np.ndarray, targets: int) -> np.ndarray:
    """Which of the targets (65535 at most) gets a shingle, by its upper half; ascending in the shingle."""
    return (((s >> np.uint64(32)) * np.uint64(targets)) >> np.uint64(32)).astype(np.uint16)


def _part(bits: int, targets: int) -> int:
    """Bits of a table for each target, whole bytes."""
    return max(8, bits // targets // 8 * 8)


def _bit(s: np.ndarray, targets: int, bits: int) -> np.ndarray:
    """Place of a shingle in a table of bits: its target's part, then its lower half."""
    part = _part(bits, targets)
    return _target(s, targets).astype(np.int64) * part + ((s & np.uint64(0xFFFFFFFF)) * np.uint64(part) >> np.uint64(32)).astype(np.int64)


def _holds(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


_SUMMARY = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d", pa.int64()), ("target", pa.int32()), ("packed", pa.binary())])


def _summary(targets: int, common_from: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        seen: set[int] = set()

        def counted() -> pa.RecordBatch:
            s = np.concatenate(held)
            s.sort()
            if len(s) > common_from:  # more copies of a shingle than make it common say nothing new
                s = s[np.concatenate([np.ones(common_from, bool), s[common_from:] != s[:-common_from]])]
            t = _target(s, targets)
            s = (s & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            cuts = np.flatnonzero(np.diff(t, prepend=-1))
            parts = [x.tobytes() for x in np.split(s, cuts[1:])]
            none = [None] * len(parts)
            return pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip((none, none, none, t[cuts], parts), _SUMMARY.types)], schema=_SUMMARY)

        for batch in batches:
            ids, sizes, digests = batch.column(0).to_pylist(), [], []
            for value in batch.column(1):
                s = shingles(value.as_py())
                d = digest(s)
                sizes.append(len(s))
                digests.append(d)
                if len(s) and d not in seen:  # copies in one task count once
                    if len(seen) > 1 << 16:
                        seen.clear()
                    seen.add(d)
                    held.append(s)
                    size += len(s)
                    if size > BUFFER:
                        yield counted()
                        held.clear()
                        size = 0
            none = [None] * len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip((ids, sizes, digests, none, none), _SUMMARY.types)], schema=_SUMMARY)
        if held:
            yield counted()

    return run


def _tables(targets: int, shared_bits: int, common_bits: int, common_from: int):
    """Each target's parts of the two tables of bits; the input is sorted by target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for target, parts in _runs(batches):
            keys, counts = np.unique(np.concatenate([np.frombuffer(p, np.uint32) for p in parts]), return_counts=True)
            made = []
            for bits, least in ((shared_bits, 2), (common_bits, common_from)):
                part = _part(bits, targets)
                if least > 2 and (counts >= least).sum() > part // 8:
                    least = int(np.partition(counts, -(part // 8))[-(part // 8)]) + 1
                flags = np.zeros(part, bool)
                flags[(keys[counts >= least].astype(np.uint64) * np.uint64(part) >> np.uint64(32)).astype(np.int64)] = True
                made.append(np.packbits(flags, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([target], pa.int32()), *(pa.array([m], pa.binary()) for m in made)], names=["target", "shared", "common"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """(target, packed values) for runs of equal targets."""
    at, parts = None, []
    for batch in batches:
        for target, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if target != at and parts:
                yield at, parts
                parts = []
            at = target
            parts.append(packed)
    if parts:
        yield at, parts


# -- 2. keys and groups -----------------------------------------------------------------


def prefix_length(n: int) -> int:
    """Linked sets share one of so many first shingles."""
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


_POSTING = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("d", pa.int64())])


def _postings(targets: int, shared_bits: int, common_bits: int, tables):
    """(key, size, class) for each key of each class, once for each task that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, common = tables.value
        seen: set[int] = set()
        for batch in batches:
            held: list[tuple[np.ndarray, int, int]] = []
            for value in batch.column(0):
                s = shingles(value.as_py())
                if not len(s):
                    continue
                d = digest(s)
                if d in seen:
                    continue
                if len(seen) > 1 << 16:
                    seen.clear()
                seen.add(d)
                # alone in its class, a shingle links nothing: such ones come first and need no posting
                some = s[_holds(shared, _bit(s, targets, shared_bits))]
                wanted = prefix_length(len(s)) - (len(s) - len(some))
                if wanted <= 0:
                    continue
                late = _holds(common, _bit(some, targets, common_bits))
                held.append((np.concatenate([some[~late], some[late]])[:wanted], len(s), d))
            if held:
                lengths = [len(h[0]) for h in held]
                columns = np.concatenate([h[0] for h in held]).view(np.int64), np.repeat([h[1] for h in held], lengths), np.repeat([h[2] for h in held], lengths)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_POSTING)

    return run


def _groups(postings: DataFrame) -> DataFrame:
    """Distinct (leader, member, n) of the keys' groups of two classes or more; a leader is a member of its group.

    By size a key falls into stretches: sets further apart than the threshold allows can't link.
    """
    by_size = postings.groupBy("key", "n").agg(F.min("d").alias("low"), F.max("d").alias("high"))
    along = Window.partitionBy("key").orderBy("n")
    before = F.lag("n").over(along)
    fresh = F.when(before.isNull() | (NUMERATOR * F.col("n") > DENOMINATOR * before), 1).otherwise(0)
    stretch = by_size.withColumn("fresh", fresh).withColumn("stretch", F.sum("fresh").over(along))
    whole = Window.partitionBy("key", "stretch")
    leaders = stretch.select("key", "n", F.min("low").over(whole).alias("leader"), F.max("high").over(whole).alias("last")).where("leader < last")
    return postings.join(leaders.drop("last"), ["key", "n"]).select("leader", F.col("d").alias("member"), "n").distinct()


# -- 3. the prefix tree -----------------------------------------------------------------


class PrefixTree:
    """A compressed trie of distinct sets of small ordered integers.

    A node's elements are pool[start:end]; below it are the sets first..last (in lexicographic
    order), and the set done ends in it, if not -1. Nodes are numbered so that a node's children
    are children[child_from:child_to].
    """

    def __init__(self, sets: list[np.ndarray], vocabulary: int):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        ordered = [sets[i] for i in self.order]
        self.sets, self.vocabulary = ordered, vocabulary
        self.size = np.array([len(s) for s in ordered], np.int64)
        depth, parent, first, last, done = [0], [-1], [0], [len(ordered) - 1], [-1]
        path = [0]
        previous = np.empty(0, np.uint32)
        for k, s in enumerate(ordered):
            m = min(len(previous), len(s))
            differ = np.flatnonzero(previous[:m] != s[:m])
            shared = int(differ[0]) if len(differ) else m
            while depth[path[-1]] > shared:
                below = path.pop()
                last[below] = k - 1
                if depth[path[-1]] < shared:  # the paths part inside this node: cut it
                    depth.append(shared), parent.append(path[-1]), first.append(first[below]), last.append(-1), done.append(-1)
                    parent[below] = len(depth) - 1
                    path.append(len(depth) - 1)
            depth.append(len(s)), parent.append(path[-1]), first.append(k), last.append(-1), done.append(k)
            path.append(len(depth) - 1)
            previous = s
        for node in path[1:]:
            last[node] = len(ordered) - 1
        self.depth, self.first, self.last, self.done = (np.array(x, np.int64) for x in (depth, first, last, done))
        parents = np.array(parent, np.int64)
        top = self.depth[np.maximum(parents, 0)]
        self.pool = np.concatenate([ordered[f][a:b] for f, a, b in zip(first, top.tolist(), depth)])
        self.end = np.cumsum(self.depth - top * (parents >= 0))
        self.start = self.end - (self.depth - top * (parents >= 0))
        self.children = np.argsort(parents, kind="stable")[1:]
        count = np.bincount(parents[1:], minlength=len(depth))
        self.child_to = np.cumsum(count)
        self.child_from = self.child_to - count
        below = np.stack([self.first, self.last + 1], axis=1).ravel()
        self.longest = np.maximum.reduceat(np.append(self.size, 0), below)[::2]
        self.shortest = np.minimum.reduceat(np.append(self.size, 1 << 60), below)[::2]
        self._held = np.zeros(vocabulary, bool)

    @staticmethod
    def _spread(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All positions of the ranges one after the other, and where each range begins there."""
        lengths = end - start
        to = np.cumsum(lengths)
        return np.arange(to[-1] if len(to) else 0) + np.repeat(start - to + lengths, lengths), to - lengths

    def walk(self, r: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Numbers of the wanted sets (a mask, in the tree's order) that link with the set r."""
        n = len(r)
        least, most = -(-NUMERATOR * n // DENOMINATOR), DENOMINATOR * n // NUMERATOR
        held = self._held
        held[r] = True
        open_ = np.concatenate([[0], np.cumsum(wanted & (self.size >= least) & (self.size <= most))])
        found = []
        nodes, overlap = np.array([0]), np.array([0])
        while len(nodes):
            counts = self.child_to[nodes] - self.child_from[nodes]
            at, _ = self._spread(self.child_from[nodes], self.child_to[nodes])
            overlap, nodes = np.repeat(overlap, counts), self.children[at]
            some = open_[self.last[nodes] + 1] > open_[self.first[nodes]]
            nodes, overlap = nodes[some], overlap[some]
            if not len(nodes):
                break
            at, begins = self._spread(self.start[nodes], self.end[nodes])
            overlap = overlap + np.add.reduceat(held[self.pool[at]].astype(np.int64), begins)
            # lengths that remain on both sides bound what the overlap can become below
            rest = n - np.searchsorted(r, self.pool[self.end[nodes] - 1], side="right")
            best = overlap + np.minimum(self.longest[nodes] - self.depth[nodes], rest)
            alive = 9 * best >= 4 * (n + np.maximum(self.shortest[nodes], least))
            nodes, overlap = nodes[alive], overlap[alive]
            ends = self.done[nodes]
            hit = (ends >= 0) & (9 * overlap >= 4 * (n + self.size[ends])) & wanted[ends]
            found.append(ends[hit])
        held[r] = False
        return np.concatenate(found) if found else np.empty(0, np.int64)


def forest(sets: list[np.ndarray], walkers: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (by number) that connect all linked sets; given walkers (a mask), at least those with a walker at one end.

    The first set walks, then sets outside the largest component of the moment, until all sets
    outside it have walked, as any link that is missing has one end outside.
    """
    everything = np.concatenate(sets)
    values, inverse, counts = np.unique(everything, return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.uint32)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(values), dtype=np.uint32)
    local = [np.sort(x) for x in np.split(rank[inverse], np.cumsum([len(s) for s in sets])[:-1])]
    tree = PrefixTree(local, len(values))
    place = {i: k for k, i in enumerate(tree.order)}
    label = np.arange(len(sets))  # in the tree's order
    links: list[tuple[int, int]] = []

    def walk(i: int) -> None:
        k = place[i]
        for other in tree.walk(tree.sets[k], label != label[k]).tolist():
            links.append((i, tree.order[other]))
            if label[other] != label[k]:
                label[label == label[other]] = label[k]

    if walkers is not None:
        for i in np.flatnonzero(walkers).tolist():
            walk(i)
        return links
    waiting, i = set(range(len(sets))), 0
    while True:
        walk(i)
        waiting.discard(i)
        main = np.bincount(label).argmax()
        i = next((j for j in waiting if label[place[j]] != main), None)
        if i is None:
            return links


# -- 4. groups --------------------------------------------------------------------------


def _join_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links, by the classes' least ids, of runs of (leader, chunk). Columns: leader, chunk, whole, member, walker, rep, text."""
    for whole, members in _group_runs(batches):
        if len(members) < 2:
            continue
        sets, walkers, ids = zip(*members.values())
        links = sorted({(ids[a], ids[b]) for a, b in forest(list(sets), None if whole else np.array(walkers)) if ids[a] != ids[b]})
        if links:
            a, b = zip(*links)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _group_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict[int, tuple[np.ndarray, bool, int]]]]:
    """Whether all sets walk, and member -> (set, walks, id) of each run."""
    at: tuple | None = None
    members: dict[int, tuple[np.ndarray, bool, int]] = {}
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(6)]
        for leader, chunk, whole, member, walker, rep, text in zip(*columns, batch.column(6)):
            key = (leader, chunk, whole)
            if key != at:
                if members:
                    yield at[2], members
                at, members = key, {}
            if member in members:
                held = members[member]
                members[member] = (held[0], held[1] or walker, held[2])
                continue
            s = shingles(text.as_py())
            if digest(s) == member:  # another row with the same id may hold another text
                members[member] = (s, walker, rep)
    if members:
        yield at[2], members


def _links(dealt: DataFrame, docs: DataFrame, classes: DataFrame, all_documents: bool) -> tuple[DataFrame, list[DataFrame]]:
    """Links a, b within (leader, chunk, whole), and the tables written for them; dealt: leader, chunk, whole, member, walker.

    With ``all_documents`` the deal grows with the corpus, and the texts meet it by a sort-merge
    join at every size. Otherwise it is written first, so that the planner knows its size.
    """
    named = dealt.join(classes.select(F.col("d").alias("member"), "rep"), "member")
    written = [] if all_documents else [materialize(named, "dealt")]
    named = named.hint("merge") if all_documents else written[0]
    rows = docs.select(F.col("doc_id").alias("rep"), utf8("text").alias("_bytes")).join(named, "rep")
    rows = rows.select("leader", "chunk", "whole", "member", "walker", "rep", "_bytes")
    rows = rows.repartition("leader", "chunk").sortWithinPartitions("leader", "chunk", "member")
    return materialize(rows.mapInArrow(_join_groups, "a long, b long"), "links"), written


def _gather(parts: DataFrame, targets: int, *bits: int) -> list[np.ndarray]:
    """The whole tables of bits: the same few bytes for any input."""
    sizes = [_part(b, targets) // 8 for b in bits]
    tables = [np.zeros(size * targets, np.uint8) for size in sizes]
    for row in parts.toLocalIterator():
        for k, size in enumerate(sizes):
            tables[k][row[0] * size : (row[0] + 1) * size] = np.frombuffer(row[1 + k], np.uint8)
    return tables


def similar_components(docs: DataFrame, chunk: int = CHUNK, chunk_rows: int = CHUNK_ROWS, common_from: int = COMMON, shared_bits: int | None = None, common_bits: int | None = None, dealt: int = DEALT) -> DataFrame:
    """docs: doc_id, text. Per row: doc_id, n_shingles, component_id. The other parameters steer the work, not the result."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # the planner's estimate
    targets = min(max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // TARGET_BYTES), MOST_TARGETS)

    scanned = materialize(docs.select("doc_id", utf8("text").alias("_bytes")).mapInArrow(_summary(targets, common_from), "doc_id long, n long, d long, target int, packed binary"), "sets")
    summary = materialize(scanned.where("target is null").select("doc_id", "n", "d"), "summary")
    shingles_ = summary.agg(F.sum("n")).first()[0] or 0
    shared_bits = shared_bits or min(max(LEAST_BITS, 1 << int(shingles_).bit_length()), MOST_BITS)
    common_bits = common_bits or shared_bits // 8
    counted = scanned.where("target is not null").select("target", "packed").repartition("target").sortWithinPartitions("target")
    tables = spark.sparkContext.broadcast(_gather(counted.mapInArrow(_tables(targets, shared_bits, common_bits, common_from), "target int, shared binary, common binary"), targets, shared_bits, common_bits))
    drop_files(scanned)  # the packed shingles are as large as the texts

    postings = materialize(docs.select(utf8("text").alias("_bytes")).mapInArrow(_postings(targets, shared_bits, common_bits, tables), "key long, n long, d long"), "postings")
    classes = summary.where("n > 0").groupBy("d").agg(F.min("doc_id").alias("rep"))
    edges, done = _linked(postings, docs, classes, None, chunk, chunk_rows, dealt)
    labels = components(edges)
    for table_ in done:
        drop_files(table_)

    by_class = classes.join(labels, classes["rep"] == labels["node"], "left").select("d", F.coalesce("root", "rep").alias("component_id"))
    return (
        summary.join(by_class, "d", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    )


def _linked(postings: DataFrame, docs: DataFrame, classes: DataFrame, known: DataFrame | None, chunk: int, chunk_rows: int, dealt_most: int | None) -> tuple[DataFrame, list[DataFrame]]:
    """All links between classes that share a posting's key, besides those known, and the tables written meanwhile.

    With ``dealt_most`` None, classes outside the largest component meet every chunk, however many they are.
    """
    groups = materialize(_groups(postings), "groups")
    drop_files(postings)
    more = F.greatest(F.sum("n") / chunk, F.count(F.lit(1)) / chunk_rows).cast("int")
    large = groups.groupBy("leader").agg(more.alias("more")).where("more > 0")
    dealt = _with_figures(groups.withColumn("h", F.xxhash64("member")), large, "left").withColumn("more", F.coalesce("more", F.lit(0)))
    edges, used = _links(_first_deal(dealt), docs, classes, all_documents=True)
    done = [groups, edges, *used]
    if known is not None:
        edges = edges.unionByName(known)
    large_rows = dealt.where("more > 0")
    if not large_rows.limit(1).count():
        return edges, done
    labels = components(edges)
    outside, marked = _outside(large_rows.join(classes, dealt["member"] == classes["d"]), labels)
    drop_files(labels)
    done += [outside, marked]
    costly = F.lit(False) if dealt_most is None else F.col("n_outside") * (F.col("more") + 1) > F.lit(dealt_most) * F.col("members")
    again = materialize(_second_deal(outside.where(~costly)), "again")
    done.append(again)
    if again.limit(1).count():
        found, used = _links(again, docs, classes, all_documents=False)
        done += [found, *used]
        edges = edges.unionByName(found)
    if dealt_most is not None:
        rest = outside.where(costly).select("leader", "member")
        if rest.limit(1).count():
            edges, used = _linked(_keyed_again(rest, docs, classes), docs, classes, edges, chunk, chunk_rows, None)
            done += used
    return edges, done


def _keyed_again(members: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Postings (key, n, d) of groups by the counts of their shingles within the group; members: leader, member.

    Shingles of one class come first and link nothing; the others follow by count, so that what
    all share comes last. A group's shingles are as many as its texts', and are written once.
    """
    named = materialize(members.join(classes.select(F.col("d").alias("member"), "rep"), "member"), "rekeyed")
    rows = docs.select(F.col("doc_id").alias("rep"), utf8("text").alias("_bytes")).join(named, "rep").select("leader", "member", "_bytes")
    items = materialize(rows.mapInArrow(_items, "leader long, d long, n long, key long").distinct(), "items")
    counts = items.groupBy("leader", "key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = items.join(counts, ["leader", "key"]).groupBy("leader", "d", "n").agg(F.sort_array(F.collect_list(F.struct("c", "key"))).alias("k"))
    first = F.col("n") - F.ceil(F.col("n") * F.lit(NUMERATOR) / F.lit(DENOMINATOR)) + 1 - (F.col("n") - F.size("k"))
    keys = shared.select("leader", "n", "d", F.explode(F.slice("k", F.lit(1), F.greatest(first, F.lit(0)).cast("int"))).alias("k"))
    postings = materialize(keys.select(F.xxhash64("leader", "k.key").alias("key"), "n", "d"), "postings-again")
    drop_files(items)
    drop_files(named)
    return postings


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(leader, class, size, shingle) of each member of a group."""
    for batch in batches:
        for leader, member, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            s = shingles(text.as_py())
            if digest(s) != member:  # another row with the same id
                continue
            for start in range(0, len(s), BUFFER):
                part = s[start : start + BUFFER].view(np.int64)
                fixed = [pa.array(np.full(len(part), v, np.int64)) for v in (leader, member, len(s))]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(part)], names=["leader", "d", "n", "key"])


def _with_figures(rows: DataFrame, figures: DataFrame, how: str = "inner") -> DataFrame:
    """rows (leader, h ...) with one row of figures for each leader, joined by leader and salt: a group's rows go to SALTS tasks."""
    salt = F.pmod("h", F.lit(SALTS)).cast("int")
    copies = figures.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", salt).join(copies, ["leader", "salt"], how).drop("salt")


def _first_deal(dealt: DataFrame) -> DataFrame:
    """Groups in chunks by hash, each with the group's pivots: its leader and the least of its hashes."""
    own = dealt.select("leader", F.pmod("h", F.col("more") + 1).cast("int").alias("chunk"), "member")
    large = dealt.where("more > 0")
    low = large.where(F.col("h") < F.lit(-(1 << 63)) + F.lit((1 << 64) // 64).cast("decimal(38,0)") / (F.col("more") + 1))
    least = low.groupBy("leader").agg(F.max("more").alias("more"), F.slice(F.sort_array(F.collect_set(F.struct("h", "member"))), 1, PIVOTS).alias("p"))
    pivots = least.select("leader", "more", F.explode("p.member").alias("member")).unionByName(large.where("member = leader").select("leader", "more", "member"))
    copies = pivots.select("leader", F.explode(F.sequence(F.lit(0), F.col("more"))).alias("chunk"), "member")
    return own.unionByName(copies).distinct().select("leader", "chunk", F.lit(True).alias("whole"), "member", F.lit(True).alias("walker"))


def _outside(large: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups in several chunks with more than one component so far: leader, member, more, h, out (outside the largest), members, n_outside. And the table behind it."""
    marked = large.join(labels, large["rep"] == labels["node"], "left").select("leader", "member", "more", "h", F.coalesce("root", "rep").alias("root"))
    marked = materialize(marked, "marked")
    by_root = marked.groupBy("leader", "root").agg(F.count(F.lit(1)).alias("c"))
    largest = by_root.groupBy("leader").agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("members")).where("m.c < members")
    figures = largest.select("leader", F.col("m.root").alias("main"), "members", (F.col("members") - F.col("m.c")).alias("n_outside"))
    found = _with_figures(marked, figures).select("leader", "member", "more", "h", (F.col("root") != F.col("main")).alias("out"), "members", "n_outside")
    return materialize(found, "outside"), marked


def _second_deal(some: DataFrame) -> DataFrame:
    """Every class outside its group's largest component walks in every chunk of the group."""
    chunks = F.explode(F.sequence(F.lit(0), F.col("more"))).alias("chunk")
    walkers = some.where("out").select("leader", chunks, "member", F.lit(True).alias("walker"))
    stay = some.select("leader", F.pmod("h", F.col("more") + 1).cast("int").alias("chunk"), "member", F.lit(False).alias("walker"))
    every = stay.unionByName(walkers).groupBy("leader", "chunk", "member").agg(F.max("walker").alias("walker"))
    return every.select("leader", "chunk", F.lit(False).alias("whole"), "member", "walker")


def op9(spark, sf_dir: str) -> DataFrame:
    lean(spark)
    return similar_components(pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the row with the least id stays, once; all columns kept.

    Rows are joined by a hash of id and text, so rows of one id with different texts are told apart.
    Rows without an id come after the others of their component. Texts without shingles are linked to
    nothing: equal rows with an id stay once, and every such row without an id stays.
    """
    lean(spark)
    keyed = docs.withColumn("_row_key", F.xxhash64("doc_id", "text"))
    found = similar_components(keyed.select(F.col("_row_key").alias("doc_id"), "text")).distinct()
    ids = keyed.select("_row_key", F.col("doc_id").cast("long").alias("_id")).distinct()
    least = F.min(F.struct(F.col("_id").isNull().alias("late"), "_id", "_row_key")).alias("m")
    kept = ids.join(found.withColumnRenamed("doc_id", "_row_key"), "_row_key").groupBy("component_id").agg(least, F.max("n_shingles").alias("n"))
    kept = kept.select("m._row_key", (F.col("m.late") & (F.col("n") == 0)).alias("_each"))
    once = F.when(F.col("_each"), F.monotonically_increasing_id()).otherwise(F.lit(-1))
    return keyed.join(kept, "_row_key").withColumn("_once", once).dropDuplicates(["_row_key", "_once"]).select(*docs.columns)
