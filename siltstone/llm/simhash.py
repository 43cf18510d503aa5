"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints: XXH64 of each four-word shingle; a bit of the fingerprint is 1
if it is set in over half of them.

Links (at most ``distance`` differing bits) are found exactly. The 64 bits are
cut into ``parts``; two linked fingerprints agree in all but ``distance`` of
them, so each choice of ``parts - distance`` parts is one way to deal
fingerprints to groups, and each linked pair meets in some group. ``parts``
grows with the number of fingerprints, so that groups stay small; it changes
the cost, never the links.

Inside a group the fingerprints are sorted by Gray rank (their place in the
reflected Gray sequence), which puts those that share leading bits, and
neighbours across a carry, side by side. Runs that share their leading bits
are nodes of a hierarchy: an upper node holds the shared, masked bit pattern
once. Pairs of nodes are compared level by level on those patterns; the
differences accumulate on the way down and a pair over ``distance`` is dropped
with all that lies below it. Links go into a union-find at once and leave the
task as at most one edge for each fingerprint. A group too large for one task
is split into blocks, and each pair of blocks is a group of its own.

Components of the edges are found by alternating large-star and small-star
steps, each written to the shared folder.

`similar_texts` links by similarity instead: distinct texts whose sets of
shingles have a Jaccard similarity of 0.8 or more. That is some 10 of 64 bits,
and up to 24 in rare cases, too wide a radius for dealing by agreeing parts.
So texts meet where two minimum shingle hashes agree, in one of ``WAYS`` ways
(a pair of similarity 0.8 meets with probability 0.9997), the same index prunes
each group by the first word of a fingerprint of ``WIDE`` words, and all its
words measure the pairs that are left. Of these a task keeps the minimum
spanning forest, and every link of it that the wide fingerprint doesn't settle
by itself is verified by the exact similarity of the two sets. That gives most
of every class at little cost, but not all links: texts may not meet, short
sets may have far fingerprints, and the forest may hold a pair below the bound
in place of one above it. So an exact step follows. All sets are put into one
order, rare shingles first; two sets similar enough share a shingle among the
leading fifth of each (prefix filter), at places that leave room for the rest
of their overlap. All pairs that meet there in different classes are verified
by their sets, which completes the classes. How frequent a shingle is comes
from a sample and sets only the order: any order gives the same links.

Edge cases: null, empty and blank texts have fingerprint zero, and it is
linked like any other; fewer than four words are one shingle; texts are read
whole; equal fingerprints are one node, so copies cost no pairs; rows that
repeat a doc_id each get a row; a null doc_id is a member but never the
smallest, unless all are null; extra columns pass through, but those named
fingerprint and component_id are replaced. `similar_texts` has one class for
all texts without words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.batches import append_columns, slices, text_bytes
from siltstone.llm.components import components
from siltstone.llm.shared import erase, known_id, written

SHINGLE, SEED = 4, 42
#: Fingerprints that one task compares with each other at most.
BLOCK = 4096
#: Pairs of nodes expanded at once.
FRONTIER = 1 << 20
LEVELS = (48, 40, 32, 24, 16, 8, 0)
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingles(text: bytes, size: int = SHINGLE) -> tuple[np.ndarray, bytes]:
    """(hash of each shingle of UTF-8 text, its words); A-Z is lower-cased, words are runs without ASCII white space."""
    words = text.lower().split()
    flat = b" ".join(words)
    if not words:
        return np.zeros(0, np.uint64), flat
    long = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(long + 1) - long - 1
    n = max(1, len(words) - size + 1)
    begin = start[:n].tolist()
    end = (start + long)[-n:].tolist()
    one = xxhash.xxh64_intdigest
    return np.array([one(flat[a:b], SEED) for a, b in zip(begin, end)], np.uint64), flat


def fingerprint(text: bytes) -> int:
    return majority(shingles(text)[0])


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 without any."""
    n = len(h)
    if not n:
        return 0
    eight = h.astype(">u8").view(np.uint8).reshape(n, 8)
    if n < 512:
        count = np.unpackbits(eight, axis=1).sum(0)
    else:
        count = np.concatenate([np.bincount(eight[:, k], minlength=256) @ BYTE_BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with fp: the fingerprint as a signed 64-bit integer."""

    def make():
        return lambda part: [pa.array(np.array([fingerprint(t) for t in text_bytes(part.column(text_col))], np.uint64).view(np.int64))]

    return append_columns(docs, text_col, [T.StructField("fp", T.LongType())], make)


# -- the index inside a group ----------------------------------------------


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each fingerprint in the reflected Gray sequence."""
    rank = fp.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    return rank


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new run of equal keys begins."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


class GrayIndex:
    """Hierarchy over fingerprints sorted by (group, Gray rank); equal ones in a group are leaves of one node.

    A node holds the bits that its level adds to those of the nodes above.
    """

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        self.levels = []
        roots = runs(group)
        starts, above = roots, 64
        for shift in (*LEVELS, None):
            below = np.arange(len(fp)) if shift is None else runs(group, fp >> np.uint64(shift))
            first = np.searchsorted(below, starts)
            added = np.zeros(len(below), np.uint64) if shift is None else (fp[below] >> np.uint64(shift)) & np.uint64((1 << (above - shift)) - 1)
            self.levels.append((np.append(first, len(below)), added))
            starts, above = below, shift
        self.roots = len(roots)

    def pairs(self, distance: int):
        """Yields (i, j) arrays of the fingerprints at most ``distance`` bits apart, i < j, same group."""
        roots = [np.arange(self.roots)[a : a + FRONTIER] for a in range(0, self.roots, FRONTIER)]
        stack = [(0, r, r, np.zeros(len(r), np.uint8)) for r in roots]
        while stack:
            level, a, b, apart = stack.pop()
            if level == len(self.levels):
                keep = a < b
                yield a[keep], b[keep]
                continue
            first, added = self.levels[level]
            ways = (first[a + 1] - first[a]) * (first[b + 1] - first[b])
            total = int(ways.sum())
            if total > FRONTIER and len(a) > 1:  # depth first: the frontier stays small
                half = len(a) // 2
                stack += [(level, a[:half], b[:half], apart[:half]), (level, a[half:], b[half:], apart[half:])]
                continue
            which = np.repeat(np.arange(len(a)), ways)
            at = np.arange(total) - np.repeat(np.cumsum(ways) - ways, ways)
            wide = (first[b + 1] - first[b])[which]
            x, y = first[a][which] + at // wide, first[b][which] + at % wide
            apart = apart[which] + np.bitwise_count(added[x] ^ added[y])
            keep = (x <= y) & (apart <= distance)
            stack.append((level + 1, x[keep], y[keep], apart[keep]))


def join_roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union by smallest index, in place; root[k] <= k names k's set."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            return
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def group_edges(group: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fp, fp of its set's first) that connect what is linked inside each group."""
    order = np.lexsort((gray_rank(fp), group))
    group, fp = group[order], fp[order]
    only = runs(group, fp)
    group, fp = group[only], fp[only]
    root = np.arange(len(fp))
    for i, j in GrayIndex(group, fp).pairs(distance):
        join_roots(root, i, j)
    moved = np.flatnonzero(root != np.arange(len(fp)))
    return fp[moved], fp[root[moved]]


# -- over all fingerprints -------------------------------------------------


def plan(count: int, distance: int) -> int:
    """Number of parts: the fewest for which random fingerprints would leave at most 256 in a group."""
    for parts in range(distance + 1, 2 * distance + 1):
        if count / 2 ** (64 * (parts - distance) // parts) <= 256:
            return parts
    return 2 * distance + 1


def masks(parts: int, distance: int) -> list[int]:
    """For each choice of parts that must agree, their bits (as signed 64-bit integers)."""
    edges = [64 * k // parts for k in range(parts + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [int(np.uint64(sum(c)).astype(np.int64)) for c in combinations(part, parts - distance)]


def in_blocks(dealt: DataFrame, block: int, by: str) -> DataFrame:
    """dealt (way, bits and more) with a and b: a group of over ``block`` rows is cut into blocks, and each pair of blocks is a group."""
    large = dealt.groupBy("way", "bits").count().where(F.col("count") > block).select("way", "bits", F.ceil(F.col("count") / (block // 2)).cast("int").alias("blocks"))
    dealt = dealt.join(large, ["way", "bits"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(by), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")}).drop("blocks", "own", "other")


KEYS = ["way", "bits", "a", "b"]


def by_group(dealt: DataFrame, make: Callable[[pa.Table], Iterable[pa.RecordBatch]], schema: str, keys: list[str] = KEYS, over: Callable[[pa.Table], pa.RecordBatch] | None = None) -> DataFrame:
    """make(rows of whole groups) over all rows, some 65,000 at a time; of a group larger than that, over(rows) piece by piece where given."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows, late = 0, None
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                rows += batch.num_rows
                if rows < 1 << 16:
                    continue
            if not rows:
                break
            whole = pa.Table.from_batches(held).combine_chunks()
            starts = runs(*_columns(whole, keys))
            cut = whole.num_rows if batch is None else int(starts[-1])
            if over is not None:
                key = [whole.column(k)[0].as_py() for k in keys]
                if key == late or not cut:
                    first = int(starts[1]) if len(starts) > 1 else whole.num_rows
                    yield over(whole.slice(0, first))
                    whole, cut, late = whole.slice(first), max(cut - first, 0), key
            if cut:
                yield from make(whole.slice(0, cut))
            held = whole.slice(cut).to_batches()
            rows = whole.num_rows - cut

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _columns(rows: pa.Table, keys: list[str]) -> list[np.ndarray]:
    return [rows.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in keys]


def _groups(rows: pa.Table, keys: list[str] = KEYS) -> np.ndarray:
    """The number of each row's group."""
    group = np.zeros(rows.num_rows, np.int64)
    group[runs(*_columns(rows, keys))[1:]] = 1
    return np.cumsum(group)


def links(fps: DataFrame, distance: int = 4, block: int = BLOCK) -> DataFrame:
    """u, v: edges that connect all of the distinct fingerprints in ``fps`` (column fp) that are linked."""
    ways = masks(plan(fps.count(), distance), distance)
    dealt = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in ways])).alias("way", "bits"))

    def edges(rows: pa.Table):
        (fp,) = _columns(rows, ["fp"])
        u, v = group_edges(_groups(rows), fp.astype(np.int64).view(np.uint64), distance)
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return by_group(in_blocks(dealt, block, "fp"), edges, "u long, v long")


def near_duplicates(docs: DataFrame, distance: int = 4, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, row (hash of the text), fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    marked = written(fingerprints(rows).select("doc_id", "row", "fp"), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    edges = written(links(nodes.select("fp"), distance, block), "links")
    named = components(edges)  # node, root
    rooted = nodes.join(named.withColumnsRenamed({"node": "fp"}), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.select("fp", "root").join(least, "root").select("fp", "component_id", F.lower(F.lpad(F.hex("root"), 16, "0")).alias("class"))
    return marked.join(classes, "fp").select("doc_id", "row", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "class")


# -- by similarity of the shingle sets -------------------------------------

#: Words of the wide fingerprint; ways in which two minimum hashes bring texts together; pairs measured at once.
WIDE, WAYS, MEASURED = 8, 8, 1 << 18
#: One text in SAMPLED tells which shingles are frequent; the FREQUENT most frequent ones are put last in all sets.
SAMPLED, FREQUENT = 16, 1 << 18
ODD = np.random.default_rng(64).integers(0, 2**63, WIDE + 2 * WAYS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def remixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th other hash of what ``h`` is a hash of."""
    h = (h ^ (h >> np.uint64(29))) * ODD[k]
    return h ^ (h >> np.uint64(32))


def expected(similarity: float, bits: int, sigmas: float) -> int:
    """Differing bits of ``bits`` for two large sets of that Jaccard similarity, and ``sigmas`` standard deviations on."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(round(bits * p + sigmas * (bits * p * (1 - p)) ** 0.5))


def overlap(similarity: float, n: np.ndarray | int) -> np.ndarray:
    """The least whole number of shared shingles that is ``similarity`` of ``n``."""
    return np.ceil(similarity * n - 1e-6).astype(np.int64)


def leading(h: np.ndarray, similarity: float, often: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first of a set's hashes, the rarest first, so many that one of them is in any similar set."""
    known, count = often
    rank = np.zeros(len(h), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        rank = np.where(known[at] == h, count[at], 0)
    return h[np.lexsort((h, rank))[: len(h) - int(overlap(similarity, len(h))) + 1]]


def sketch(text: bytes, size: int, similarity: float, often: tuple[np.ndarray, np.ndarray]) -> tuple[bytes, list[int], bytes, int, np.ndarray]:
    """(digest of the words, a key for each way, the wide fingerprint, size, leading hashes) of a text's set of shingles."""
    h, flat = shingles(text, size)
    h = np.unique(h)
    node = xxhash.xxh3_128_digest(flat)
    if not len(h):
        return node, [0] * WAYS, bytes(8 * WIDE), 0, h.view(np.int64)
    wide = np.array([majority(remixed(h, k)) for k in range(WIDE)], "<u8")
    least = np.array([remixed(h, WIDE + k).min() for k in range(2 * WAYS)]).reshape(WAYS, 2)
    return node, (least[:, 0] ^ remixed(least[:, 1], 0)).view(np.int64).tolist(), wide.tobytes(), len(h), leading(h, similarity, often).view(np.int64)


def spanning(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Places of the pairs (i, j) that make the minimum spanning forest by d."""
    order = np.argsort(d, kind="stable")
    root, chosen = np.arange(n), []
    left = np.arange(len(order))  # places in that order, the weight of a pair
    while len(left):
        a, b = root[i[order[left]]], root[j[order[left]]]
        apart = a != b
        left, a, b = left[apart], a[apart], b[apart]
        if not len(left):
            break
        best = np.full(n, len(order))
        np.minimum.at(best, a, left)
        np.minimum.at(best, b, left)
        pick = order[np.unique(best[best < len(order)])]
        chosen.append(pick)
        join_roots(root, i[pick], j[pick])
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)


def near_edges(group: np.ndarray, wide: np.ndarray, radius: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, differing bits): the spanning forest, nearest pairs first, of rows in a group whose wide fingerprints are near."""
    order = np.lexsort((gray_rank(wide[:, 0]), group))
    size = np.bincount(group)
    order = order[size[group[order]] > 1]
    wide = wide[order]
    none = np.zeros(0, np.int64)
    i, j, d = none, none, none
    for found in GrayIndex(group[order], wide[:, 0]).pairs(radius) if len(order) else ():
        for a in range(0, len(found[0]), MEASURED):
            x, y = (f[a : a + MEASURED] for f in found)
            far = np.bitwise_count(wide[x] ^ wide[y]).sum(1, dtype=np.int64)
            keep = far <= most
            i, j, d = np.concatenate([i, x[keep]]), np.concatenate([j, y[keep]]), np.concatenate([d, far[keep]])
            if len(i) > MEASURED:
                stay = spanning(len(order), i, j, d)
                i, j, d = i[stay], j[stay], d[stay]
    stay = spanning(len(order), i, j, d)
    return order[i[stay]], order[j[stay]], d[stay]


def _item_sets(batch: pa.RecordBatch, size: int):
    """Yields (slice of the batch, the sorted distinct shingle hashes of each text)."""
    for part in slices(batch, "text"):
        yield part, [np.unique(shingles(t, size)[0]).view(np.int64) for t in text_bytes(part.column("text"))]


def frequent(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, texts of the sample that hold each): the most frequent shingles."""

    def run(batches):
        for batch in batches:
            for _, made in _item_sets(batch, size):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(made))], names=["item"])

    some = rows.where(F.pmod("row", F.lit(SAMPLED)) == 0).dropDuplicates(["row"]).select("text")
    held = written(some.mapInArrow(run, "item long").groupBy("item").agg(F.count("*").alias("n")).where("n > 1"), "frequent")
    floor, total = None, 0
    for n, items in held.groupBy("n").count().orderBy(F.desc("n")).collect():
        total += items
        if total > FREQUENT:
            break
        floor = n
    top = held.where(F.lit(False) if floor is None else F.col("n") >= floor).toArrow().combine_chunks()
    erase(held)
    item, n = (c.astype(np.int64) for c in _columns(top, ["item", "n"]))
    order = np.argsort(item.view(np.uint64))
    return item.view(np.uint64)[order], n[order].astype(np.int32)


def meetings(group: np.ndarray, n: np.ndarray, at: np.ndarray, root: np.ndarray, similarity: float):
    """Yields (i, j) arrays: rows of one group and two classes whose sets (n hashes, the shared one at place ``at``) can be similar enough."""
    order = np.lexsort((n, group))
    group, n, at, root = group[order], n[order], at[order], root[order]
    key = (group << 40) + n
    ways = np.searchsorted(key, (group << 40) + np.floor(n / similarity + 1e-6).astype(np.int64), "right") - np.arange(len(n)) - 1
    ends = np.cumsum(ways)
    bounds = [0, *(np.flatnonzero(np.diff(ends // MEASURED)) + 1), len(n)]
    for a, b in zip(bounds, bounds[1:]):
        i = np.repeat(np.arange(a, b), ways[a:b])
        j = i + 1 + np.arange(len(i)) - np.repeat(ends[a:b] - ways[a:b] - (ends[a - 1] if a else 0), ways[a:b])
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
        keep = np.minimum(n[i] - at[i], n[j] - at[j]) >= overlap(similarity / (1 + similarity), n[i] + n[j])
        yield order[i[keep]], order[j[keep]]


MET = "u binary, v binary, u_root binary, v_root binary, bits long, n int, at int"


def prefix_pairs(leads: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """u, v, u_root, v_root: all pairs of ``leads`` (node, root, n, lead: leading hashes) of two roots that can be similar enough."""

    def over(rows: pa.Table) -> pa.RecordBatch:
        """Rows of a large group, as they are: v is null."""
        none = pa.nulls(rows.num_rows, pa.binary())
        made = [rows.column("node"), none, rows.column("root"), none, *(rows.column(c) for c in ("bits", "n", "at"))]
        made = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in made]
        return pa.RecordBatch.from_arrays(made, names=["u", "v", "u_root", "v_root", "bits", "n", "at"])

    def pairs(rows: pa.Table, keys: list[str]):
        node = rows.column("node").combine_chunks()
        root = pc.coalesce(rows.column("root").combine_chunks(), node)
        n, at = (c.astype(np.int64) for c in _columns(rows, ["n", "at"]))
        codes = node.dictionary_encode().indices.to_numpy().astype(np.int64)
        for i, j in meetings(_groups(rows, keys), n, at, root.dictionary_encode().indices.to_numpy(), similarity):
            _, once = np.unique((np.minimum(codes[i], codes[j]) << 32) + np.maximum(codes[i], codes[j]), return_index=True)
            i, j = pa.array(i[once]), pa.array(j[once])
            none = pa.nulls(len(once), pa.int32())
            yield pa.RecordBatch.from_arrays([node.take(i), node.take(j), root.take(i), root.take(j), none.cast(pa.int64()), none, none], names=["u", "v", "u_root", "v_root", "bits", "n", "at"])

    def small(rows: pa.Table):
        group = _groups(rows, ["bits"])
        count = np.bincount(group)[group]
        if (count > block).any():
            yield over(rows.filter(pa.array(count > block)))
        rows = rows.filter(pa.array((count > 1) & (count <= block)))
        if rows.num_rows:
            yield from pairs(rows.combine_chunks(), ["bits"])

    dealt = leads.select("node", "root", "n", F.posexplode("lead").alias("at", "bits"))
    met = written(by_group(dealt, small, MET, ["bits"], over), "met")
    large = met.where("v is null").select(F.lit(0).alias("way"), "bits", F.col("u").alias("node"), F.col("u_root").alias("root"), "n", "at")
    rest = by_group(in_blocks(large, block, "node"), lambda rows: pairs(rows, KEYS), MET)
    ends = [F.when(F.col("u") < F.col("v"), F.col(a)).otherwise(F.col(b)).alias(c) for a, b, c in (("u", "v", "u"), ("v", "u", "v"), ("u_root", "v_root", "u_root"), ("v_root", "u_root", "v_root"))]
    out = written(met.where("v is not null").unionByName(rest).select(*ends).distinct(), "candidates")
    erase(met)
    return out


def similar_texts(docs: DataFrame, similarity: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, row (hash of the text), component_id (smallest doc_id of the class) and class of every document.

    Classes are the components of the links between texts whose sets of
    ``size``-word shingles are similar to at least ``similarity``.
    """
    radius, near, sure = expected(similarity, 64, 5), expected(similarity, 64 * WIDE, 6), expected(similarity, 64 * WIDE, -6)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    often = frequent(rows, size)

    def sketches():
        def make(part):
            node, ways, wide, n, lead = zip(*[sketch(t, size, similarity, often) for t in text_bytes(part.column("text"))])
            return [*map(pa.array, (node, ways, wide, n)), pa.array(lead, pa.list_(pa.int64()))]

        return make

    longs = T.ArrayType(T.LongType())
    fields = [T.StructField("node", T.BinaryType()), T.StructField("ways", longs), T.StructField("wide", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("lead", longs)]
    marked = written(append_columns(rows, "text", fields, sketches).drop("text"), "sketches")
    place = F.min(F.struct(F.col("doc_id").isNull().alias("nil"), known_id(rows, "doc_id").alias("doc"), "row"))
    nodes = written(marked.groupBy("node").agg(F.min("doc_id").alias("least"), place.alias("at"), F.first("ways").alias("ways"), F.first("wide").alias("wide")), "nodes")
    dealt = nodes.select("node", "wide", F.posexplode("ways").alias("way", "bits"))

    def edges(rows: pa.Table):
        wide = np.frombuffer(b"".join(rows.column("wide").to_pylist()), "<u8").reshape(-1, WIDE)
        i, j, d = near_edges(_groups(rows), wide, radius, near)
        node = rows.column("node").combine_chunks()
        yield pa.RecordBatch.from_arrays([node.take(pa.array(i)), node.take(pa.array(j)), pa.array(d.astype(np.int32))], names=["u", "v", "far"])

    found = by_group(in_blocks(dealt, block, "node"), edges, "u binary, v binary, far int")
    found = written(found.groupBy(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).agg(F.min("far").alias("far")), "near")
    named = components(found.where(F.col("far") <= sure).select("u", "v"))
    joined = found.where(F.col("far") > sure)
    for end in ("u", "v"):
        joined = joined.join(named.withColumnsRenamed({"node": end, "root": f"{end}_root"}), end, "left").withColumn(f"{end}_root", F.coalesce(f"{end}_root", end))
    open_ = written(joined.where("u_root <> v_root").select("u", "v", "u_root", "v_root"), "open")
    # links between classes of certain links; what is left to join are those classes
    linked = components(_verified(rows, nodes, open_, similarity, size))
    erase(found, open_)
    rooted = nodes.select("node", "least").join(named, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = written(_renamed(rooted, linked), "rooted")
    # and all links that these ways may have missed
    leads = marked.select("node", "n", "lead").where("n > 0").dropDuplicates(["node"])
    leads = leads.join(rooted.where("root <> node").select("node", "root").hint("merge"), "node", "left")
    pairs = prefix_pairs(leads, similarity, block)
    rooted = _renamed(rooted, components(_verified(rows, nodes, pairs, similarity, size)))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.select("node", "root").join(least, "root").select("node", "component_id", F.lower(F.hex("root")).alias("class"))
    return marked.select("doc_id", "row", "node").join(classes, "node").select("doc_id", "row", "component_id", "class")


def _renamed(rooted: DataFrame, linked: DataFrame) -> DataFrame:
    """rooted (node, least, root) with the roots that ``linked`` (node, root) gives their roots."""
    tops = linked.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return rooted.join(tops, "root", "left").select("node", "least", F.coalesce("top", "root").alias("root"))


def _verified(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, similarity: float, size: int) -> DataFrame:
    """u, v: the classes (u_root, v_root) of the pairs of nodes whose sets of shingles are similar enough, by one document of each."""
    ends = pairs.select("u").unionByName(pairs.select(F.col("v").alias("u"))).distinct()
    wanted = nodes.join(ends, nodes.node == ends.u, "left_semi").select("node", "at.*").withColumnRenamed("row", "__row")
    texts = rows.withColumns({"nil": F.col("doc_id").isNull(), "doc": known_id(rows, "doc_id"), "__row": F.col("row")}).select("nil", "doc", "__row", "text")

    def run(batches):
        for batch in batches:
            for part, made in _item_sets(batch, size):
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(made, pa.list_(pa.int64()))], names=["node", "items"])

    sets = texts.join(wanted, ["nil", "doc", "__row"]).select("node", "text").mapInArrow(run, "node binary, items array<long>")
    sets = written(sets.dropDuplicates(["node"]), "sets")
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("items").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("items").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    both = both.select("u_root", "v_root", shared.alias("shared"), (F.size("a") + F.size("b") - shared).alias("all"))
    out = written(both.where(F.col("shared") >= F.col("all") * similarity).select(F.col("u_root").alias("u"), F.col("v_root").alias("v")), "verified")
    erase(sets)
    return out


def one_of_each(docs: DataFrame, distance: int = 4, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """The document of the smallest id (then text hash) of each class of near-duplicates; all columns stay.

    Near are fingerprints at most ``distance`` bits apart, or, where
    ``similarity`` is given, texts that are as similar as that.
    """
    if similarity is None:
        found = near_duplicates(docs, distance, id_col, text_col)
    else:
        found = similar_texts(docs, similarity, id_col=id_col, text_col=text_col)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nil"), known_id(found, "doc_id").alias("doc"), F.col("row")))
    stay = found.groupBy("class").agg(first.alias("k")).select(F.col("k.doc").alias("__doc"), F.col("k.nil").alias("__nil"), F.col("k.row").alias("__row"))
    keyed = docs.withColumns({"__doc": known_id(docs, id_col), "__nil": F.col(id_col).isNull(), "__row": F.xxhash64(text_col)})
    kept = keyed.join(stay, ["__doc", "__nil", "__row"], "left_semi")
    return kept.dropDuplicates(["__doc", "__nil", "__row"]).drop("__doc", "__nil", "__row")
