"""Removal of long passages that an earlier document has, by De Bruijn compaction.

Edges of the graph are windows of ``k`` words. Every occurrence of an edge
goes to the partition of its minimizer (the least hash among its shorter
word n-grams), together with the neighbouring occurrences that share it: a
super-edge. There each edge that a smaller doc_id also has is found, with the
source coordinates of its first occurrence. Of the graph only the part that
decides is compacted: an edge goes on into the next one of its document where
their sources' coordinates go on too, so a path ends wherever the document
leaves its source (a branch taken) or another document becomes the first to
have the window. Inside a super-edge that is done at once and gives path
pieces; pieces are glued through joins where the end of one is the start of
the next in both coordinates, so paths are as long as the repeat.

Minimizers with very many occurrences go another way (`_hot_pieces`), in which
equal super-edges are aggregated before the shuffle and no task gathers them.

Each path is then verified: documents are joined with the paths they hold or
are the source of, both sides' words are digested, and the digests are joined
on the source coordinates. Hashes can only err by calling different windows
equal. If a path shows that, the windows of the minimizers that it runs over
are decided by a digest of their very words, and the documents that hold such
paths are done again (`_by_words`); all others stay as they are. So the result
rests on the words alone, whatever the hashes do.

Result: a word is removed if a window that covers it starts also in a document
with a smaller doc_id, judged on the input.

Edge cases: ids are integers; null texts have no words; texts shorter than a
window keep all; a null doc_id counts as larger than all others; rows with equal doc_id don't
remove from one another and are told apart by 64 bits of their text's hash;
repeated rows each get their row; an empty table gives no rows; texts are read
whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import logging

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.batches import flat_text, slices, text_bytes
from siltstone.llm.shared import erase, written

log = logging.getLogger("siltstone.substrings")

WINDOW, MINIMIZER = 13, 5
#: Bytes of a window's hash: all 64 bits, so that a false match is not to be expected at any size of corpus.
EDGE = 8
NO_ID = 2**63 - 1
SPACE = np.zeros(256, bool)
SPACE[[*range(9, 14), 32]] = True
#: One document in so many is looked at for very frequent minimizers.
SAMPLE = 64
#: Most keys (8 bytes each) that are broadcast.
MOST_BROADCAST = 10_000
#: Bytes of text, and of edge hashes, that a task turns into arrays at once.
AT_ONCE = 1 << 20
#: Paths that one copy of their source's text is read for.
MOST_ROLES = 2_000


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


class Hasher:
    """Word and n-gram hashes; ``seed`` gives other ones, from 2 on by XXH64 of each word."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(1000 + seed)
        self.seed = seed
        odd = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = odd(1)
        self.low = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.repeat(base, 4095)]))
        self.high = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.repeat(self.low[-1:] * base, 4095)]))
        self.short, self.long = odd(MINIMIZER), odd(WINDOW)

    def words(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, offsets of each text's words)."""
        if not len(data):
            return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
        black = ~SPACE[data]
        fresh = black.copy()
        fresh[1:] &= ~black[:-1]
        edges = offs[:-1][np.diff(offs) > 0]
        fresh[edges] = black[edges]
        start = np.flatnonzero(fresh)
        at = np.searchsorted(start, offs)
        if not len(start):
            return np.zeros(0, np.uint64), at
        if self.seed >= 2:
            buf = data.tobytes()
            ends = np.append(start[1:], len(data))
            h = [xxhash.xxh64_intdigest(buf[a:b].rstrip(b" \t\n\x0b\x0c\r"), self.seed) for a, b in zip(start.tolist(), ends.tolist())]
            return np.array(h, np.uint64), at
        place = np.arange(len(data)) - np.repeat(start, np.diff(np.append(start, len(data)))) if start[0] == 0 else None
        if place is None:
            place = np.zeros(len(data), np.int64)
            place[start[0] :] = np.arange(start[0], len(data)) - np.repeat(start, np.diff(np.append(start, len(data))))
        power = self.low[place & 4095]
        if place.max() > 4095:
            power = power * self.high[(place >> 12) & 4095]
        part = (data.astype(np.uint64) + np.uint64(1)) * power
        part[~black] = 0
        return mixed(np.add.reduceat(part, start)), at

    @staticmethod
    def grams(words: np.ndarray, factors: np.ndarray) -> np.ndarray:
        n = len(words) - len(factors) + 1
        out = words[:n] * factors[0]
        for j in range(1, len(factors)):
            out += words[j : j + n] * factors[j]
        return mixed(out)


def super_edges(hasher: Hasher, data: np.ndarray, offs: np.ndarray):
    """(text, start word, minimizer, edge hashes, offsets of each one's edges)."""
    words, at = hasher.words(data, offs)
    if len(words) < WINDOW:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(1, np.int64)
    short, edge = hasher.grams(words, hasher.short), hasher.grams(words, hasher.long)
    n = len(edge)
    least = short[:n].copy()
    for j in range(1, WINDOW - MINIMIZER + 1):
        np.minimum(least, short[j : j + n], out=least)
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(at))
    inside = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
    least, edge, owner = least[inside], edge[inside], owner[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return owner[first], inside[first] - at[owner[first]], least[first], edge, np.append(first, len(inside))


def _occurrences(docs: DataFrame, seed: int) -> DataFrame:
    def run(batches):
        hasher = Hasher(seed)
        for batch in batches:
            for part in slices(batch, "text", AT_ONCE):
                text, start, key, edge, at = super_edges(hasher, *flat_text(part.column("text")))
                raw = pa.py_buffer(edge.astype("<u8").tobytes())
                edges = pa.Array.from_buffers(pa.binary(), len(text), [None, pa.py_buffer((at * EDGE).astype(np.int32)), raw])
                pick = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), part.column("doc").take(pick), part.column("row").take(pick), pa.array(start, pa.int32()), edges], names=["key", "doc", "row", "start", "edges"]
                )

    return docs.select("doc", "row", "text").mapInArrow(run, "key long, doc long, row long, start int, edges binary")


class FirstSeen:
    """Turns super-edges sorted by (key, doc, row, start) into path pieces, batch by batch.

    Between batches it keeps the first occurrences of the last key's edges, so
    a key that many documents share is read as a stream.
    """

    def __init__(self):
        none = np.zeros(0, np.int64)
        self.kept = (none, np.zeros(0, np.uint64), none, none, none)  # key, edge, doc, row, place

    def take(self, key, doc, row, start, edge, at):
        count = np.diff(at)
        piece = np.repeat(np.arange(len(key)), count)
        place = start[piece] + np.arange(len(edge)) - at[:-1][piece]
        old = len(self.kept[0])
        all_key = np.concatenate([self.kept[0], key[piece]])
        all_edge = np.concatenate([self.kept[1], edge])
        all_doc = np.concatenate([self.kept[2], doc[piece]])
        all_row = np.concatenate([self.kept[3], row[piece]])
        all_place = np.concatenate([self.kept[4], place])
        order = np.lexsort((all_edge, all_key))  # stable: the first of a run is the first seen
        k, e = all_key[order], all_edge[order]
        new = np.ones(len(order), bool)
        new[1:] = (k[1:] != k[:-1]) | (e[1:] != e[:-1])
        source = np.empty(len(order), np.int64)
        source[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        firsts = order[new]
        stay = firsts[all_key[firsts] == key[-1]]
        self.kept = tuple(a[stay] for a in (all_key, all_edge, all_doc, all_row, all_place))
        # repeats, in the order of the input: neighbours of one super-edge stand side by side
        hit = np.flatnonzero(all_doc[source[old:]] < all_doc[old:])
        src = source[old:][hit]
        return compacted(piece, hit, doc, row, place, all_doc[src], all_row[src], all_place[src])


def compacted(piece, hit, doc, row, place, s_doc, s_row, s_place):
    """Path pieces of the edges numbered by ``hit``: runs that are neighbours in the document and in the source.

    piece: each edge's super-edge; doc and row by super-edge, place by edge,
    the source's coordinates by hit.
    """
    if not len(hit):
        return None
    own = piece[hit]
    new = np.ones(len(hit), bool)
    new[1:] = (own[1:] != own[:-1]) | (hit[1:] != hit[:-1] + 1) | (s_doc[1:] != s_doc[:-1]) | (s_row[1:] != s_row[:-1]) | (s_place[1:] != s_place[:-1] + 1)
    head = np.flatnonzero(new)
    length = np.diff(np.append(head, len(hit)))
    return doc[own[head]], row[own[head]], place[hit[head]], length, s_doc[head], s_row[head], s_place[head]


PIECE = "doc long, row long, start int, edges int, s_doc long, s_row long, s_start int"


def _batch(made) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(m, pa.int64()).cast(t) for m, t in zip(made, types)], names=["doc", "row", "start", "edges", "s_doc", "s_row", "s_start"])


def _longs(part: pa.RecordBatch, names: tuple[str, ...]) -> list[np.ndarray]:
    return [part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]


def _pieces(occurrences: DataFrame) -> DataFrame:
    """Path pieces, each minimizer's occurrences read as one sorted stream."""

    def run(batches):
        seen = FirstSeen()
        for batch in batches:
            for part in _edge_slices(batch):
                raw, at = flat_text(_as_text(part.column("edges")))
                made = seen.take(*_longs(part, ("key", "doc", "row", "start")), np.frombuffer(raw.tobytes(), "<u8"), at // EDGE)
                if made is not None:
                    yield _batch(made)

    ordered = occurrences.repartition("key").sortWithinPartitions("key", "doc", "row", "start")
    return ordered.mapInArrow(run, PIECE)


def _hot_keys(docs: DataFrame, seed: int, hot_rows: int) -> DataFrame:
    """Minimizers that, going by the documents of one hash bucket, have ``hot_rows`` occurrences or more.

    The estimate decides only which of two exact ways a minimizer's
    occurrences go.
    """
    bucket = docs.where(F.pmod(F.xxhash64("doc", "row"), F.lit(SAMPLE)) == 0)
    return _occurrences(bucket, seed).groupBy("key").count().where(F.col("count") >= max(2, hot_rows // SAMPLE)).select("key")


def _hot_pieces(occurrences: DataFrame) -> DataFrame:
    """Path pieces of minimizers with very many occurrences, without bringing those of one together.

    Equal super-edges are aggregated before the shuffle; first occurrences are
    found among the distinct ones, and each occurrence is joined with those of
    its own super-edge's edges.
    """
    same = ["key", "edges"]
    distinct = written(occurrences.groupBy(*same).agg(F.min(F.struct("doc", "row", "start")).alias("first")), "hot")
    # n: place in the super-edge
    places = F.posexplode(F.transform(F.sequence(F.lit(0), (F.length("edges") / EDGE).cast("int") - 1), lambda i: F.substring("edges", i * EDGE + 1, F.lit(EDGE)))).alias("n", "edge")
    each = distinct.select(*same, "first", places)
    at = F.struct(F.col("first.doc").alias("doc"), F.col("first.row").alias("row"), (F.col("first.start") + F.col("n")).alias("start"))
    source = each.groupBy("key", "edge").agg(F.min(at).alias("source"))
    sources = each.join(source, ["key", "edge"]).groupBy(*same).agg(F.sort_array(F.collect_list(F.struct("n", "source"))).alias("sources"))

    def run(batches):
        for part in batches:
            doc, row, start = _longs(part, ("doc", "row", "start"))
            lists = part.column("sources")
            count = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            found = lists.flatten().field("source")
            s_doc, s_row, s_place = (found.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc", "row", "start"))
            piece = np.repeat(np.arange(part.num_rows), count)
            place = start[piece] + np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
            hit = np.flatnonzero(s_doc < doc[piece])
            made = compacted(piece, hit, doc, row, place, s_doc[hit], s_row[hit], s_place[hit])
            if made is not None:
                yield _batch(made)

    return occurrences.join(sources, same).select("doc", "row", "start", "sources").mapInArrow(run, PIECE)


def _as_text(column: pa.Array) -> pa.Array:
    """The same buffers, typed as a string column for flat_text."""
    kind = pa.large_string() if pa.types.is_large_binary(column.type) else pa.string()
    return pa.Array.from_buffers(kind, len(column), column.buffers(), offset=column.offset)


def _edge_slices(batch: pa.RecordBatch):
    typed = pa.RecordBatch.from_arrays([_as_text(batch.column("edges"))], names=["edges"])
    at = 0
    for part in slices(typed, "edges", AT_ONCE):
        yield batch.slice(at, part.num_rows)
        at += part.num_rows


def _glued(pieces: DataFrame) -> DataFrame:
    """Paths: pieces joined end to start along one diagonal of a document and its source.

    A piece that no other one ends at begins a path, and a piece that no other
    one starts at ends it; two anti-joins find them. Paths of a diagonal don't
    overlap, so its n-th beginning and n-th end, joined, bound its n-th path.
    The number of joins doesn't depend on how many pieces a path has.
    """
    line = ["doc", "row", "s_doc", "s_row", "shift"]
    placed = pieces.select("doc", "row", "s_doc", "s_row", (F.col("s_start") - F.col("start")).alias("shift"), "start", (F.col("start") + F.col("edges")).alias("end"))
    heads = placed.select(*line, "start").join(placed.select(*line, F.col("end").alias("start")), [*line, "start"], "left_anti")
    tails = placed.select(*line, "end").join(placed.select(*line, F.col("start").alias("end")), [*line, "end"], "left_anti")
    # sets, as repeated rows give pieces more than once; a document's length bounds them
    heads = heads.groupBy(*line).agg(F.sort_array(F.collect_set("start")).alias("starts"))
    tails = tails.groupBy(*line).agg(F.sort_array(F.collect_set("end")).alias("ends"))
    paths = heads.join(tails, line).select(*line, F.inline(F.arrays_zip("starts", "ends")).alias("start", "end"))
    return paths.select("doc", "row", "start", (F.col("end") - F.col("start")).cast("int").alias("edges"), "s_doc", "s_row", (F.col("start") + F.col("shift")).cast("int").alias("s_start"))


ROLE = "struct<holds:boolean,start:int,edges:int,s_doc:long,s_row:long,s_start:int>"
SIDE = "array<struct<start:int,edges:int,s_doc:long,s_row:long,s_start:int,digest:binary>>"
DONE = f"doc long, row long, part int, doc_id long, n_words long, n_removed long, kept_sha256 string, held {SIDE}, given {SIDE}"


def _roles(paths: DataFrame) -> DataFrame:
    """doc, row, part, roles: the paths that a document holds, and those that it is the source of.

    The former are in part 0, and no more than the document has words. A
    source of very many paths has these spread over several parts, each of
    which meets a copy of its text.
    """
    hold = paths.select("doc", "row", F.lit(0).alias("part"), F.struct(F.lit(True).alias("holds"), "start", "edges", "s_doc", "s_row", "s_start").alias("role"))
    give = paths.select("s_doc", "s_row", "s_start", "edges").distinct()
    much = give.groupBy("s_doc", "s_row").count().where(F.col("count") > MOST_ROLES)
    much = much.select("s_doc", "s_row", F.ceil(F.col("count") / (MOST_ROLES // 2)).cast("int").alias("parts"))
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("s_start", "edges"), "parts").cast("int"))
    give = give.join(much, ["s_doc", "s_row"], "left").withColumn("part", part)
    given = F.struct(F.lit(False).alias("holds"), F.col("s_start").alias("start"), "edges", "s_doc", "s_row", "s_start")
    give = give.select(F.col("s_doc").alias("doc"), F.col("s_row").alias("row"), "part", given.alias("role"))
    # part 0 is there in any case, as it makes the document's row
    first = much.select(F.col("s_doc").alias("doc"), F.col("s_row").alias("row"), F.lit(0).alias("part"), F.lit(None).cast(ROLE).alias("role"))
    return hold.unionByName(give).unionByName(first).groupBy("doc", "row", "part").agg(F.collect_list("role").alias("roles"))


def _applied(docs: DataFrame, roles: DataFrame) -> DataFrame:
    """Each document without what its paths cover, and digests of the paths it holds or gives."""

    def one(text: bytes, part: int, roles: list[dict]):
        words = text.split()
        gone = np.zeros(len(words) + 1, np.int64)
        out = ([], [])
        for r in roles:
            a, n = r["start"], r["edges"] + WINDOW - 1
            if r["holds"]:
                gone[a] += 1
                gone[min(a + n, len(words))] -= 1
            digest = hashlib.sha256(b" ".join(words[a : a + n])).digest()[:16]
            out[not r["holds"]].append({k: r[k] for k in ("start", "edges", "s_doc", "s_row", "s_start")} | {"digest": digest})
        if part:
            return None, None, None, *out
        kept = words
        if out[0]:
            stay = np.cumsum(gone[:-1]) == 0
            kept = [w for w, s in zip(words, stay.tolist()) if s]
        return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), *out

    item = pa.list_(pa.struct([("start", pa.int32()), ("edges", pa.int32()), ("s_doc", pa.int64()), ("s_row", pa.int64()), ("s_start", pa.int32()), ("digest", pa.binary())]))
    types = [pa.int64(), pa.int64(), pa.string(), item, item]
    same = ["doc", "row", "part", "doc_id"]

    def run(batches):
        for batch in batches:
            for cut in slices(batch, "text"):
                rows = zip(text_bytes(cut.column("text")), cut.column("part").to_pylist(), cut.column("roles").to_pylist())
                made = list(zip(*[one(t, p, r or []) for t, p, r in rows]))
                arrays = [*[cut.column(c) for c in same], *[pa.array(m, t) for m, t in zip(made, types)]]
                yield pa.RecordBatch.from_arrays(arrays, names=[*same, "n_words", "n_removed", "kept_sha256", "held", "given"])

    joined = docs.join(roles, ["doc", "row"], "left").withColumn("part", F.coalesce("part", F.lit(0)))
    return joined.select(*same, "text", "roles").mapInArrow(run, DONE)


def _by_words(docs: DataFrame, false: DataFrame, seed: int) -> DataFrame:
    """doc, row, start of windows that an earlier document has, by a digest of their words.

    Looked at are all windows of the minimizers that the paths in ``false``
    run over: whatever the hashes took for equal has a minimizer in common.
    """
    size = (F.length("edges") / EDGE).cast("int")
    spans = F.col("doc"), F.col("row"), F.col("start").alias("low"), (F.col("start") + F.col("edges")).alias("high")
    at_fault = _occurrences(docs.join(false.select("doc", "row").distinct(), ["doc", "row"], "left_semi"), seed)
    keys = at_fault.join(false.select(*spans), ["doc", "row"]).where((F.col("start") < F.col("high")) & (F.col("start") + size > F.col("low")))
    keys = written(keys.select("key").distinct(), "keys")
    look = _occurrences(docs, seed).join(keys, "key", "left_semi").groupBy("doc", "row").agg(F.collect_set(F.struct("start", size.alias("n"))).alias("spans"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", AT_ONCE):
                which, start, digests = [], [], []
                for i, (text, spans) in enumerate(zip(text_bytes(part.column("text")), part.column("spans").to_pylist())):
                    words = text.split()
                    for s in spans:
                        for a in range(s["start"], s["start"] + s["n"]):
                            which.append(i)
                            start.append(a)
                            digests.append(hashlib.sha256(b" ".join(words[a : a + WINDOW])).digest())
                pick = pa.array(which, pa.int64())
                arrays = [part.column("doc").take(pick), part.column("row").take(pick), pa.array(start, pa.int32()), pa.array(digests, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc", "row", "start", "words"])

    found = docs.join(look, ["doc", "row"]).select("doc", "row", "text", "spans").mapInArrow(run, "doc long, row long, start int, words binary")
    found = written(found, "windows")
    first = found.groupBy("words").agg(F.min("doc").alias("first"))
    return found.join(first, "words").where("first < doc").select("doc", "row", "start").distinct()


def _mended(docs: DataFrame, paths: DataFrame, done: DataFrame, false: DataFrame, seed: int) -> DataFrame:
    """``done``, with the documents that hold false paths done again."""
    hurt = false.select("doc", "row").distinct()
    true = paths.join(false, paths.columns, "left_anti").select("doc", "row", "start", "edges")
    holds = true.unionByName(_by_words(docs, false, seed).withColumn("edges", F.lit(1)))
    none = [F.lit(0).cast("long").alias("s_doc"), F.lit(0).cast("long").alias("s_row"), F.lit(0).alias("s_start")]
    roles = holds.groupBy("doc", "row").agg(F.collect_list(F.struct(F.lit(True).alias("holds"), "start", "edges", *none)).alias("roles")).withColumn("part", F.lit(0))
    again = _applied(docs.join(hurt, ["doc", "row"], "left_semi"), roles)
    return done.join(hurt, ["doc", "row"], "left_anti").unionByName(again)


def _all_pieces(docs: DataFrame, seed: int, hot_rows: int) -> DataFrame:
    occurrences = _occurrences(docs, seed)
    hot = written(_hot_keys(docs, seed, hot_rows), "hot-keys")
    n = hot.count()
    if not n:
        return _pieces(occurrences)
    hot = F.broadcast(hot) if n <= MOST_BROADCAST else hot
    return _pieces(occurrences.join(hot, "key", "left_anti")).unionByName(_hot_pieces(occurrences.join(hot, "key", "left_semi")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = 500_000, seed: int = 0) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document.

    hot_rows: occurrences from which on a minimizer is not read by one task.
    seed: of the hashes; the result doesn't depend on it.
    """
    named = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.xxhash64(F.lit(seed), text_col), F.lit(0)).cast("long").alias("row"), F.col(text_col).alias("text")
    )
    pieces = written(_all_pieces(named, seed, hot_rows), "pieces")
    paths = written(_glued(pieces), "paths")
    erase(pieces)
    done = written(_applied(named, _roles(paths)), "applied")
    path = ["start", "edges", "s_doc", "s_row", "s_start"]
    told = ["s_doc", "s_row", "s_start", "edges", "digest"]
    held = done.select("doc", "row", F.inline("held"))
    given = done.select(F.inline("given")).select(*told).distinct()
    # what many documents hold alike is one row before the shuffle
    wrong = written(held.select(*told).distinct().join(given, told, "left_anti"), "wrong")
    done, n_wrong = done.where("part = 0"), wrong.count()
    if n_wrong:
        log.warning("%d paths were not what their hashes said; their documents are done again by words", n_wrong)
        false = written(held.join(wrong, told, "left_semi").select("doc", "row", *path).distinct(), "false")
        done = written(_mended(named, paths, done, false, seed).select("doc_id", "n_words", "n_removed", "kept_sha256"), "mended")
    erase(paths, wrong)
    return done.select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS key, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
w AS (SELECT rid, key, unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM d),
n AS (SELECT rid, key, pos, {thirteen} AS win FROM w WINDOW o AS (PARTITION BY rid ORDER BY pos)),
f AS (SELECT win, min(key) AS first FROM n WHERE win IS NOT NULL GROUP BY win),
g AS (SELECT DISTINCT rid, unnest(range(pos, pos + 13)) AS pos FROM n JOIN f USING (win) WHERE first < key),
k AS (SELECT w.rid, count(g.pos) AS gone, string_agg(word, ' ' ORDER BY w.pos) FILTER (WHERE g.pos IS NULL) AS kept FROM w LEFT JOIN g ON w.rid = g.rid AND w.pos = g.pos GROUP BY w.rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (rid)
""".replace("{thirteen}", " || ' ' || ".join(["word", *[f"lead(word, {i}) OVER o" for i in range(1, WINDOW)]]))
