"""Byte-level BPE, encoding and decoding.

Each pre-token is a row of leaves in a segment tree over the ranks of adjacent
pairs. A leaf holds ``rank * width + position`` and a node the smaller of its
children, so the root names the leftmost pair of the lowest rank. A merge
changes three leaves, and each change climbs to the root in log2(width) steps.
Short pre-tokens of a batch share one two-dimensional tree in numpy; long ones
get a tree of their own, so a run of a million equal letters costs n log n.

Edge cases: null and empty texts have no tokens and decode to the empty text;
repeated rows and extra columns pass through; texts of any length are encoded
whole; the special token's own string is one token, as the library has it.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siltstone.llm.batches import append_columns, flat_text

# The pre-token pattern of byte-level BPE vocabularies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# The same pattern for texts without a character beyond U+024F, where the classes are these.
LETTER, NUMBER, SPACE = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
LATIN_PRE_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
BEYOND_LATIN = re.compile("[^\x00-ɏ]")
#: The highest lead byte of UTF-8 that no character beyond U+024F has.
LATIN_LEAD = 0xC8

NONE = np.int32(2**31 - 1)
#: Pre-tokens of at most this many bytes are merged in batches.
WIDEST = 64
#: Bytes of one text that are turned into arrays at once.
LONGEST = 4 << 20
#: Words whose ids a task remembers; beyond it only those of the present slice stay.
REMEMBERED = 700_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = {}, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
    for b in range(256):
        if b not in out:
            out[b] = chr(free)
            free += 1
    return [out[b] for b in range(256)]


class Vocabulary:
    """Merges and tokens of a vocabulary file in the JSON form of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids: dict[str, int] = spec["model"]["vocab"]
        symbols = byte_symbols()
        back = {c: b for b, c in enumerate(symbols)}
        size = max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.token_bytes[i] = bytes(back[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_id = np.array([ids[c] for c in symbols], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int32)
        code = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(code, kind="stable")
        self.codes, self.ranks = code[order], order.astype(np.int32)
        self.rank_of = dict(zip(code.tolist(), range(len(code))))
        self.byte_ranks = self.lookup(np.repeat(self.byte_id, 256), np.tile(self.byte_id, 256))
        self.pattern = regex.compile(PRE_TOKEN)
        self.split = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("pattern", "split")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.pattern = regex.compile(PRE_TOKEN)
        self.split = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of token ids, NONE where the pair doesn't merge."""
        code = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.codes, code)
        at[at == len(self.codes)] = 0
        return np.where(self.codes[at] == code, self.ranks[at], NONE)

    # -- merging -----------------------------------------------------------

    def merge_batch(self, words: list[bytes], width: int) -> list[bytes]:
        """Ids, as little-endian 32-bit integers, of words of 1 to ``width`` bytes; width is a power of two."""
        n, bits = len(words), width.bit_length() - 1
        raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(n, width)
        length = np.fromiter(map(len, words), np.int32, n)
        place = np.arange(width, dtype=np.int32)
        symbol = self.byte_id[raw].ravel()
        after = np.tile(place + 1, n).reshape(n, width)
        after[np.arange(n), length - 1] = width
        after = after.ravel()
        before = np.tile(place - 1, n)
        alive = (place < length[:, None]).ravel()

        tree = np.full((n, 2 * width), NONE, np.int32)
        rank = self.byte_ranks[raw[:, :-1].astype(np.int32) << 8 | raw[:, 1:]]
        fits = (rank != NONE) & (place[1:] < length[:, None])
        tree[:, width : 2 * width - 1][fits] = ((rank << bits) | place[:-1])[fits]
        top = width >> 1
        while top:
            tree[:, top : 2 * top] = np.minimum(tree[:, 2 * top : 4 * top : 2], tree[:, 2 * top + 1 : 4 * top : 2])
            top >>= 1
        tree = tree.ravel()

        word = np.arange(n, dtype=np.int64)
        root = tree[word * 2 * width + 1]
        while True:
            live = root != NONE
            word = word[live]
            if not len(word):
                break
            root = root[live]
            at, base, top = root & (width - 1), word * width, word * 2 * width
            i = base + at
            right = after[i]
            j = base + right
            new = self.merged[root >> bits]
            symbol[i] = new
            alive[j] = False
            behind = after[j]
            after[i] = behind
            has = behind < width
            before[(base + behind)[has]] = at[has]
            # the pair that starts here, the pair that is gone, the pair that ends here
            self._set(tree, top[~has], at[~has], None, None, width, bits)
            self._set(tree, top[has], at[has], new[has], symbol[(base + behind)[has]], width, bits)
            self._set(tree, top, right, None, None, width, bits)
            front = before[i]
            has = front >= 0
            self._set(tree, top[has], front[has], symbol[(base + front)[has]], new[has], width, bits)
            root = tree[top + 1]
        count = alive.reshape(n, width).sum(1)
        ids = symbol[alive].astype("<u4").tobytes()
        ends = (np.cumsum(count) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def _set(self, tree, top, leaf, left, right, width, bits) -> None:
        """Point update of one leaf in each word's tree."""
        if not len(top):
            return
        if left is None:
            value = NONE
        else:
            rank = self.lookup(left, right)
            value = np.where(rank == NONE, NONE, (rank << bits) | leaf)
        node = width + leaf
        tree[top + node] = value
        node = node >> 1
        while node[0]:
            child = top + 2 * node
            tree[top + node] = np.minimum(tree[child], tree[child + 1])
            node = node >> 1

    def merge_long(self, word: bytes) -> bytes:
        """The same for one word of any length."""
        n = len(word)
        width = 1 << max(1, (n - 1).bit_length())
        symbol = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        find, merged, none = self.rank_of.get, self.merged.tolist(), 1 << 62
        tree = [none] * (2 * width)
        for p in range(n - 1):
            r = find(symbol[p] << 32 | symbol[p + 1])
            if r is not None:
                tree[width + p] = r * width + p
        for p in range(width - 1, 0, -1):
            a, b = tree[2 * p], tree[2 * p + 1]
            tree[p] = a if a < b else b

        def put(p, value):
            p += width
            tree[p] = value
            while p > 1:
                a, b = tree[p], tree[p ^ 1]
                p >>= 1
                least = a if a < b else b
                if tree[p] == least:
                    return
                tree[p] = least

        def pair(p, q):
            r = find(symbol[p] << 32 | symbol[q])
            return none if r is None else r * width + p

        while tree[1] != none:
            r, p = divmod(tree[1], width)
            q = after[p]
            symbol[p], symbol[q] = merged[r], -1
            nxt = after[p] = after[q]
            put(q, none)
            if nxt < n:
                before[nxt] = p
                put(p, pair(p, nxt))
            else:
                put(p, none)
            if before[p] >= 0:
                put(before[p], pair(before[p], p))
        return np.array([s for s in symbol if s >= 0], "<u4").tobytes()

    def merge(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        by_width: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if len(w) <= WIDEST:
                by_width.setdefault(max(4, 1 << (len(w) - 1).bit_length()), []).append(k)
            else:
                out[k] = self.merge_long(w)
        for width, ks in by_width.items():
            step = max(1, (1 << 18) // width)
            for a in range(0, len(ks), step):
                part = ks[a : a + step]
                for k, ids in zip(part, self.merge_batch([words[k] for k in part], width)):
                    out[k] = ids
        return out

    # -- texts -------------------------------------------------------------

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens; the special token's own string stays one piece."""
        if self.split is None or not self.split.search(text):
            return self.cut(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += self.cut(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self.cut(text[at:])

    def cut(self, text: str) -> list[str]:
        return (self.pattern if BEYOND_LATIN.search(text) else LATIN_PRE_TOKEN).findall(text)

    def encode_slice(self, data: np.ndarray, offs: np.ndarray, known: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts data[offs[i]:offs[i+1]]; known: ids of words by their hash, updated.

        A space before a non-space always begins a pre-token, so the text
        between two such spaces is encoded alone, once for all its repeats.
        """
        if len(offs) == 2 and len(data) > LONGEST and len(cut := cuts(data)) > 2:
            ids = np.concatenate([self.encode_slice(data[a:b], np.array([0, b - a]), known)[0] for a, b in zip(cut, cut[1:])])
            return ids, np.array([0, len(ids)])
        start, owner = word_starts(data, offs)
        if not len(start):
            return np.zeros(0, "<u4"), np.zeros(len(offs), np.int64)
        length = np.diff(np.append(start, len(data)))
        apart = length > WIDEST  # not worth remembering
        for t in self.special:
            mark, raw = t.encode(), data.tobytes()
            at = raw.find(mark)
            while at >= 0:
                apart[np.searchsorted(start, at, side="right") - 1] = True
                at = raw.find(mark, at + 1)
        key = word_hashes(data, start, length)
        key[apart] = np.arange(int(apart.sum()), dtype=np.uint64)
        key[~apart] |= np.uint64(1 << 63)
        keys, first, which = np.unique(key, return_index=True, return_inverse=True)
        listed = keys.tolist()
        if len(known) > REMEMBERED:
            stay = {k: known[k] for k in listed if k in known}
            known.clear()
            known.update(stay)
        lost = [u for u, k in enumerate(listed) if k not in known]
        buf = data.tobytes()
        begin, size = start[first[lost]].tolist(), length[first[lost]].tolist()
        words = [buf[x : x + n].decode() for x, n in zip(begin, size)]
        find = self.pieces if apart.any() or data.max() > LATIN_LEAD else LATIN_PRE_TOKEN.findall
        parts = list(map(find, words))
        tokens = list(set(chain.from_iterable(parts)))
        merged = dict(zip(tokens, self.merge([t.encode() for t in tokens])))
        for t, i in self.special.items():
            merged[t] = np.array([i], "<u4").tobytes()
        get = merged.__getitem__
        for u, part in zip(lost, parts):
            known[listed[u]] = get(part[0]) if len(part) == 1 else b"".join(map(get, part))
        each = [known[k] for k in listed]
        for k in listed:
            if k >> 63:
                break
            del known[k]
        many = np.fromiter(map(len, each), np.int64, len(each)) >> 2
        ids, count = gather(np.frombuffer(b"".join(each), "<u4"), many, which)
        ends = np.concatenate([[0], np.cumsum(count)])
        return ids, ends[np.searchsorted(owner, np.arange(len(offs)))]

    def encode_alone(self, text: str) -> np.ndarray:
        """ids of one text, its words told apart by their characters and not by a hash."""
        parts = self.pieces(text)
        tokens = list(set(parts))
        merged = dict(zip(tokens, self.merge([t.encode() for t in tokens])))
        for t, i in self.special.items():
            merged[t] = np.array([i], "<u4").tobytes()
        return np.frombuffer(b"".join(merged[p] for p in parts), "<u4")

    def round_trip(self, data: np.ndarray, offs: np.ndarray, known: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, list[str | bytes]]:
        """(ids, offsets, decoded texts), exact whatever the hashes of words do.

        Ids stand for the bytes of their text, so a word that was taken for
        another one of its hash shows when the ids are decoded; such a text is
        encoded alone.
        """
        ids, at = self.encode_slice(data, offs, known)
        texts = self.decode_slice(ids, at)
        buf, ends = data.tobytes(), offs.tolist()
        raw = [buf[a:b] for a, b in zip(ends, ends[1:])]
        wrong = [n for n, (t, r) in enumerate(zip(texts, raw)) if t != r]
        if wrong:
            each = [ids[a:b] for a, b in zip(at, at[1:])]
            for n in wrong:
                each[n] = self.encode_alone(raw[n].decode())
            ids, at = np.concatenate(each), np.concatenate([[0], np.cumsum(list(map(len, each)))])
            texts = self.decode_slice(ids, at)
        return ids, at, texts

    def encode(self, texts: list[str]) -> list[list[int]]:
        raw = [t.encode() for t in texts]
        offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        ids, at, _ = self.round_trip(np.frombuffer(b"".join(raw), np.uint8), offs, {})
        return [ids[a:b].tolist() for a, b in zip(at, at[1:])]

    def decode_slice(self, ids: np.ndarray, at: np.ndarray) -> list[str | bytes]:
        """The bytes that the ids of each text stand for, as a string where they are not valid UTF-8."""
        size = np.array([len(b) for b in self.token_bytes], np.int64)
        flat = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        buf = b"".join([gather(flat, size, ids[a : a + LONGEST // 4])[0].tobytes() for a in range(0, len(ids), LONGEST // 4)])
        ends = np.concatenate([[0], np.cumsum(size[ids])])[at].tolist()
        out: list[str | bytes] = []
        for a, b in zip(ends, ends[1:]):
            part = buf[a:b]
            try:
                part.decode()
                out.append(part)
            except UnicodeDecodeError:
                out.append(part.decode("utf-8", "replace"))
        return out

    def decode(self, ids: list[int]) -> str:
        text = self.decode_slice(np.array(ids, np.int64), np.array([0, len(ids)]))[0]
        return text.decode() if isinstance(text, bytes) else text


def gather(flat: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenation of the runs of flat numbered by which; run i has size[i] items. Also the size of each."""
    start, count = np.concatenate([[0], np.cumsum(size)[:-1]])[which], size[which]
    total = int(count.sum())
    step = np.repeat(start - (np.cumsum(count) - count), count)
    return flat[step + np.arange(total)], count


#: Bytes that a space must not be cut off from: white space, and what may begin white space beyond ASCII.
STICKY = np.zeros(256, bool)
STICKY[[*range(9, 14), 32, *range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True


def word_starts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin with their leading space, and the text each belongs to."""
    edge = np.zeros(len(data) + 1, bool)
    edge[:-2] = (data[:-1] == 32) & ~STICKY[data[1:]]
    begins = offs[:-1][np.diff(offs) > 0]
    ends = offs[1:][np.diff(offs) > 0] - 1
    edge[ends] = False  # a text's last byte is never cut off: what follows is another text
    edge[begins] = True
    start = np.flatnonzero(edge[: len(data)])
    return start, np.searchsorted(offs, start, side="right") - 1


def cuts(data: np.ndarray) -> list[int]:
    """Where a long text may be cut: at spaces that begin a pre-token, about LONGEST bytes apart; 0 and the end too."""
    out, at = [0], LONGEST
    while at < len(data) - 1:
        part = data[at : at + 65_537]
        found = np.flatnonzero((part[:-1] == 32) & ~STICKY[part[1:]])
        if len(found):
            out.append(at + int(found[0]))
            at = out[-1] + LONGEST
        else:
            at += len(part) - 1
    return [*out, len(data)]


POWERS = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15, np.uint64))


def word_hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words; `Vocabulary.round_trip` finds out where two words agree."""
    place = np.minimum(np.arange(len(data), dtype=np.int64) - np.repeat(start, length), len(POWERS) - 1)
    h = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * POWERS[place], start)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def bpe_round_trip(docs: DataFrame, vocabulary: str, text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256, and with token_ids and decoded if with_ids.

    vocabulary: path of a JSON vocabulary file on the driver; its tables travel
    as one broadcast, whose size the file bounds.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields += [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]

    def make():
        vocab, known = shared.value, {}

        def run(part: pa.RecordBatch):
            ids, at, texts = vocab.round_trip(*flat_text(part.column(text_col)), known)
            sha = lambda b: hashlib.sha256(b).hexdigest()
            buf = ids.astype("<u4", copy=False).tobytes()
            spans = [(4 * a, 4 * b) for a, b in zip(at.tolist(), at[1:].tolist())]
            out = [pa.array(np.diff(at), pa.int64()), pa.array([sha(buf[a:b]) for a, b in spans], pa.string())]
            out.append(pa.array([sha(t if isinstance(t, bytes) else t.encode()) for t in texts], pa.string()))
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))
                out.append(pa.array([t.decode() if isinstance(t, bytes) else t for t in texts], pa.string()))
            return out

        return run

    return append_columns(docs, text_col, fields, make)
