"""Language identification with a bit-sliced Bloom filter of n-grams.

Up to 64 languages share one filter (more have one for each 64): a slot holds
one bit a language, and the AND of the slots that an n-gram hashes to is the
set of languages that have it, in one look. Per language, the hits in a text are counted (a popcount over the
text's masks) and corrected for false positives: with n looks, c hits and a
false-positive rate f (the share of slots with the language's bit, to the
power of the number of hashes), (c - n*f) / (1 - f) hits are expected to be
true. The language with the most wins; score is its share of all true hits.

Edge cases: null texts and texts without a letter get ``und`` with score 0;
a text with letters but no known n-gram gets the most frequent learned
language with an even share; texts are read whole; ties go to the language
that sorts first; repeated rows and extra columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.batches import append_columns, flat_text

GRAM = 4
HASHES = (0x9E3779B1, 0x85EBCA77)
#: Languages of one filter, and the most that are learned: a model is 4 MB for each 64.
WORD, MOST_LANGS = 64, 1024
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(65, 91), *range(97, 123)]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the accented capitals U+00C0 to U+00DE."""
    low = ASCII_LOWER[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    capital = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    low[capital] += 0x20
    return low


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams as integers, offsets of each text's n-grams)."""
    low = lowered(data) if len(data) else data
    if len(low) < GRAM:
        return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
    gram = np.ndarray((len(low) - GRAM + 1,), "<u4", np.ascontiguousarray(low).data, 0, (1,)).copy()
    size = np.diff(offs)
    keep = np.ones(len(gram), bool)
    for back in range(1, GRAM):  # those that run over the end of a text
        at = offs[1:][size >= back] - back
        keep[at[at < len(gram)]] = False
    return gram[keep], np.concatenate([[0], np.cumsum(np.maximum(size - GRAM + 1, 0))])


class LanguageFilter:
    """langs[i] has bit i of each slot."""

    def __init__(self, langs: list[str], members: list[np.ndarray], bits: int, default: int):
        self.langs, self.bits, self.default = langs, bits, default
        kind = np.uint8 if len(langs) <= 8 else np.uint16 if len(langs) <= 16 else np.uint32 if len(langs) <= 32 else np.uint64
        if len(langs) > 64:
            raise ValueError("at most 64 languages")
        self.slots = np.zeros(1 << bits, kind)
        for i, gram in enumerate(members):
            for at in self.places(gram):
                np.bitwise_or.at(self.slots, at, kind(1 << i))
        self.false_rate = np.array([((self.slots >> kind(i)) & kind(1)).mean() ** len(HASHES) for i in range(len(langs))])

    def places(self, gram: np.ndarray) -> list[np.ndarray]:
        return [(gram * np.uint32(m)) >> np.uint32(32 - self.bits) for m in HASHES]

    def masks(self, gram: np.ndarray) -> np.ndarray:
        """The languages that have each n-gram, as bits."""
        first, *rest = self.places(gram)
        out = self.slots[first]
        for at in rest:
            out &= self.slots[at]
        return out

    def true_hits(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """[texts, languages] hits corrected for false positives."""
        gram, at = grams(data, offs)
        n = np.diff(at)
        out = np.zeros((len(n), len(self.langs)))
        some = n > 0
        if some.any():
            mask = self.masks(gram)
            one = mask.dtype.type(1)
            for i in range(len(self.langs)):
                hits = np.add.reduceat((mask >> mask.dtype.type(i)) & one, at[:-1][some], dtype=np.int64)
                f = self.false_rate[i]
                out[some, i] = np.maximum(hits - n[some] * f, 0) / max(1 - f, 1e-9)
        return out

    def predict(self, data: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return ["und"] * (len(offs) - 1), np.zeros(len(offs) - 1)
        hits = self.true_hits(data, offs)
        total = hits.sum(1)
        best = np.where(total > 0, hits.argmax(1), self.default)
        score = np.where(total > 0, hits[np.arange(len(best)), best] / np.maximum(total, 1e-12), 1 / len(self.langs))
        lettered = has_letter(data, offs)
        return [self.langs[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist())], np.where(lettered, score, 0.0)


class Filters(LanguageFilter):
    """Any number of languages: a filter for each 64 of them, one word of a slot each."""

    def __init__(self, langs: list[str], members: list[np.ndarray], bits: int, default: int):
        self.langs, self.bits, self.default = langs, bits, default
        self.words = [LanguageFilter(langs[a : a + WORD], members[a : a + WORD], bits, 0) for a in range(0, len(langs), WORD)]

    def true_hits(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return np.hstack([w.true_hits(data, offs) for w in self.words])


def has_letter(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(IS_LETTER[data])])
    found = run[offs[1:]] > run[offs[:-1]]
    for i in np.flatnonzero(~found & (np.diff(offs) > 0)):
        found[i] = any(c.isalpha() for c in data[offs[i] : offs[i + 1]].tobytes().decode())
    return found


def build(texts: dict[str, list[bytes]], default: str | None, most_grams: int = 30_000, bits: int = 19) -> LanguageFilter:
    """The filter from texts by language: each language's ``most_grams`` most frequent n-grams."""
    langs = sorted(texts)
    members = []
    for lang in langs:
        parts = texts[lang]
        offs = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        gram, count = np.unique(grams(np.frombuffer(b"".join(parts), np.uint8), offs)[0], return_counts=True)
        order = np.lexsort((gram, -count))[:most_grams]
        members.append(gram[order])
    kind = LanguageFilter if len(langs) <= WORD else Filters
    return kind(langs, members, bits, langs.index(default) if default in langs else 0)


def fit(docs: DataFrame, per_lang: int = 400, modulus: int = 4, held_out: int = 2, most_docs: int = 40_000, most_chars: int = 1 << 16, **how) -> LanguageFilter:
    """Learn from a bounded sample: at most ``per_lang`` documents of each language, the first by hash of doc_id.

    The sample is at most ``most_docs`` documents in all (with over 100
    languages each has fewer), one for each doc_id and language, whose texts
    count with ``most_chars`` characters. Only text and non-null lang of rows
    whose crc32(doc_id as text) mod ``modulus`` isn't ``held_out`` are used.
    Two passes: one over lang and doc_id alone finds the hash below which each
    language has that many rows, the next fetches their texts. More than
    ``MOST_LANGS`` languages are an error.
    """
    from pyspark.sql import Window

    open_rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % modulus != held_out))
    key = F.xxhash64("doc_id")
    # rows that repeat an id fall below any hash together, so ids are what is counted
    counts = {r.lang: (r.n, r.ids) for r in open_rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("doc_id").alias("ids")).limit(MOST_LANGS + 1).collect()}
    if len(counts) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    if not counts:
        return LanguageFilter([], [], 8, 0)
    per_lang = max(1, min(per_lang, most_docs // len(counts)))
    # keep about twice the wanted share of the hash range, then the first per_lang of it
    share = F.create_map(*[x for lang, (_, n) in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 2 * per_lang / n + 20 / n)))])
    bound = (share[F.col("lang")] * F.lit(float(2**63))).cast("long")
    near = open_rows.where(F.shiftrightunsigned(key, 1) <= bound).select("doc_id", "lang", key.alias("key")).distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key", "doc_id"))
    ids = near.withColumn("rank", rank).where(F.col("rank") <= per_lang).select("doc_id", "lang").collect()
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(r.doc_id, r.lang) for r in ids], T.StructType([docs.schema["doc_id"], docs.schema["lang"]]))
    text = F.min(F.coalesce(F.substring("text", 1, most_chars), F.lit(""))).alias("text")
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(text).collect()
    texts: dict[str, list[bytes]] = {lang: [] for lang in counts}
    for r in sorted(rows, key=lambda r: (r.lang, r.doc_id)):
        texts[r.lang].append(r.text.encode())
    return build(texts, max(sorted(counts), key=lambda lang: counts[lang][0]), **how)


def language_of(docs: DataFrame, model: LanguageFilter, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def run(part: pa.RecordBatch):
            lang, score = model.predict(*flat_text(part.column(text_col)))
            return [pa.array(lang, pa.string()), pa.array(score, pa.float64())]

        return run

    return append_columns(docs, text_col, fields, make)
