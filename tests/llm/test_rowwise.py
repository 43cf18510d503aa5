"""Operators that treat each document alone: media, language, quality, BPE, WARC."""

import gzip
import hashlib
import io
import random
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.llm import langid, media, quality, warc
from siltstone.llm.bpe import Vocabulary, bpe_round_trip

PATH = public_tokenizers.path("byte_bpe_50k.json")
EDGE = [(1, None), (2, ""), (3, "a"), (4, "x" * 64), (5, "Straße 😀 the\n\n end "), (5, "Straße 😀 the\n\n end "), (None, "  \t\n"), (7, "wörd " * 40_000), (8, "!" * 9000), (9, "ab" * 5000)]


@pytest.fixture(scope="module")
def vocab():
    return Vocabulary(PATH)


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, a repeated row, and columns that clash with every output."""
    df = spark.createDataFrame(EDGE, "doc_id long, text string").withColumn("keep", F.lit("k"))
    return df.withColumns({c: F.lit("old") for c in ("score", "Predicted", "lang_pred", "n_tokens", "feature", "media", "fp")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# -- BPE ----------------------------------------------------------------------


def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


ALPHABET = ["a", " ", "\n", "\t", "é", "1", "²", "　", "\x1c", "\x85", "\xa0", "中", "'s", "'S", "<|endoftext|>", "😀", "́", "!", "  ", "_", "​", " ", "A", "हि", "\x00", "ſ", "the", "tion", "ing "]


def test_bpe_agrees_with_the_library(vocab):
    random.seed(5)
    texts = ["".join(random.choice(ALPHABET) for _ in range(random.randint(0, 60))) for _ in range(3000)] + ["a" * 4000, "ab" * 3000, " " * 999, "\n" * 70 + "x", "word " * 500]
    t = library()
    want = t.encode_batch(texts, add_special_tokens=False)
    got = vocab.encode(texts)
    assert got == [w.ids for w in want]
    assert [vocab.decode(g) for g in got] == t.decode_batch(got, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text())
def test_bpe_any_text(text):
    v = _once()
    assert v.encode([text]) == [library_once().encode(text, add_special_tokens=False).ids]
    assert v.decode(v.encode([text])[0]) == text


_cache = {}


def _once():
    return _cache.setdefault("v", Vocabulary(PATH)) if "v" not in _cache else _cache["v"]


def library_once():
    return _cache.setdefault("t", library()) if "t" not in _cache else _cache["t"]


def test_bpe_long_texts_are_cut_where_it_does_not_show(vocab, monkeypatch):
    from siltstone.llm import bpe

    random.seed(8)
    texts = ["".join(random.choice(ALPHABET) for _ in range(3000)), "a" * 3000, "word  two " * 300, " " * 500]
    want = vocab.encode(texts)
    monkeypatch.setattr(bpe, "LONGEST", 64)
    assert [vocab.encode([t])[0] for t in texts] == want
    assert [vocab.decode(w) for w in want] == texts


@pytest.mark.parametrize("mask", [0, 3])
def test_bpe_words_of_one_hash_are_told_apart(vocab, monkeypatch, mask):
    from siltstone.llm import bpe

    random.seed(9)
    texts = ["".join(random.choice(ALPHABET) for _ in range(80)) for _ in range(200)] + ["one two  three", "", "a b c d e f g " * 9]
    want = [w.ids for w in library().encode_batch(texts, add_special_tokens=False)]
    real = bpe.word_hashes
    monkeypatch.setattr(bpe, "word_hashes", lambda *a: real(*a) & np.uint64(mask))
    assert vocab.encode(texts) == want


def test_bpe_ids_that_are_no_text(vocab):
    ids = [i for i, b in enumerate(vocab.token_bytes) if b in (b"\xe2", b"\x80", b"\xf0")]
    assert vocab.decode(ids) == library().decode(ids, skip_special_tokens=False)


def test_bpe_words_are_remembered_rightly(vocab):
    known, texts = {}, [f"tail{i} head{i} tail{i}" for i in range(50)]
    for _ in range(2):
        raw = [t.encode() for t in texts]
        offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        ids, at = vocab.encode_slice(np.frombuffer(b"".join(raw), np.uint8), offs, known)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == vocab.encode(texts)


def test_bpe_edge_cases(edge, empty):
    rows = bpe_round_trip(edge, PATH).collect()
    t = library()
    assert len(rows) == len(EDGE) and {r.keep for r in rows} == {"k"} and {r.score for r in rows} == {"old"}
    for r in rows:
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.token_ids, r.decoded) == (len(ids), ids, r.text or "")
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe_round_trip(empty, PATH).count() == 0


# -- media --------------------------------------------------------------------


def test_netpbm_round_trip_and_forms():
    rng = np.random.default_rng(1)
    for image in (rng.integers(0, 256, (3, 5), np.uint8), rng.integers(0, 256, (2, 4, 3), np.uint8), rng.integers(0, 65536, (2, 3), np.uint16)):
        assert (media.decode(media.encode_netpbm(image)) == image).all()
    assert media.decode(b"P1\n# c\n3 1\n1 0 1").tolist() == [[0, 255, 0]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert media.decode(b"P2 2 1 # c\n9\n3 9").tolist() == [[3, 9]]
    assert media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    for bad in (b"", b"P9 1 1", b"P5 2 2 255\nabc", b"P5 0 1 255\n", b"P2 1 1 5 9", b"BM", b"P5 x"):
        with pytest.raises(media.MediaError):
            media.decode(bad)


def bmp(depth, rows, palette=b"", height=None):
    body = b"".join(r.ljust(-(-len(r) // 4) * 4, b"\0") for r in rows)
    head = (40).to_bytes(4, "little") + (2).to_bytes(4, "little") + (height or len(rows)).to_bytes(4, "little", signed=True) + (1).to_bytes(2, "little") + depth.to_bytes(2, "little") + bytes(16) + (len(palette) // 4).to_bytes(4, "little") + bytes(4)
    start = 54 + len(palette)
    return b"BM" + (start + len(body)).to_bytes(4, "little") + bytes(4) + start.to_bytes(4, "little") + head + palette + body


def test_bmp():
    assert media.decode(bmp(24, [bytes([3, 2, 1, 6, 5, 4]), bytes([9, 8, 7, 12, 11, 10])])).tolist() == [[[7, 8, 9], [10, 11, 12]], [[1, 2, 3], [4, 5, 6]]]
    assert media.decode(bmp(24, [bytes([3, 2, 1, 6, 5, 4])], height=-1)).tolist() == [[[1, 2, 3], [4, 5, 6]]]
    grey = bytes([0, 0, 0, 0, 200, 200, 200, 0])
    assert media.decode(bmp(8, [bytes([1, 0])], grey)).tolist() == [[200, 0]]
    assert media.decode(bmp(1, [b"\x40"], grey)).tolist() == [[0, 200]]
    assert media.decode(bmp(4, [b"\x10"], bytes([1, 2, 3, 0, 4, 5, 6, 0]))).tolist() == [[[6, 5, 4], [3, 2, 1]]]


def test_bmp_with_masks():
    def masked(masks, pixel):
        raw = bytearray(bmp(32, [pixel * 2], b"".join(m.to_bytes(4, "little") for m in masks)))
        raw[30:34], raw[46:50] = (3).to_bytes(4, "little"), bytes(4)
        return bytes(raw)

    assert media.decode(masked((0xFF0000, 0xFF00, 0xFF), bytes([3, 2, 1, 9]))).tolist() == [[[1, 2, 3], [1, 2, 3]]]
    assert media.decode(masked((0xFF, 0xFF00, 0xFF0000), bytes([3, 2, 1, 9]))).tolist() == [[[3, 2, 1], [3, 2, 1]]]
    assert media.decode(masked((0xFF000000, 0xFF0000, 0xFF00), bytes([9, 3, 2, 1]))).tolist() == [[[1, 2, 3], [1, 2, 3]]]
    for masks in ((0x3FF, 0xFFC00, 0x3FF00000), (0, 0xFF00, 0xFF)):
        with pytest.raises(media.MediaError):
            media.decode(masked(masks, bytes(4)))


def test_area_resize_is_the_mean_of_areas():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (6, 9)).astype(np.uint8)
    fine = np.kron(image.astype(float), np.ones((4, 4)))  # 24 x 36
    want = fine.reshape(4, 6, 12, 3).mean((1, 3))
    assert np.allclose(media.area_resize(image, 4, 12), want)
    assert np.allclose(media.area_resize(image, 6, 9), image)
    assert np.allclose(media.area_resize(image[:1, :1], 3, 5), image[0, 0])


def test_media_columns(spark):
    image = np.tile(np.arange(64, dtype=np.uint8), (64, 1))
    df = spark.createDataFrame([(1, media.encode_netpbm(image)), (2, None), (3, b"junk"), (4, media.encode_netpbm(np.stack([image] * 3, 2)))], "id int, media binary").withColumn("dhash", F.lit("old"))
    a, b, c, d = media.media_columns(df, side=8).orderBy("id").collect()
    assert (a.height, a.width, a.channels, a.dhash, a.media_error) == (64, 64, 1, "f" * 16, None)
    tile = np.load(io.BytesIO(a.tile))
    assert tile.shape == (8, 8) and tile.dtype == np.uint8 and (np.diff(tile.astype(int), axis=1) > 0).all()
    assert b.media_error is None and b.tile is None and c.media_error and c.tile is None and np.load(io.BytesIO(d.tile)).shape == (8, 8, 3)


def test_media_columns_take_what_comes(spark):
    """An empty table, repeated rows, and a null, an empty and a long image."""
    shape = "id int, media binary"
    assert media.media_columns(spark.createDataFrame([], shape)).count() == 0
    image = media.encode_netpbm(np.arange(256, dtype=np.uint8).reshape(16, 16))
    long = media.encode_netpbm(np.zeros((20_000, 64), np.uint8))
    rows = media.media_columns(spark.createDataFrame([(1, image), (1, image), (2, None), (3, b""), (4, long)], shape)).collect()
    assert len(rows) == 5 and rows[0] == rows[1] and rows[0].tile and rows[2].tile is None and rows[3].media_error and rows[4].height == 20_000


def test_texts_as_media(edge, empty):
    rows = media.text_media(edge).collect()
    assert len(rows) == len(EDGE)
    for r in rows:
        raw = (r.text or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload)) and r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and media.decode(bytes(r.media)).tobytes() == payload
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest()) and len(r.feature) == 16
    assert media.text_media(empty).count() == 0


def test_texts_as_media_have_the_tile_of_media_columns(edge):
    rows = media.text_media(edge)
    tiles = media.media_columns(rows).collect()
    assert len(tiles) == len(EDGE) and all(r.media_error is None for r in tiles)
    assert all(r.tile_sha256 == hashlib.sha256(r.tile).hexdigest() and np.load(io.BytesIO(r.tile)).shape == (32, 32) for r in tiles)


# -- language and quality -------------------------------------------------------


def sets(spark, name="sf0.01"):
    d = f"/root/testdata/{name}"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_bloom_filter_has_no_false_negatives_and_knows_its_rate():
    rng = np.random.default_rng(3)
    members = [rng.integers(0, 2**32, n, dtype=np.uint32) for n in (500, 3000)]
    f = langid.LanguageFilter(["aa", "bb"], members, 14, 0)
    for i, m in enumerate(members):
        assert ((f.masks(m) >> i) & 1).all()
    other = rng.integers(0, 2**32, 200_000, dtype=np.uint32)
    for i in (0, 1):
        assert abs(((f.masks(other) >> i) & 1).mean() - f.false_rate[i]) < 0.01


def test_language_by_hand():
    """Masks, popcounts, their correction and the decision, recomputed with sets and loops."""
    rng = np.random.default_rng(2)
    samples = {lang: [" ".join("".join(rng.choice(list(letters), 5)) for _ in range(200)).encode()] for lang, letters in (("aa", "abcdefg"), ("bb", "efghijk"), ("cc", "xyzabÉ"))}
    f = langid.build(samples, "bb", bits=9)  # few slots, so that false positives abound
    texts = [b"abcdefg abcdefg", "xyza É yxab".encode(), b"", b"abc", b"1234 5678", b"efge ghij abcd", "ÉÉ xxyz".encode(), b"QRST UVWX"]
    slot = lambda gram, m: ((gram * m) & 0xFFFFFFFF) >> (32 - 9)

    def grams(text):
        low = "".join(c.lower() if "A" <= c <= "Z" or "\xc0" <= c <= "\xde" and c != "\xd7" else c for c in text.decode()).encode()
        return [int.from_bytes(low[i : i + 4], "little") for i in range(len(low) - 3)]

    held = {lang: {slot(g, m) for t in ts for g in grams(t) for m in langid.HASHES} for lang, ts in samples.items()}
    want_lang, want_score = [], []
    for t in texts:
        hits = {}
        for lang, slots in held.items():
            rate = (len(slots) / 2**9) ** 2
            c = sum(all(slot(g, m) in slots for m in langid.HASHES) for g in grams(t))
            hits[lang] = max(c - len(grams(t)) * rate, 0) / (1 - rate)
        total = sum(hits.values())
        lettered = any(c.isalpha() for c in t.decode())
        want_lang.append("und" if not lettered else max(hits, key=lambda k: (hits[k], -ord(k[0]))) if total else "bb")
        want_score.append(0.0 if not lettered else max(hits.values()) / total if total else 1 / 3)
    lang, score = f.predict(*quality.joined(texts))
    assert lang == want_lang and np.allclose(score, want_score)


def test_more_languages_than_a_word_has_bits(spark, monkeypatch):
    """Each of 70 languages is learned and found; too many are an error."""
    rng = np.random.default_rng(8)
    words = {f"l{k:02}": ["".join(map(chr, rng.integers(97, 123, 7))) for _ in range(40)] for k in range(70)}
    rows = [(40 * k + i, " ".join(rng.choice(words[lang], 30)), lang) for k, lang in enumerate(words) for i in range(12 if k < 64 else 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.language_of(docs, langid.fit(docs)).collect()
    assert len(out) == len(rows) and all(r.lang_pred == r.lang for r in out)
    monkeypatch.setattr(langid, "MOST_LANGS", 69)
    with pytest.raises(ValueError):
        langid.fit(docs)


def test_grams_stay_inside_texts():
    gram, at = langid.grams(np.frombuffer("ABCDÉxyz12".encode(), np.uint8), np.array([0, 3, 4, 11]))
    text = "abcdéxyz12".encode()
    assert at.tolist() == [0, 0, 0, 4] and [int(g).to_bytes(4, "little") for g in gram] == [text[k : k + 4] for k in range(4, 8)]


def test_language_on_held_out(spark):
    docs, _ = sets(spark)
    model = langid.fit(docs, per_lang=100)
    rows = langid.language_of(docs, model).where("crc32(cast(doc_id as string)) % 4 = 2").collect()
    assert len(rows) > 200 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.98 and all(0 <= r.score <= 1 for r in rows)
    again = langid.fit(docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 != 2, F.col("lang"))), per_lang=100)
    assert (again.slots == model.slots).all()  # held-out labels are never read


def test_language_edge_cases(spark, edge, empty):
    docs, _ = sets(spark, "sf0.001")
    model = langid.fit(docs)
    rows = {(r.doc_id, r.text): r for r in langid.language_of(edge, model).collect()}
    assert rows[1, None].lang_pred == rows[2, ""].lang_pred == rows[None, "  \t\n"].lang_pred == rows[8, "!" * 9000].lang_pred == "und"
    assert rows[1, None].score == 0.0 and rows[3, "a"].lang_pred in model.langs and rows[1, None].keep == "k"
    assert langid.language_of(empty, model).count() == 0
    none = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.language_of(edge, none).collect()} == {"und"}


def auc(score, label):
    order = np.argsort(np.argsort(score))
    pos = label == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


def test_quality_on_held_out(spark):
    docs, labels = sets(spark, "sf0.1")
    net = quality.fit(docs, labels, per_label=500)
    told = labels.where("crc32(cast(doc_id as string)) % 5 = 0").select("doc_id", "quality")
    rows = quality.quality_scores(docs.join(told, "doc_id"), net).collect()
    score, label = np.array([r.score for r in rows]), np.array([r.quality for r in rows])
    assert auc(score, label) > 0.97 and (score[label == 1] >= 0.3).mean() > 0.98 and (score[label == 0] < 0.3).mean() > 0.7
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)


def test_quality_gradient():
    """The derivative of every kind of weight is that of numeric differences."""
    rng = np.random.default_rng(5)
    net = quality.ByteNet(3)
    for k in ("embed", "filters", "unit", "bias", "shift"):  # double precision, away from zero
        setattr(net, k, getattr(net, k).astype(np.float64) + rng.normal(0, 0.3, getattr(net, k).shape))
    texts = [b"the quick brown fox jumps", b"!!!!!!!! $$$$", b"", "wörd ".encode() * 9]
    labels, weight = np.array([1.0, 0, 0, 1]), np.array([0.7, 1.3, 1.3, 0.7])
    _, slopes = quality.gradient(net, texts, labels, weight)
    for w, g in zip(net.weights(), slopes):
        used = np.argwhere(np.abs(g) > 1e-4)
        for at in map(tuple, used[rng.integers(0, len(used), 12)]):
            loss = []
            for step in (1e-6, -2e-6):
                w[at] += step
                loss.append(quality.gradient(net, texts, labels, weight)[0])
            w[at] += 1e-6
            assert (loss[0] - loss[1]) / 2e-6 == pytest.approx(g[at], rel=1e-3, abs=1e-6)


def score_by_hand(net, text):
    """The forward pass, chunk by chunk and filter by filter."""
    size = max(1, -(-len(text) // 4))
    raw = text.ljust(4 * size + 4, b"\0")
    hidden = []
    for f in range(quality.FILTERS):
        best = -np.inf
        for c in range(size):
            seen = [net.embed[b] for b in raw[4 * c : 4 * c + 8]]
            best = max(best, sum(float(np.dot(e.astype(float), net.filters[6 * k : 6 * k + 6, f])) for k, e in enumerate(seen)))
        hidden.append(max(0.0, best + net.bias[f]))
    return 1 / (1 + np.exp(-(np.dot(hidden, net.unit.astype(float)) + net.shift[0])))


def test_quality_forward_pass():
    net = quality.train([b"clean words here, and more of them", b"$$$$$$$$ #### spam spam spam spam spam spam"] * 8, np.array([1, 0] * 8), epochs=6)
    texts = [b"", b"abc", b"clean words", b"spam spam spam spam spam spam spam spam spam spam spam spam", "é".encode() * 31, b"x" * 200, b"four" * 9 + b"five", bytes(range(256))]
    got = net.scores(*quality.joined(texts))
    assert np.allclose(got, [score_by_hand(net, t) for t in texts], atol=2e-5)


def test_fits_of_repeated_rows_are_bounded(spark, monkeypatch):
    """Copies of a sampled id count once, and long texts with a bounded part."""
    seen = {}
    monkeypatch.setattr(langid, "build", lambda texts, *a, **k: seen.update(texts))
    monkeypatch.setattr(quality, "train", lambda texts, labels, **k: seen.update(quality=(texts, labels.tolist())))
    rows = [(1, f"copy {i} of a text", "en") for i in range(300)] + [(i, "ein Wort " * 50, "de") for i in (3, 4, 5, 6)] + [(8, None, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langid.fit(docs, most_chars=20)
    assert len(seen["en"]) <= 1 and 1 <= len(seen["de"]) <= 5 and max(map(len, seen["de"])) <= 20
    langid.fit(docs, per_lang=400, most_docs=2)
    assert len(seen["en"]) <= 1 and len(seen["de"]) == 1
    labels = spark.createDataFrame([(1, 1), (1, 1), (3, 0), (4, 0), (None, 1), (5, None)], "doc_id long, quality int")
    quality.fit(docs, labels, most_chars=30)
    texts, told = seen["quality"]
    assert len(texts) == len(told) <= 3 and max(map(len, texts)) <= 30


def test_fits_take_ids_of_any_type(spark):
    docs, labels = sets(spark, "sf0.001")
    text_id = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id")
    named, told = docs.select(text_id, "text", "lang"), labels.select(text_id, "quality")
    assert langid.fit(named).langs and quality.fit(named, told, epochs=1) is not None


def test_quality_learns():
    texts, labels = [b"the quick brown fox", b"!!!!!!!! $$$$", b"a lazy dog sleeps", b"%%%% &&&& ####"] * 4, np.array([1, 0, 1, 0] * 4)
    net = quality.train(texts, labels, epochs=40, batch=8)
    p = net.scores(*quality.joined(texts))
    assert p[labels == 1].min() > 0.8 and p[labels == 0].max() < 0.2


def test_quality_reads_whole_texts_and_no_neighbours():
    net = quality.train([b"clean words here", b"$$$$$$$$ ####"] * 8, np.array([1, 0] * 8), epochs=20)
    long = b"clean words here " * 4000
    alone = [net.scores(*quality.joined([t]))[0] for t in (long, long + b"$$$$$$$$ ####", b"")]
    together = net.scores(*quality.joined([long, long + b"$$$$$$$$ ####", b""]))
    assert np.allclose(alone, together, atol=1e-6) and alone[1] < alone[0]


def test_quality_edge_cases(spark, edge, empty):
    docs, labels = sets(spark, "sf0.001")
    for net in (quality.fit(docs, labels, epochs=1), quality.fit(docs, labels.where("false"))):
        rows = quality.quality_scores(edge, net).collect()
        assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows) and {r.keep for r in rows} == {"k"}
        assert len({r.score for r in rows if r.doc_id == 5}) == 1
        assert quality.quality_scores(empty, net).count() == 0


# -- WARC ---------------------------------------------------------------------


def test_plain_text():
    page = '<html><head><title>T &amp; t</title><style>p{}</style><script>if (a < b) "</p>"</script></head><body><!-- no --><p>One<b>two</b>\n three<p>Four<br>five &eacute;</body>'
    assert warc.plain_text(page) == "T & t\nOnetwo three\nFour\nfive é"
    assert warc.plain_text("") == "" and warc.plain_text("a < b <!-- open") == "a < b" and warc.plain_text("<script>never ends") == ""


def test_derivatives(spark):
    pages = spark.createDataFrame([(1, "http://a/ü", "<p>Hi</p>"), (2, None, None), (1, "http://a/ü", "<p>Hi</p>"), (3, "http://b", "<p>" + "x " * 200_000)], "page_id long, url string, html string")
    rows = warc.derivatives(warc.responses(pages)).collect()
    assert len(rows) == 8 and all(r.error is None for r in rows)
    by = {(r.page_id, r.record_type): r for r in rows}
    meta, text = by[1, "metadata"], by[1, "conversion"]
    origin = dict(warc.parse(warc.response_record("1 http://a/ü", "http://a/ü", "<p>Hi</p>"))[0])["WARC-Record-ID"]
    assert meta.refers_to == text.refers_to == origin and meta.record_id != text.record_id
    headers, block = warc.parse(bytes(text.record))
    headers = dict(headers)
    assert block == b"Hi" and headers["WARC-Refers-To"] == origin and headers["WARC-Block-Digest"] == warc.digest(b"Hi") == text.block_digest and headers["WARC-Target-URI"] == "http://a/ü"
    assert not [h for h in headers if h.startswith("WARC-Refers-To-")]  # those are for revisit records
    fields = dict(line.split(": ", 1) for line in warc.parse(bytes(meta.record))[1].decode().split("\r\n") if line)
    assert fields["payload-digest"] == warc.digest(b"<p>Hi</p>") and fields["payload-digest-agrees"] == "true" and fields["source-http-content-type"].startswith("text/html")
    assert by[2, "conversion"].target_uri is None and by[2, "conversion"].content_length == 0
    assert warc.derivatives(warc.responses(pages.where("false"))).count() == 0


def http(head, body, **warc_headers):
    block = ("HTTP/1.1 200 OK\r\n" + head + "\r\n").encode() + body
    return warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<r>"), *warc_headers.items()], block)


def test_codings_and_character_sets():
    page = "<p>Grüße — ok</p>"
    utf, gz = page.encode(), gzip.compress(page.encode())
    chunked = b"5\r\n" + utf[:5] + b"\r\n" + b"%x;ext=1\r\n" % len(utf[5:]) + utf[5:] + b"\r\n0\r\n\r\n"
    cases = [
        ("", utf), ("Content-Encoding: gzip\r\n", gz), ("content-encoding: GZIP\r\n", gz + b""), ("Content-Encoding: deflate\r\n", zlib.compress(utf)), ("Content-Encoding: deflate\r\n", zlib.compress(utf)[2:-4]),
        ("Transfer-Encoding: chunked\r\n", chunked), ("Content-Type: text/html; charset=utf-16\r\n", page.encode("utf-16")), ("Content-Type: text/html; charset=\"windows-1252\"\r\n", page.encode("cp1252")),
        ("", b"<meta charset='windows-1252'>" + page.encode("cp1252")), ("Content-Type: text/html; charset=no-such\r\n", utf),
        ("Transfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n", b"%x\r\n" % len(gz) + gz + b"\r\n0\r\n\r\n"),
    ]
    for head, body in cases:
        _, text = warc.derive(http(head, body))
        assert warc.parse(text["record"])[1].decode() == "Grüße — ok", head
    for stated in (utf, chunked):
        meta, _ = warc.derive(http("Transfer-Encoding: chunked\r\n", chunked, **{"WARC-Payload-Digest": warc.digest(stated)}))
        assert b"payload-digest-agrees: true" in meta["record"] and meta["payload_digest"] == warc.digest(utf)
    for head, body in (("Content-Encoding: br\r\n", b"x"), ("Content-Encoding: gzip\r\n", gz[:-9]), ("Content-Encoding: gzip\r\n", b"no"), ("Transfer-Encoding: chunked\r\n", b"zz\r\n"), ("Transfer-Encoding: chunked\r\n", b"9\r\nab")):
        (bad,) = warc.derive(http(head, body))
        assert bad["record_type"] == "error" and bad["error"] and bad["refers_to"] == "<r>"


def test_files_of_many_records(spark):
    one, two = (warc.response_record(k, f"http://{k}", f"<p>{k}") for k in "ab")
    info = warc.record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<i>")], b"x")
    df = spark.createDataFrame([(1, info + one + two), (2, gzip.compress(info) + gzip.compress(one) + gzip.compress(two)), (3, info + one + two[:-30]), (4, info)], "id int, warc binary")
    rows = warc.derivatives(df).collect()
    kinds = {i: [r.record_type for r in rows if r.id == i] for i in (1, 2, 3, 4)}
    assert kinds == {1: ["metadata", "conversion"] * 2, 2: ["metadata", "conversion"] * 2, 3: ["metadata", "conversion", "error"], 4: ["error"]}
    assert len({r.record_id for r in rows if r.id == 1}) == 4


def test_every_page_comes_back(spark):
    """Over all pages: ids are unique, digests and links right, and the text that of an own, plain stripper."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    twin = pages.limit(1).withColumn("html", F.lit("<p>other"))
    rows = warc.derivatives(warc.responses(pages.unionByName(twin))).collect()
    source = [(r.page_id, r.url, r.html) for r in pages.unionByName(twin).collect()]
    assert len(rows) == 2 * len(source) and len({r.record_id for r in rows}) == len(rows)

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.hidden = [], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style", "template", "noscript")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style", "template", "noscript") and self.hidden > 0

        def handle_data(self, data):
            self.out += [] if self.hidden else [data]

    want = Counter()
    for _, url, page in source:
        p = Plain()
        p.feed(page or "")
        p.close()
        want[url, warc.digest((page or "").encode()), "".join("".join(p.out).split())] += 1
    got = Counter()
    for r in rows:
        headers, block = warc.parse(bytes(r.record))
        assert dict(headers)["WARC-Block-Digest"] == warc.digest(block) == r.block_digest and r.content_length == len(block) and dict(headers)["WARC-Refers-To"] == r.refers_to
        if r.record_type == "conversion":
            got[r.target_uri, r.payload_digest, "".join(block.decode().split())] += 1
    assert got == want


def test_records_that_cannot_be_read(spark):
    other = warc.record([("WARC-Type", "request"), ("WARC-Record-ID", "<x>")], b"")
    good = warc.response_record("k", "u", "p")
    df = spark.createDataFrame([(1, None), (2, b"junk"), (3, good[:-20]), (4, other)], "id int, warc binary").withColumn("error", F.lit("old"))
    rows = warc.derivatives(df).collect()
    assert [r.record_type for r in rows] == ["error"] * 4 and all(r.error and r.error != "old" for r in rows)


def test_a_payload_that_does_not_match_its_digest():
    raw = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<x>"), ("WARC-Payload-Digest", "sha1:NO")], b"HTTP/1.1 200 OK\r\nA: b\r\n c\r\n\r\n\xff<p>x")
    meta, text = warc.derive(raw)
    assert b"payload-digest-agrees: false" in meta["record"] and b"source-http-a: b c" in meta["record"] and text["record"].endswith("�\nx\r\n\r\n".encode())
