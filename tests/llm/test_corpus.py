"""Operators over the whole corpus: mixing, top-k, lines, SimHash, substrings; and the pipeline."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import simhash, substrings
from siltstone.llm.components import components
from siltstone.llm.lines import drop_shared_lines
from siltstone.llm.mixing import mix, mixed, targets
from siltstone.llm.topk import binary_codes, segments_for, top_k

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string"


# -- mixing -------------------------------------------------------------------


def test_targets_fill_by_weight(spark):
    sizes = spark.createDataFrame([("b", 100), (None, 1000), ("a", 10), ("c", 100)], "source string, source_size long")
    got = {r.source: r.target for r in targets(sizes, 1.5, (3, 1, 2), 2).collect()}
    # weights a 3, b 1, c 2, null 3; caps 20, 200, 200, 2000; 1815 to share: a and b and c are full or not in turn
    assert got["a"] == 20 and got["c"] == 200 and got["b"] == 200 and got[None] == pytest.approx(1815 - 420)
    assert sum(got.values()) == pytest.approx(1.5 * 1210)


def test_mix_is_exact_and_rerun_agrees(spark):
    rows = [(i, "w " * (i % 7), None if i % 11 == 0 else f"s{i % 3}") for i in range(600)] + [(None, None, "s0"), (5, "a b", "s1"), (5, "a b", "s1")]
    df = spark.createDataFrame(rows, DOCS).withColumns({"size": F.lit("old"), "taken": F.lit("old"), "key": F.lit("old")})
    runs = [sorted(map(tuple, mix(df, rows_per_range=n).select("doc_id", "source", "size", "source_size", "target", "taken").collect()), key=str) for n in (20_000, 10)]
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)
    by = defaultdict(list)
    for _, source, size, source_size, target, taken in runs[0]:
        assert 0 <= taken <= 2 * size
        by[source].append((size, source_size, target, taken))
    for group in by.values():
        assert sum(g[0] for g in group) == group[0][1] and sum(g[3] for g in group) == int(group[0][2])
        assert sum(g[3] % g[0] != 0 for g in group if g[0]) <= 1  # one document is cut
    assert mix(df.where("false")).count() == 0


def test_mix_of_rows_without_an_id(spark):
    """Keys that most rows share are cut into ranges, and the result is that of one order."""
    rows = [(None, "w " * (i % 9) + f"x{i}", "s0") for i in range(400)] + [(7, "v " * (i % 5) + f"y{i}", "s0") for i in range(200)] + [(1000 + i, "u " * (i % 4), f"s{i % 2}") for i in range(200)]
    df = spark.createDataFrame(rows, DOCS)
    runs = [sorted(map(tuple, mix(df, rows_per_range=n).collect()), key=str) for n in (100_000, 8)]
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)


def test_mixed_repeats_rows(spark):
    rows = [(i, f"t{i} " * 5, "ab"[i % 2]) for i in range(40)]
    out = mixed(spark.createDataFrame(rows, DOCS))
    assert out.columns == ["doc_id", "text", "source"]
    words = Counter()
    for r in out.collect():
        words[r.source] += 5
    assert abs(words["a"] - 200) <= 3 and abs(words["b"] - 100) <= 3


# -- top-k --------------------------------------------------------------------


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(4)
    codes = np.concatenate([rng.integers(0, 2**63, 700, dtype=np.int64), np.full(300, 77, np.int64), 77 ^ (1 << rng.integers(0, 60, 50))])
    rows = list(enumerate(codes.tolist()))
    df = spark.createDataFrame(rows, "id long, code long")
    asked = df.where("id % 50 = 0 or id = 750")
    got = defaultdict(list)
    for r in top_k(df, asked, 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.distance, r.neighbor_id))
    u = codes.view(np.uint64)
    for q in [r.id for r in asked.collect()]:
        d = np.bitwise_count(u ^ u[q])
        want = sorted((int(x), i) for i, x in enumerate(d) if i != q)[:10]
        assert got[q] == want
    assert top_k(df.where("false"), asked.where("false")).count() == 0
    assert len(top_k(df.where("id < 3"), df.where("id = 0")).collect()) == 2


def test_top_k_of_repeated_rows(spark):
    """Queries asked twice, ids with several codes or rows, a code that most rows have."""
    rng = np.random.default_rng(9)
    rows = [(int(i), int(c)) for i, c in zip(rng.integers(0, 150, 400), rng.choice(rng.integers(0, 2**63, 60), 400))]
    rows += [(i, 5) for i in range(300)] + [(7, 5)] * 20 + [(1000, 6), (1000, 6), (1001, 2**62)]
    asked = [(7, 5), (7, 5), (1000, 6), (1001, 2**62), (rows[0][0], rows[0][1]), (rows[0][0], 77), (9999, 5)]
    shape = "id long, code long"
    for k in (3, 12):
        got = defaultdict(Counter)
        for r in top_k(spark.createDataFrame(rows, shape), spark.createDataFrame(asked, shape), k).collect():
            got[r.query_id][r.rank, r.neighbor_id, r.distance] += 1
        want = defaultdict(Counter)
        for i, c in set(asked):
            near = sorted(((c ^ x).bit_count(), n) for n, x in rows if n != i)[:k]
            want[i].update((rank, n, d) for rank, (d, n) in enumerate(near, 1))
        assert got == want


def test_segments_cover_all_bits():
    for n in (0, 1, 500, 10**5, 10**9, 10**12):
        cut = segments_for(n)
        assert cut[0][0] == 0 and all(a + w == b for (a, w), (b, _) in zip(cut, cut[1:])) and sum(cut[-1]) == 64


def test_binary_codes(spark):
    df = spark.createDataFrame([(1, [1.0] * 64), (2, [-1.0] * 63 + [0.0]), (3, None), (4, []), (None, [1.0] * 64), (5, [float("nan")] * 64)], "vec_id long, embedding array<float>")
    assert {r.id: r.code for r in binary_codes(df).collect()} == {1: -1, 2: -(2**63), 5: 0}


def test_vectors_of_another_size_are_an_error(spark):
    df = spark.createDataFrame([(1, [1.0] * 128), (2, None), (3, [])], "vec_id long, embedding array<float>")
    with pytest.raises(ValueError, match="128"):
        binary_codes(df)
    assert binary_codes(df.where("vec_id > 1")).count() == 0 and binary_codes(df.where("false")).count() == 0


# -- lines --------------------------------------------------------------------


def lines_by_hand(rows, min_sites, min_chars, keep_first=True):
    sites, first = defaultdict(set), {}
    order = lambda r: (r[0] is None, r[0] or 0)
    for doc, text, site in sorted(rows, key=order):
        for n, line in enumerate((text or "").split("\n")):
            if text is not None and len(line.strip(" ")) >= min_chars:
                sites[line.strip(" ")].add(site)
                first.setdefault(line.strip(" "), (doc, n))
    out = []
    for doc, text, site in rows:
        if text is None:
            out.append((doc, None, 0, 0))
            continue
        cut = text.split("\n")
        stay = [x for n, x in enumerate(cut) if len(sites.get(x.strip(" "), ())) < min_sites or (keep_first and first[x.strip(" ")] == (doc, n))]
        out.append((doc, "\n".join(stay), len(cut), len(cut) - len(stay)))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep_first", [True, False])
def test_lines(spark, keep_first):
    rows = []
    for i in range(300):
        parts = [f"own line number {i}", "", "  shared by all sites " if i % 3 else "shared by all sites", f"shared by few sites {i % 40}", "x", f"group {i // 5}"]
        rows.append((i, "\n".join(parts), None if i % 13 == 0 else f"s{i % 9}"))
    rows += [(None, "shared by all sites", "s1"), (900, None, "s2"), (901, "", "s3"), (902, "shared by all sites\nshared by all sites", "s1"), (903, "long " * 50_000 + "\nshared by all sites", None)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"n_lines": F.lit("old"), "gone": F.lit("g"), "place": F.lit("p"), "doc": F.lit("d"), "h1": F.lit("h")})
    for min_sites in (3, 8):
        out = drop_shared_lines(df, min_sites=min_sites, min_chars=6, keep_first=keep_first)
        assert out.columns == ["doc_id", "text", "source", "gone", "place", "doc", "h1", "n_lines", "n_removed"] or set(out.columns) == {"doc_id", "text", "source", "gone", "place", "doc", "h1", "n_lines", "n_removed"}
        assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=str) == lines_by_hand(rows, min_sites, 6, keep_first)


def test_lines_sketch_and_exact_agree_when_all_is_near(spark):
    rows = [(i, f"a line of some length {i % 20}", f"s{i % 37}") for i in range(800)]
    df = spark.createDataFrame(rows, DOCS)
    a = sorted(map(tuple, drop_shared_lines(df, min_sites=30, margin=0.9).collect()), key=str)
    b = sorted(map(tuple, drop_shared_lines(df, min_sites=30, margin=0.2, lg_k=14).collect()), key=str)
    assert a == b
    assert drop_shared_lines(df.where("false")).count() == 0


def test_ids_may_be_strings(spark):
    """Lines, near-duplicates and the mix compare ids in their own type."""
    rows = [(None if i % 10 == 3 else f"d{i:02}", f"own {i}\nshared by all of the sites\n" + "w " * i, f"s{i % 8}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string")
    kept = [r.doc_id for r in drop_shared_lines(df).collect() if "shared" in r.text]
    assert kept == ["d00"]
    assert {r.doc_id for r in simhash.one_of_each(df, similarity=0.8).collect()} <= {r[0] for r in rows}
    assert mixed(df).count() > 0 and simhash.one_of_each(df).count() > 0


def test_lines_use_no_python(spark):
    df = spark.createDataFrame([(1, "a\nb", "s")], DOCS)
    plan = drop_shared_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# -- SimHash ------------------------------------------------------------------


def fingerprint_by_hand(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB é\n\tß\x1c\x85 ", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == fingerprint_by_hand(text)


def test_fingerprint_of_a_long_text():
    text = " ".join(f"w{i % 701}" for i in range(3000))
    assert simhash.fingerprint(text.encode()) == fingerprint_by_hand(text)


def roots_by_hand(fps, distance=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= distance) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def near_set(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, n, dtype=np.uint64)
    out = [base]
    for k in range(1, 8):
        flips = np.zeros(n // 2, np.uint64)
        for _ in range(k):
            flips ^= np.uint64(1) << rng.integers(0, 64, n // 2, dtype=np.uint64)
        out.append(base[: n // 2] ^ flips)
    return np.unique(np.concatenate(out))


def test_index_in_a_group_finds_all_links():
    fps = near_set(150, 1)
    i, j = map(np.concatenate, zip(*simhash.GrayIndex(np.zeros(len(fps), int), fps[np.argsort(simhash.gray_rank(fps))]).pairs(4)))
    want = sum(int((np.bitwise_count(fps[k + 1 :] ^ fps[k]) <= 4).sum()) for k in range(len(fps)))
    assert len(i) == want == len({(a, b) for a, b in zip(i.tolist(), j.tolist())})


def test_gray_rank():
    fps = np.arange(64, dtype=np.uint64)
    assert (simhash.gray_rank(fps ^ (fps >> np.uint64(1))) == fps).all()


@pytest.mark.parametrize("parts, block", [(None, 4096), (7, 4096), (None, 20)])
def test_links_and_components(spark, monkeypatch, parts, block):
    if parts:
        monkeypatch.setattr(simhash, "plan", lambda n, d: parts)
    fps = near_set(120, 2)
    # one bit after another: a large group of near copies that hang together
    chain = np.uint64(0xABCDEF0123456789) ^ np.array([(1 << k) - 1 for k in range(0, 64, 2)], np.uint64)
    fps = np.unique(np.concatenate([fps, chain]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = {r.node: r.root for r in components(simhash.links(df, 4, block)).collect()}
    want = roots_by_hand(fps)
    groups, mine = defaultdict(set), defaultdict(set)
    for k, x in enumerate(fps.view(np.int64).tolist()):
        groups[want[k]].add(x)
        mine[found.get(x, x)].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_plan_keeps_groups_small():
    for n in (1, 10**5, 10**7, 10**9, 10**11):
        p = simhash.plan(n, 4)
        assert 5 <= p <= 9 and (p == 9 or n / 2 ** (64 * (p - 4) // p) <= 256)


def test_near_duplicates_edge_cases(spark):
    base = [f"word{i}" for i in range(400)]
    near = base[:200] + ["changed"] + base[201:]
    rows = [(9, " ".join(base)), (3, " ".join(near)), (5, "\t".join(base).upper()), (4, None), (8, ""), (None, " \n"), (2, "one"), (2, "one"), (7, "one"), (7, "two three"), (6, "z " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit("old"), "row": F.lit("old"), "root": F.lit("old")})
    out = simhash.near_duplicates(df).collect()
    fps = np.array([fingerprint_by_hand(t) for _, t in rows], np.uint64)
    root = roots_by_hand(fps)
    least = {r: min((d for k, (d, _) in enumerate(rows) if root[k] == r and d is not None), default=None) for r in root}
    want = sorted(((d, f"{int(fps[k]):016x}", least[root[k]]) for k, (d, _) in enumerate(rows)), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in out), key=str) == want
    assert near_zero(out) == 4
    kept = simhash.one_of_each(df).collect()
    assert len(kept) == len(set(root)) and set(kept[0].asDict()) == {"doc_id", "text", "fp", "row", "root"}
    assert simhash.near_duplicates(df.where("false")).count() == 0 and simhash.one_of_each(df.where("false")).count() == 0


def similar_by_hand(texts, similarity=0.8, size=5):
    """Each text's first of its class: sets of shingles compared pair by pair."""
    sets = []
    for t in texts:
        w = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        w = WORD.findall(w)
        sets.append({" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (min(len(a), len(b)) >= similarity * max(len(a), len(b)) and len(a & b) >= similarity * len(a | b)):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def similar_rows():
    """Texts with copies of which some words are changed, so that similarities spread around the bound; and chains."""
    rng = np.random.default_rng(12)
    rows = []
    for k in range(60):
        base = [f"v{x}" for x in rng.integers(0, 3000, rng.integers(5, 400))]
        for _ in range(rng.integers(1, 5)):
            w = list(base)
            for at in rng.integers(0, len(w), rng.integers(0, 1 + len(w) // 25)):
                w[at] = f"n{rng.integers(0, 10**6)}"
            rows.append(" ".join(w))
    walk = [f"c{x}" for x in range(100)]
    for k in range(0, 60, 4):
        walk[k] = f"d{k}"
        rows.append(" ".join(walk))
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [simhash.BLOCK, 6])
def test_similar_texts(spark, block):
    rows = similar_rows() + [(-1, None), (-2, " \n"), (None, "only four words here"), (2000, "Only  four words\there"), (2000, "Only  four words\there"), (2001, "z " * 200_000), (2002, "z z z z z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("old") for c in ("node", "wide", "ways", "nil", "doc")})
    want = similar_by_hand([t for _, t in rows])
    found = simhash.similar_texts(df, block=block).collect()
    assert len(found) == len(rows)
    mine, hand, least = defaultdict(set), defaultdict(set), {}
    for k, (d, _) in enumerate(rows):
        hand[want[k]].add(d)
    for r in found:
        mine[r["class"]].add(r.doc_id)
        least[r["class"]] = r.component_id
    assert sorted(map(str, map(lambda s: sorted(s, key=str), mine.values()))) == sorted(map(str, map(lambda s: sorted(s, key=str), hand.values())))
    assert all(least[c] == min((d for d in ids if d is not None), default=None) for c, ids in mine.items())
    kept = simhash.one_of_each(df, similarity=0.8).collect()
    assert len(kept) == len(set(want)) and set(kept[0].asDict()) == set(df.columns)
    assert simhash.similar_texts(df.where("false")).count() == 0


@pytest.mark.parametrize("block", [simhash.BLOCK, 2])
def test_similar_texts_lose_no_link(spark, block):
    """Pairs of similarity 0.8 that meet in no way or have far fingerprints, or whose clusters' nearest pair is below the bound."""
    short = [[f"{c}{k}" for c in "abcdefghi"] for k in (3294, 4071, 5604, 5740, 6073, 7306)]
    rows = [" ".join(w[:n]) for w in short for n in (8, 9)]
    for k in range(12):
        a = [f"w{i}k{k}" for i in range(104)]
        b = [*a[:30], "x", *a[31:60], "y", *a[61:-1], "z"]
        rows += map(" ".join, (a, [*b[:-2], "u", "z"], b))  # a to the second 0.786, a to b 0.802
    rows = list(enumerate(rows))
    found = {r.doc_id: r.component_id for r in simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()}
    assert [found[d] for d, _ in rows] == similar_by_hand([t for _, t in rows])
    assert len(set(found.values())) == 18


def test_prefix_pairs_of_large_groups(spark):
    """A group larger than a task's share is dealt out in blocks, and every pair in it that can be similar is given."""
    n, most = 70_000, 1 << 16
    dealt = spark.range(n).select(F.when(F.col("id") < n - 40, 0).otherwise(F.col("id") % 8).alias("bits"), "id")
    seen = simhash.by_group(dealt, lambda t: [t.combine_chunks().to_batches()[0]], "bits long, id long", ["bits"], lambda t: t.select(["bits", "id"]).combine_chunks().to_batches()[0])
    assert sorted(r.id for r in seen.collect()) == list(range(n)) and n > most
    sets = [np.unique(np.random.default_rng(k // 4).integers(0, 40, 12 + k % 3)) for k in range(60)]
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int32))
    rows = [(bytes([k]), None, len(h), simhash.leading(h.astype(np.uint64), 0.8, none).view(np.int64).tolist()) for k, h in enumerate(sets)]
    leads = spark.createDataFrame(rows, "node binary, root binary, n int, lead array<long>")
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    for block in (simhash.BLOCK, 2):
        got = {(r.u[0], r.v[0]) for r in simhash.prefix_pairs(leads, 0.8, block).collect()}
        assert want <= got and want


def test_spanning_forest_is_the_least():
    rng = np.random.default_rng(3)
    for n, m in ((1, 0), (12, 30), (40, 400), (30, 10)):
        i, j, d = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(0, 9, m)
        root = list(range(n))
        cost = 0

        def find(x, root=root):
            return x if root[x] == x else find(root[x])

        for k in np.argsort(d, kind="stable"):
            a, b = find(int(i[k])), find(int(j[k]))
            if a != b:
                root[a] = b
                cost += int(d[k])
        pick = simhash.spanning(n, i, j, d)
        assert int(d[pick].sum()) == cost and len(pick) == n - len({find(x) for x in range(n)})


def near_zero(rows):
    return next(r.component_id for r in rows if r.fingerprint == "0" * 16)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 299), (299, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {k: 100 for k in range(101, 160)} | {300: 299}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    names = [("b", "a"), ("c", "b"), (None, "a"), ("z", None), ("q", "q"), ("y", "x"), ("x", "y")]
    assert {r.node: r.root for r in components(spark.createDataFrame(names, "u string, v string")).collect()} == {"b": "a", "c": "a", "y": "x"}


# -- substrings ---------------------------------------------------------------


def repeats_by_hand(rows):
    first = {}
    key = lambda d: 2**63 - 1 if d is None else d
    cut = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in cut:
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, 2**63), key(d))
    out = []
    for d, w in cut:
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < key(d):
                gone[i : i + 13] = [True] * 13
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def substring_rows():
    rng = np.random.default_rng(6)
    words = [f"w{i}é" for i in range(30)]
    say = lambda n: " ".join(rng.choice(words, n))
    passages = [say(13), say(60), say(25), "same " * 40]
    rows = []
    for i in range(150):
        parts = [say(rng.integers(0, 40))] + [passages[k] for k in rng.integers(0, 4, rng.integers(0, 3))] + [say(rng.integers(0, 30))]
        rows.append((int(rng.integers(0, 500)), "\n".join(parts)))
    rows += [(None, passages[1]), (None, passages[1]), (3, None), (4, ""), (5, "  \t"), (900, rows[0][1]), (900, rows[0][1]), (901, say(12)), (902, "the end " * 20_000 + passages[2]), (1, passages[1].replace(" ", "\x0b")), (903, "x y " * 30)]
    return rows


@pytest.mark.parametrize("seed", [0, 2])
def test_repeats(spark, monkeypatch, seed):
    rows = substring_rows()
    if seed:
        monkeypatch.setattr(substrings, "Hasher", lambda s, real=substrings.Hasher: real(s + seed))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"doc": F.lit("old"), "row": F.lit("old"), "roles": F.lit("old")})
    assert sorted(map(tuple, substrings.remove_repeats(df).collect()), key=str) == repeats_by_hand(rows)
    assert substrings.remove_repeats(df.where("false")).count() == 0


@pytest.mark.parametrize("most", [10_000, 0])
def test_repeats_of_hot_passages(spark, monkeypatch, most):
    """With every minimizer, and with some, on the way for very frequent ones."""
    monkeypatch.setattr(substrings, "MOST_BROADCAST", most)
    rows = substring_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for sample in (1, 4):
        monkeypatch.setattr(substrings, "SAMPLE", sample)
        assert sorted(map(tuple, substrings.remove_repeats(df, hot_rows=2 if sample == 1 else 8).collect()), key=str) == repeats_by_hand(rows)


def test_repeats_survive_bad_hashes(spark, monkeypatch):
    """Hashes that call everything equal are found out, and words decide."""
    real = substrings._occurrences

    def broken(docs, seed):
        out = real(docs, seed)
        return out if seed else out.withColumn("key", F.lit(1).cast("long")).withColumn("edges", F.to_binary(F.regexp_replace(F.hex("edges"), "[0-9A-F]", "0"), F.lit("hex")))

    monkeypatch.setattr(substrings, "_occurrences", broken)
    rows = substring_rows()
    out = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, out.collect()), key=str) == repeats_by_hand(rows)


@pytest.mark.parametrize("seed, bits, hot_rows", [(0, 3, 500_000), (1, 8, 500_000), (2, 8, 2)])
def test_repeats_when_every_seed_clashes(spark, monkeypatch, seed, bits, hot_rows):
    """Hashes of a few bits clash under any seed; the answer is that of the words."""
    real = substrings.Hasher

    class Narrow(real):
        @staticmethod
        def grams(words, factors):
            return real.grams(words, factors) & np.uint64((1 << bits) - 1)

    calls = []
    mended = substrings._mended
    monkeypatch.setattr(substrings, "Hasher", Narrow)
    monkeypatch.setattr(substrings, "SAMPLE", 1)
    monkeypatch.setattr(substrings, "_mended", lambda *a: calls.append(1) or mended(*a))
    rows = substring_rows()
    out = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), hot_rows=hot_rows, seed=seed)
    assert sorted(map(tuple, out.collect()), key=str) == repeats_by_hand(rows) and calls == [1]


def test_repeats_of_one_clash_leave_the_other_documents(spark, monkeypatch):
    """Two windows that are called equal and aren't: only their documents are done again."""
    real = substrings.Hasher
    one, two = ([f"{c}{i}" for i in range(13)] for c in "ab")
    rows = [(1, " ".join(one)), (2, " ".join(two)), (3, "x " + " ".join(two)), (4, " ".join(one) + " y"), (5, "alone " * 5)]
    data = " ".join(one + two).encode()
    alike = substrings.super_edges(real(0), np.frombuffer(data, np.uint8), np.array([0, len(data) // 2, len(data)]))[3]
    assert len(alike) == 2

    class Clash(real):
        @staticmethod
        def grams(words, factors):
            h = real.grams(words, factors)
            return np.where(h == alike[1], alike[0], h) if len(factors) == substrings.WINDOW else h & np.uint64(0)

    again = []
    applied = substrings._applied
    monkeypatch.setattr(substrings, "Hasher", Clash)
    monkeypatch.setattr(substrings, "_applied", lambda docs, roles: again.append(docs.count()) or applied(docs, roles))
    out = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, out.collect()), key=str) == repeats_by_hand(rows)
    assert again[0] == 5 and again[1] < 5


def test_repeats_of_a_source_with_many_paths(spark, monkeypatch):
    """A source whose paths are dealt over several copies of its text has one row."""
    monkeypatch.setattr(substrings, "MOST_ROLES", 4)
    words = [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(words))] + [(i, " ".join(words[i * 3 : i * 3 + 13 + i % 7])) for i in range(1, 60)] + [(None, " ".join(words))]
    out = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, out.collect()), key=str) == repeats_by_hand(rows)


@pytest.mark.parametrize("hot_rows", [500_000, 2])
def test_windows_are_told_apart_by_all_bits(spark, monkeypatch, hot_rows):
    """Windows whose hashes agree in the upper 32 bits are no match, on either way, without a look at the words."""
    real = substrings.Hasher

    class Half(real):
        @staticmethod
        def grams(words, factors):
            h = real.grams(words, factors)
            return h | np.uint64(0xFFFFFFFF00000000) if len(factors) == substrings.WINDOW else h

    monkeypatch.setattr(substrings, "Hasher", Half)
    monkeypatch.setattr(substrings, "_mended", lambda *a: pytest.fail("a false match"))
    monkeypatch.setattr(substrings, "SAMPLE", 1)
    rows = substring_rows()
    out = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), hot_rows=hot_rows)
    assert sorted(map(tuple, out.collect()), key=str) == repeats_by_hand(rows)


def test_first_seen_over_batches():
    """A key whose rows come in many batches gives the same pieces as in one."""
    hasher = substrings.Hasher(0)
    texts = [b" ".join(b"t%d" % (i % 20) for i in range(n)) for n in (30, 45, 60, 20)]
    data, offs = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    doc, start, key, edge, at = substrings.super_edges(hasher, data, offs)
    order = np.lexsort((start, doc, key.view(np.int64)))

    def run(step):
        seen, out = substrings.FirstSeen(), Counter()
        for a in range(0, len(order), step):
            o = order[a : a + step]
            size = np.diff(at)[o]
            edges = np.concatenate([edge[at[k] : at[k + 1]] for k in o])
            made = seen.take(key.view(np.int64)[o], doc[o], doc[o], start[o], edges, np.concatenate([[0], np.cumsum(size)]))
            for d, _, p, n, s, _, q in zip(*made) if made is not None else ():
                for k in range(n):
                    out[int(d), int(p) + k, int(s), int(q) + k] += 1
        return out

    assert run(1) == run(1000) and run(1)


# -- pipeline -----------------------------------------------------------------


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as p
    from siltstone.llm.shared import written

    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["quality", "lines", "near_duplicates", "mixing", "encoding"] and p.ORACLE_SQL is None
    seen = {}
    for name, stage in p.STAGES:
        out = written(stage(spark, docs, d))
        if name != "encoding":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = (docs, out)
        docs = out
    before, after = seen["quality"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    kept = {r.doc_id for r in after.collect()}
    good, bad = ([i for i, q in labels.items() if q == v] for v in (1, 0))
    assert np.mean([i in kept for i in good]) > 0.97 and np.mean([i in kept for i in bad]) < 0.4
    before, after = seen["lines"]
    want = lines_by_hand([(r.doc_id, r.text, r.source) for r in before.collect()], 5, 20)
    assert sorted(((r.doc_id, r.text) for r in after.collect()), key=str) == sorted(((w[0], w[1]) for w in want), key=str)
    assert all(r.n_chars == len(r.text) for r in after.collect())
    before, after = seen["near_duplicates"]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    root = similar_by_hand([t for _, t in rows])  # five words, 0.8
    assert sorted(r.doc_id for r in after.collect()) == sorted(rows[k][0] for k in set(root))
    before, after = seen["mixing"]
    plan = {r.doc_id: (r.taken, r.size) for r in mix(before).collect()}
    times = Counter(r.doc_id for r in after.collect())
    assert all(times[i] == (round(t / n + 1e-9) if n else 0) for i, (t, n) in plan.items())
    before, after = seen["encoding"]
    vocab = _vocabulary()
    assert sorted((r.doc_id, r.token_ids) for r in after.collect()) == sorted((r.doc_id, vocab.encode(r.text, add_special_tokens=False).ids) for r in before.collect())


def test_pipeline_stages_take_what_comes(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, extra columns, and an empty table."""
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", None, None, None), (None, "some words here", "en", None, 3), (3, "some words here", "en", "s", 3), (3, "some words here", "en", "s", 3), (4, "w " * 100_000, "en", "s", 1), (5, "line one is long enough\nb", "en", "t", 2)]
    extra = {c: F.lit(c) for c in ("score", "gone", "fp", "taken", "size", "key", "n_tokens", "row", "token_ids")}
    for df in (spark.createDataFrame(rows, shape), spark.createDataFrame([], shape)):
        for name, stage in p.STAGES:
            out = stage(spark, df.withColumns(extra), d)
            found = out.collect()
            if name == "encoding":
                assert len(found) == df.count()
                continue
            assert set(out.columns) == {*df.columns, *extra} and all(r.score == "score" and r.key == "key" for r in found)
            ids = Counter((r.doc_id, r.text) for r in found)
            if df.count() and name == "lines":
                assert len(found) == len(rows)
            if df.count() and name == "near_duplicates":  # no words, "some words here", the long one, the last one
                assert len(found) == 4 and ids[3, "some words here"] == 1 and ids[1, None] == 1
            if df.count() and name == "mixing":
                assert all(r.text.split() for r in found)
        assert spark.createDataFrame([], shape).count() == 0


def _vocabulary():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_queries_are_all_there(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
