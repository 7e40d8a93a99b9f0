"""Exact dedup, near dedup and mixing on small tables with nulls, repeats, ties, clashing columns and no rows."""

import itertools

import numpy as np
import pytest
import xxhash

from ledgerline.llm import bktree, common, components, exact_dedup, mixing, simhash

TEXTS = [(1, "Same text"), (2, "same TEXT"), (3, None), (4, ""), (5, "other"), (5, "other"), (6, "É"), (7, "é"), (None, "same text"), (8, "x" * 5000), (9, "x" * 5000 + "y")]
#: Names that the operators use themselves.
CLASHES = "keep_id kept _len _pre _full _hit _map _bits _at _n _rows _text _doc _size _take _takes _gone _again gone again id fp print fingerprint component_id size copy chunk uid take takes t_doc c_0 c_1 c_7 n_chars y k t held h row at".split()
SCHEMA = "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in CLASHES)


def table(spark, rows=TEXTS):
    return spark.createDataFrame([(d, t, s, *range(90, 90 + len(CLASHES))) for (d, t), s in zip(rows, itertools.cycle(["b", "a", None]))], SCHEMA)


def test_exact_dedup(spark):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(table(spark)).collect()}
    assert got == {(1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 2, True), (6, 6, 1, True), (7, 7, 1, True), (8, 8, 1, True), (9, 9, 1, True)}
    kept = exact_dedup.dedup_rows(table(spark))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 6, 7, 8, 9] and kept.columns == table(spark).columns
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0 and exact_dedup.dedup_rows(table(spark, [])).count() == 0


def test_exact_dedup_without_broadcasts(spark, monkeypatch):
    want = sorted(map(str, exact_dedup.exact_dedup(table(spark)).collect()))
    kept = sorted(map(str, exact_dedup.dedup_rows(table(spark)).collect()))
    monkeypatch.setattr(exact_dedup, "small", lambda df: (df, False))
    assert sorted(map(str, exact_dedup.exact_dedup(table(spark)).collect())) == want
    assert sorted(map(str, exact_dedup.dedup_rows(table(spark)).collect())) == kept


def test_broadcasts_are_bounded_in_rows_and_bytes(spark):
    rows = spark.createDataFrame([(k, "x" * 100, [1, 2, 3] if k else None, None) for k in range(50)], "a long, b string, `c.d` array<int>, e binary")
    assert common.small(rows)[1] and not common.small(rows, rows=49)[1]
    assert common.small(rows, size=50 * (32 + 100 + len("[1, 2, 3]")))[1] and not common.small(rows, size=50 * (32 + 100))[1]
    assert common.small(rows.limit(0), rows=0, size=0)[1]


def test_a_full_bitmap_only_costs_hashes(spark):
    """With 32,768 bits for 40,000 keys that are left, rows pass for others' bits; results are those of plain grouping."""
    rows = [(k, f"{k % 40_000:06d}" + "x" * (k % 40_000 % 7)) for k in range(80_000)] + [(100_000 + k, f"alone {k}" + "y" * (k % 7)) for k in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    out = exact_dedup._refine(df, "doc_id", "text", 128, {}, False, most_bits=exact_dedup.MAP_BITS)
    hashed = out.where("_full IS NOT NULL").count()
    groups = {}
    for k, t in rows:
        groups.setdefault(t, []).append(k)
    assert hashed > sum(len(g) for g in groups.values() if len(g) > 1)
    got = {r._doc: (r._keep, r._n) for r in out.select("_doc", "_keep", "_n").collect()}
    assert got == {k: (max(groups[t]), len(groups[t])) for k, t in rows}
    wide = exact_dedup._refine(df, "doc_id", "text", 128, {}, False)
    assert wide.where("_full IS NOT NULL").count() < hashed and wide.agg(F.sum("_keep")).first()[0] == sum(k for k, _ in got.values())


def brute_fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=3):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= radius:
            root[find(i)] = find(j)
    best = {}
    for k, d in enumerate(ids):
        best[find(k)] = min(best.get(find(k), d), d)
    return {(d, best[find(k)]) for k, d in enumerate(ids)}


def test_simhash_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(300)]
    base = [list(rng.choice(words, 120)) for _ in range(12)]
    rows, n = [], 0
    for b in base:
        for edits in (0, 0, 1, 1, 2, 3, 6):
            t = list(b)
            for _ in range(edits):
                t[int(rng.integers(len(t)))] = "e" + str(rng.integers(99))
            rows.append((n, " ".join(t)))
            n += 1
    rows += [(n, None), (n + 1, " \n"), (n + 2, "one"), (n + 3, "ONE")]
    fps = [brute_fingerprint(t) for _, t in rows]
    got = simhash.near_dedup(table(spark, rows)).collect()
    assert {(r.doc_id, r.fingerprint) for r in got} == {(d, f"{f:016x}") for (d, _), f in zip(rows, fps)}
    assert {(r.doc_id, r.component_id) for r in got} == brute_components([d for d, _ in rows], fps)
    kept = {r.doc_id for r in simhash.dedup_rows(table(spark, rows)).collect()}
    assert kept == {c for _, c in brute_components([d for d, _ in rows], fps)}
    assert simhash.near_dedup(table(spark, [])).count() == 0 and simhash.dedup_rows(table(spark, [])).count() == 0


def test_simhash_keeps_each_text_of_a_repeated_key(spark):
    a, b = " ".join(f"a{k}" for k in range(50)), " ".join(f"b{k}" for k in range(50))
    rows = [(5, a), (5, b), (5, b), (3, a), (6, "some other text that is alone here"), (None, None)]
    kept = simhash.dedup_rows(table(spark, rows))
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(3, a), (5, b), (6, rows[4][1]), (0, "")]) and kept.columns == table(spark).columns


def plain_jaccard(a, b, k=5):
    grams = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (x.lower().split() for x in (a, b))]
    return len(grams[0] & grams[1]) / len(grams[0] | grams[1])


@pytest.mark.parametrize("shard", [2, 2048])
def test_similar_texts_against_brute_force(spark, shard):
    """Pairs well above 0.8 are one component, pairs well below (and not connected otherwise) are not."""
    rng = np.random.default_rng(4)
    words, rows, n = [f"w{k}" for k in range(500)], [], 0
    for size in (30, 60, 200, 900):
        for _ in range(6):
            base = [str(x) for x in rng.choice(words, size)]
            for share in (0, 0.005, 0.01, 0.02, 0.3):
                t = list(base)
                for _ in range(int(np.ceil(share * size))):
                    t[int(rng.integers(len(t)))] = f"e{int(rng.integers(10**6))}"
                rows.append((n, " ".join(t)))
                n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "one"), (n + 3, "ONE"), (n + 3, "ONE"), (None, rows[0][1])]
    got = simhash.similar_dedup(table(spark, rows), shard=shard).collect()
    assert len(got) == len(rows)
    at = {r.doc_id: r.component_id for r in got}
    text = {d: t or "" for d, t in rows if d is not None}
    sure = missed = 0
    for a, b in itertools.combinations(text, 2):
        j = plain_jaccard(text[a], text[b])
        if j >= 0.87:
            sure, missed = sure + 1, missed + (at[a] != at[b])
        assert j > 0.6 or at[a] != at[b] or a // 5 == b // 5
    assert sure > 20 and missed <= 0.02 * sure and at[n] == at[n + 1] == n and at[n + 2] == at[n + 3] == n + 2 and at[None] == at[0]
    kept = simhash.dedup_similar_rows(table(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(at.values())) and kept.columns == table(spark).columns
    assert simhash.dedup_similar_rows(table(spark, [])).count() == 0


@pytest.mark.parametrize("shard", [2, 2048])
def test_pairs_near_the_limit_follow_their_likeness(spark, shard):
    """Pairs whose estimate is doubtful link if and only if 0.8 of their shingles are shared; keys repeat, one is null."""
    rng, rows, pairs = np.random.default_rng(8), [], []
    for n in range(120):
        size = int(rng.choice([60, 150, 400]))
        base = [f"p{n}w{k}" for k in rng.integers(0, 10**6, size)]
        t, at = list(base), rng.permutation(size)
        goal = rng.uniform(0.74, 0.86)
        while plain_jaccard(" ".join(base), " ".join(t)) > goal:
            t[at[0]], at = f"e{n}", at[1:]
        pairs.append((2 * n, 2 * n + 1, plain_jaccard(" ".join(base), " ".join(t))))
        rows += [(2 * n, " ".join(base)), (2 * n + 1, " ".join(t))]
    rows += [rows[0], (2, "another text of a key that repeats"), (None, None)]
    marks = {}
    for r in simhash.similar_dedup(table(spark, rows), shard=shard).collect():
        marks.setdefault(r.doc_id, set()).add(r.component_id)
    near, far = [p for p in pairs if p[2] >= 0.8], [p for p in pairs if p[2] < 0.8]
    assert len(near) > 30 and len(far) > 30
    assert sum(not marks[a] & marks[b] for a, b, _ in near) <= 1  # a pair of 0.8 meets with 0.998
    assert not [p for p in far if marks[p[0]] & marks[p[1]] - {2}]


def test_likeness_of_cut_sets(monkeypatch):
    rng = np.random.default_rng(2)
    whole = np.unique(rng.integers(0, 2**64, 9000, dtype=np.uint64))
    a, b = np.sort(whole[rng.random(len(whole)) < 0.9]), np.sort(whole[rng.random(len(whole)) < 0.9])
    want = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(simhash.likeness_of(a[: simhash.HASHES], b[: simhash.HASHES]) - want) < 0.03
    assert simhash.likeness_of(a[:3000], a[:3000]) == 1 and simhash.likeness_of(a[:1000], a[1000:2000]) == 0
    assert abs(simhash.likeness_of(a[:900], a[: simhash.HASHES]) - 900 / simhash.HASHES) < 1e-9


@pytest.mark.parametrize("shard", [3, 2048])
def test_links_of_a_dense_group_in_blocks(spark, shard):
    rng = np.random.default_rng(5)
    fps = {0}
    while len(fps) < 90:
        v = int(rng.choice(list(fps)))
        for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
            v ^= 1 << int(b)
        fps.add(v)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    c = components.components(simhash.link(df, shard=shard))
    groups = {}
    for r in c.collect():
        groups.setdefault(r.root, set()).add(r.node % (1 << 64))
    want = {}
    for f, g in brute_components(fps, fps):
        want.setdefault(g, set()).add(f)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in want.values() if len(g) > 1}


def test_bk_tree_finds_all():
    rng = np.random.default_rng(1)
    v = np.unique(rng.integers(0, 2**12, 400).astype(np.uint64))
    q, n = bktree.BKTree(v).search(v, 2)
    want = {(i, j) for i in range(len(v)) for j in range(len(v)) if bin(int(v[i] ^ v[j])).count("1") <= 2}
    assert set(zip(q.tolist(), n.tolist())) == want and len(q) == len(want)


def test_mix(spark):
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(["w"] * int(rng.integers(0, 40)))) for k in range(150)] + [(7, "w w w"), (7, "w w w"), (None, "w w"), (151, None)]
    docs = table(spark, rows)
    pieces, whole = mixing.mix(docs, block=8)
    got = whole.collect()
    assert len(got) == len(rows)
    for s in (None, "a", "b"):
        mine = [r for r in got if r.source == s]
        assert sum(r.taken for r in mine) == int(mine[0].target + 0.5) and sum(r.size for r in mine) == mine[0].source_size
        assert all(0 <= r.taken <= 2 * r.size for r in mine)
    total = sum(r.size for r in got)
    assert abs(sum({r.source: r.target for r in got}.values()) - 1.5 * total) < 1e-6
    # early slots already follow the weights
    early = pieces.where("slot < 20 AND taken > 0").select("slot", "source").distinct().collect()
    assert len({r.source for r in early}) == 3
    assert sorted(map(str, mixing.mix(docs, block=8)[1].collect())) == sorted(map(str, got))
    mixed = mixing.mixed_rows(docs, block=8)
    assert mixed.columns == docs.columns and mixing.mix(table(spark, []))[1].count() == 0
    assert all(r.taken == 0 and r.target == 0 for r in mixing.mix(table(spark, [(1, None), (2, " ")]))[1].collect())


@pytest.mark.parametrize("alike", [3, 1000])
def test_mixed_rows_of_repeated_rows(spark, monkeypatch, alike):
    """Rows alike in doc_id, source and size, of equal and of different texts, take together what the target says."""
    monkeypatch.setattr(mixing, "ALIKE", alike)
    rows = [(7, f"a{k} b c d") for k in range(9)] + [(7, "same words here now")] * 8 + [(k, "x y z") for k in range(20, 26)] + [(None, "n n"), (None, "n n"), (30, None), (31, "")]
    docs = spark.createDataFrame([(d, t, "s" if k % 3 else None, 99, 98, 97) for k, (d, t) in enumerate(rows)], "doc_id long, text string, source string, _size int, copy int, size int")
    whole = mixing.mix(docs, block=8)[1].collect()
    assert len(whole) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in whole)
    mixed = mixing.mixed_rows(docs, block=8).collect()
    for s in ("s", None):
        target = int(next(r.target for r in whole if r.source == s) + 0.5)
        assert sum(len(r.text.split()) for r in mixed if r.source == s) == target == sum(r.taken for r in whole if r.source == s)
    assert {(r["_size"], r["copy"], r["size"]) for r in mixed} == {(99, 98, 97)}
    assert mixing.mixed_rows(docs.limit(0)).count() == 0


def test_golden_points_are_exact_for_large_slots(spark):
    from fractions import Fraction

    slots = [0, 1, 2, 3, 10**6, 10**10 + 1, 10**15 + 7, (1 << 61) + 12345]
    got = [r.u for r in spark.createDataFrame([(s,) for s in slots], "id long").select(mixing.golden_point(mixing.F.col("id")).alias("u")).collect()]
    want = [float(Fraction(s * mixing.GOLDEN % (1 << 62), 1 << 62)) for s in slots]
    assert max(abs(a - b) for a, b in zip(got, want)) < 1e-15 and abs(mixing.GOLDEN / 2**62 - (5**0.5 - 1) / 2) < 1e-15


def test_schedule_gives_each_source_its_slots(spark):
    t = spark.createDataFrame([("a", 0, 1000, 5, 1500.0), ("b", 1, 10, 2, 20.0), ("c", 2, 5000, 1, 4000.0)], "source string, sid int, source_size long, weight long, target double")
    s = mixing.schedule(t, 16).collect()
    for sid, n in ((0, 63 + 32), (1, 2), (2, 250)):
        assert sorted(r["rank"] for r in s if r.sid == sid) == list(range(n))
