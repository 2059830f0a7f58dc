"""Repeats, near copies and vectors against their definitions."""

import random

import numpy as np
import pytest
from cases import corpus, frame, linked_classes, shingles, windows_later, words

from murmur.llm import adaptive_scan, grid_join, jaccard_tree, suffix_array, suffix_tree
from murmur.llm.blocks import BlockWords, minimisers, sliding
from murmur.llm.common import U, hash64, mix
from murmur.llm.components import components

import pyarrow as pa
from pyspark.sql import functions as F


def kept_words(table, n):
    late = windows_later(table, n)
    out = {}
    for k, (_, text) in enumerate(table):
        w = words(text)
        gone = {p for i in range(len(w)) if (k, i) in late for p in range(i, i + n)}
        out[k] = [x for p, x in enumerate(w) if p not in gone]
    return out


def test_sliding_and_minimisers():
    g = np.random.default_rng(1)
    x = g.integers(0, 50, 200).astype(U)
    for n in (1, 2, 3, 7, 16):
        assert sliding(x, n, np.minimum).tolist() == [min(x[i:i + n]) for i in range(len(x) - n + 1)]
    text = " ".join(str(i) for i in g.integers(0, 9, 300))
    a, b = (BlockWords(pa.array(t)) for t in ([text], ["before it " + text + " after", "other"]))
    _, ok, chosen = minimisers(a, 20, 6)
    assert all(chosen[i:i + 15].any() for i in np.flatnonzero(ok))  # every window holds one
    _, _, moved = minimisers(b, 20, 6)
    inner = np.flatnonzero(chosen)
    assert moved[inner + 2].all()


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    texts = corpus(seed)
    table = list(enumerate(texts))
    expected = kept_words(table, 20)
    got = {r.doc_id: r for r in suffix_tree.dedup(frame(spark, texts), 20, capacity=500).collect()}
    for k, t in table:
        assert got[k].kept == " ".join(expected[k]) and got[k].n_words == len(words(t))
        assert got[k].n_removed == len(words(t)) - len(expected[k]) == sum(s.length for s in got[k].spans)


def test_substring_dedup_ids_and_columns(spark):
    base = " ".join(f"w{i}" for i in range(25))
    got = suffix_tree.dedup(frame(spark, [base, base, base, None], ids=[5, None, 5, 9], parts=1), 20).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in got) == [(False, 5, 25), (False, 5, 25), (False, 9, 0), (True, 0, 0)]
    docs = frame(spark, [base, base + " tail", "alone   spaced", None, "", base])
    clean = suffix_tree.without_repeats(docs, 20)
    assert clean.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in clean.collect()} == {0: (base, len(base)), 1: ("tail", 4), 2: ("alone   spaced", 14), 3: ("", 0), 4: ("", 0)}
    assert suffix_tree.dedup(docs.limit(0), 20).count() == 0


@pytest.mark.parametrize("seed", [1, 3])
def test_repeated_spans(spark, seed):
    texts = corpus(seed)
    table = list(enumerate(texts))
    late = windows_later(table, 30)
    expected = set()
    for k, (doc, _) in enumerate(table):
        starts = sorted(i for d, i in late if d == k)
        run = []
        for i in [*starts, None]:
            if run and (i is None or i - run[-1] > 30):
                expected.add((doc, run[0], run[-1] + 30 - run[0], late[k, run[0]]))
                run = []
            run.append(i)
    got = suffix_array.repeated_spans(frame(spark, texts), 30, capacity=40)
    assert {tuple(r) for r in got.collect()} == expected and expected
    assert suffix_array.repeated_spans(frame(spark, texts).limit(0), 30).count() == 0
    assert suffix_array.repeated_spans(frame(spark, ["a b c", None]), 30).count() == 0


@pytest.mark.parametrize("shingle,percent", [(4, 85), (5, 80)])
def test_jaccard_join(spark, shingle, percent):
    texts = corpus(5)
    sets = [shingles(t, shingle) for t in texts]
    link = lambda a, b: bool(a and b) and 100 * len(a & b) >= percent * len(a | b)
    expected = linked_classes(sets, link)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_tree.join(frame(spark, texts), shingle, percent).collect()}
    assert got == {i: (len(s), expected[i]) for i, s in enumerate(sets)}
    docs = frame(spark, texts)
    one = jaccard_tree.one_of_each(docs, shingle, percent)
    assert one.columns == docs.columns
    assert {r.doc_id: r.text for r in one.collect()} == {i: t or "" for i, t in enumerate(texts) if expected[i] == i}


@pytest.mark.parametrize("parts", [1, 9])
def test_jaccard_subsets_that_lack_the_least_hashes(spark, parts):
    # the first round sees none of these links, and a shingle's only other component is out of its holder's own size
    texts, expected = [], {}
    for k in range(3, 16):
        own = [f"s{k}x{i}" for i in range(100)]
        own = [own[i] for i in np.argsort(hash64(own))]
        for t in (own, own[k:]) if k % 2 else (own[k:], own):
            expected[len(texts)] = (len(t), len(texts) // 2 * 2)
            texts.append(" ".join(t))
    for k in (9, 10):  # a chain: x and z link through y only
        own = [f"c{k}x{i}" for i in range(100)]
        own = [own[i] for i in np.argsort(hash64(own))]
        first = len(texts)
        for t in (own, own[2 * k:], own[k:]):
            expected[len(texts)] = (len(t), first)
            texts.append(" ".join(t))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_tree.join(frame(spark, texts, parts=parts), 1, 85).collect()}
    assert got == expected


def test_finer_counts_bound_the_overlap():
    g = np.random.default_rng(6)
    sets = [np.unique(g.integers(0, 1 << 62, 3000 if k % 7 == 0 else 200) if k % 3 else np.concatenate([base, g.integers(0, 1 << 62, 40)]))
            for k in range(40) for base in [np.random.default_rng(k % 2).integers(0, 1 << 62, 150)]]
    raw = []
    for x in sets:
        group = ((x.astype(U) >> U(20)) % U(jaccard_tree.FINE)).astype("<u2")
        raw.append(np.sort(group).tobytes() if len(x) <= jaccard_tree.SPARSE
                   else jaccard_tree.shrunk(np.bincount(group % jaccard_tree.GROUPS, minlength=jaccard_tree.GROUPS)))
    for i in range(40):
        for j in range(i):
            most = jaccard_tree.overlap(raw[i], len(sets[i]), raw[j], len(sets[j]))
            assert most >= len(np.intersect1d(sets[i], sets[j]))
    small = [i for i in range(40) if len(sets[i]) <= jaccard_tree.SPARSE]
    a, b = np.array([(i, j) for i in small for j in small if j < i]).T
    many = jaccard_tree.overlaps(raw, a, b)
    assert many.tolist() == [jaccard_tree.overlap(raw[i], len(sets[i]), raw[j], len(sets[j])) for i, j in zip(a, b)]


def test_parities_bound_the_difference():
    g = np.random.default_rng(9)
    sets = [np.unique(g.integers(0, 2**63, n).astype(U)) for n in (1, 3, 80, 97, 180, 300, 300, 2000, 2400, 120_000)]
    sets += [x[len(x) // 10:] for x in sets] + [np.unique(np.concatenate([x, sets[5][:40]])) for x in sets]
    s = object.__new__(jaccard_tree.Sets)
    s.size = np.array([len(x) for x in sets])
    s.value, s.doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), s.size)
    width = jaccard_tree.parity_words(s.size, 85)
    assert len(s.parities(85)) == width.sum() and width[:4].tolist() == [1, 1, 1, 2]
    a, b = np.triu_indices(len(sets))
    found = jaccard_tree.apart(s.parities(85), np.cumsum(width) - width, width, a, b)
    true = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(a, b)])
    assert (found <= true).all() and (found[a == b] == 0).all()
    assert found[(a == 5) & (b == 6)] > 100 and found[(a == 7) & (b == 8)] > 400  # far more than a link leaves room for


@pytest.mark.parametrize("crowd", [0, 700])
def test_documents_that_meet_by_chance_send_no_counts(crowd):
    # two blocks; documents 0 link across them, all others share one shingle with a stranger of their size
    g = np.random.default_rng(4)
    own = [[np.unique(g.integers(0, 2**63, 200).astype(U)) for _ in range(40 + crowd)] for _ in range(2)]
    own[1][0] = np.unique(np.concatenate([own[0][0][:190], own[1][0][:10]]))
    token = np.concatenate([np.arange(1, 41, dtype=np.int64), np.full(crowd, 99)]).astype(U) << U(20)
    parts = []
    for block, sets in enumerate(own):
        s = object.__new__(jaccard_tree.Sets)
        s.size = np.array([len(x) for x in sets])
        s.value, s.doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), s.size)
        comp = np.arange(len(sets)) * 2 + block
        parts.append(jaccard_tree.sketches(block, token, np.arange(len(sets)), s.size, comp, s.parities(85), 1, 85))
    got = jaccard_tree.alike(85)(pa.Table.from_batches(parts))
    stay = [0, *range(40, 40 + crowd)]  # a crowd at one shingle is left to the tree
    assert got.column("block").to_pylist() == [0, 1]
    for x in got.column("hot").to_pylist():
        assert sorted(np.frombuffer(x, U).tolist()) == sorted(mix(jaccard_tree.short(token[stay]).astype(U), np.array(stay).astype(U)).tolist())


@pytest.mark.parametrize("parts", [2, 11])
def test_jaccard_among_chance_meetings(spark, parts):
    # few words, so that unrelated texts share shingles; pairs on both sides of the limit
    g = np.random.default_rng(12)
    texts = []
    for _ in range(60):
        base = [f"w{i}" for i in g.integers(0, 12, g.integers(30, 400))]
        texts.append(" ".join(base))
        for share in (0.005, 0.02, 0.04):
            hit = g.random(len(base)) < share
            texts.append(" ".join(f"w{g.integers(0, 12)}" if h else x for x, h in zip(base, hit)))
    texts = [texts[i] for i in g.permutation(len(texts))]
    sets = [shingles(t, 4) for t in texts]
    expected = linked_classes(sets, lambda a, b: 100 * len(a & b) >= 85 * len(a | b))
    assert 60 < len(set(expected)) < 220
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_tree.join(frame(spark, texts, parts=parts), 4, 85).collect()}
    assert got == {i: (len(s), expected[i]) for i, s in enumerate(sets)}


def test_jaccard_edges(spark):
    t = "a b c d e f"
    got = jaccard_tree.join(frame(spark, [t, t, t, None, "", "x y", "X  Y"], ids=[3, 3, None, 1, 2, 8, 7])).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in got)) == [
        (False, 1, 0, 1), (False, 2, 0, 2), (False, 3, 3, 3), (False, 3, 3, 3), (False, 7, 1, 7), (False, 8, 1, 7), (True, 0, 3, 3)]
    assert jaccard_tree.join(frame(spark, []).limit(0)).count() == 0


def test_tree_rules_out_no_link():
    g = np.random.default_rng(2)
    base = g.integers(0, 4000, (40, 300))
    sets = []
    for k in range(400):
        row = base[k % 40].copy()
        row[g.integers(0, 300, g.integers(0, 60))] = g.integers(0, 4000)
        sets.append(np.unique(row).astype(U))
    size = np.array([len(s) for s in sets])
    vec = np.array([np.bincount((s % U(16)).astype(int), minlength=16) for s in sets]).astype(np.int32)
    tree = jaccard_tree.Tree(size, vec)
    found = {(min(a, b), max(a, b)) for x, y in tree.pairs(85, np.arange(400)) for a, b in zip(x.tolist(), y.tolist())}
    true = {(i, j) for j in range(400) for i in range(j) if jaccard_tree.linked(sets[i], sets[j], 85)}
    assert true <= found and len(found) < 400 * 399 // 8


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(90)] + [(200, 205), (205, 203), (7, 7), (300, 300)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(91)}, 200: 200, 205: 200, 203: 200, 300: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vector_rows(seed, n=300, d=12):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, d))
    for k in range(0, n, 5):
        x[k] = x[k % 20] + 0.05 * g.normal(size=d)
    x[50:60] = x[50]
    rows = [(i, [float(np.float32(v)) for v in r], 1, "x") for i, r in enumerate(x)]
    odd = [None, [0.0] * d, [float("nan")] + [1.0] * (d - 1), [None] + [1.0] * (d - 1), [float("inf")] * d, [1.0, 2.0], []]
    return rows + [(n + i, v, 2, "y") for i, v in enumerate(odd)], n


SCHEMA = "vec_id long, embedding array<float>, key int, v string"


def test_grid_join(spark):
    rows, n = vector_rows(3)
    x = np.array([r[1] for r in rows[:n]])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    classes = linked_classes(list(range(n)), lambda a, b: near[a, b])
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in grid_join.near_duplicates(table, 0.95, interval=40).collect()}
    expected = {i: (int(near[i].sum()) - 1, classes[i], classes[i] == i) for i in range(n)}
    assert got == expected | {n + i: (0, n + i, True) for i in range(7)}
    assert max(v[0] for v in got.values()) >= 9
    assert grid_join.near_duplicates(table.limit(0)).count() == 0
    assert {r.n_links for r in grid_join.near_duplicates(table.where(f"vec_id >= {n}")).collect()} <= {0}


@pytest.mark.parametrize("probe,least", [(1.0, 0.99), (0.85, 0.9)])
def test_adaptive_scan(spark, probe, least):
    rows, n = vector_rows(4, 1500, 32)
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    x = np.array([r[1] for r in rows[:n]])
    got = {}
    for r in adaptive_scan.search(table, F.col("vec_id") % 20 == 0, 20, probe=probe).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in range(0, n, 20):
        score = x @ x[q]
        order = [i for i in np.lexsort((np.arange(n), -score)) if i != q][:20]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21)) and all(abs(score[m[1]] - m[2]) < 1e-9 for m in mine)
        assert mine == sorted(mine, key=lambda m: (-m[2], m[1])) and q not in [m[1] for m in mine]
        hits += len({m[1] for m in mine} & set(order))
        total += 20
    assert set(got) == set(range(0, n, 20)) and hits / total >= least


def test_adaptive_scan_edges(spark):
    few = spark.createDataFrame([(i, [1.0, float(i % 2)], 1, "x") for i in range(7)], SCHEMA)
    got = sorted(tuple(r) for r in adaptive_scan.search(few, F.col("vec_id") % 20 == 0, 20, probe=1.0).collect())
    assert [(g[1], g[2], g[3]) for g in got] == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0), (4, 4, 1.0), (5, 5, 1.0), (6, 6, 1.0)]
    assert adaptive_scan.search(few.limit(0), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("n", [7, 20, 24])
def test_adaptive_scan_of_a_small_table_finds_all(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 8)).astype(np.float32)
    rows = [(i, v.tolist(), 1, "x") for i, v in enumerate(x)]
    rows += [(0, (-x[0]).tolist(), 1, "x")] * 3  # equal ids never find each other
    got = {}
    for r in adaptive_scan.search(spark.createDataFrame(rows[:n], SCHEMA), F.col("vec_id") >= 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert all(len(got[q]) == min(20, n - 1) and q not in got[q] for q in range(n))
    again = adaptive_scan.search(spark.createDataFrame(rows, SCHEMA), F.element_at("v", 1) == float(x[0, 0])).collect()
    assert len({r.vec_id for r in again}) == len(again) == min(20, n - 1) and 0 not in [r.vec_id for r in again]


def test_queries_with_equal_ids_rank_by_themselves(spark):
    x = np.random.default_rng(3).normal(size=(60, 8))
    rows = [(i, v.tolist(), 1, "x") for i, v in enumerate(x)] + [(0, (-x[0]).tolist(), 1, "x")]
    got = adaptive_scan.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0, 20, probe=1.0).collect()
    both = np.float32(x).astype(float) if "float" in SCHEMA else x
    score = both[1:] @ both[0]
    want = sorted((0, r + 1, int(i) + 1) for s in (score, -score) for r, i in enumerate(np.lexsort((np.arange(59), -s))[:20]))
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == want


def test_inner_nodes_are_those_of_a_tree():
    r = random.Random(8)
    for n in (1, 2, 3, 40, 200):
        words = sorted(tuple(r.randrange(3) for _ in range(suffix_tree.EDGES)) for _ in range(n))
        common = np.array([next((k for k in range(suffix_tree.EDGES) if a[k] != b[k]), suffix_tree.EDGES) for a, b in zip(words, words[1:])], np.int64)
        # by definition: prefixes of two rows at least, not all of which go on alike
        want = set()
        for d in range(1, suffix_tree.EDGES + 1):
            for p in {w[:d] for w in words}:
                at = [k for k, w in enumerate(words) if w[:d] == p]
                if len(at) > 1 and (d == suffix_tree.EDGES or len({words[k][:d + 1] for k in at}) > 1):
                    want.add((d, at[0], at[-1]))
        assert set(zip(*(x.tolist() for x in suffix_tree.inner_nodes(common)))) == want
        deep = set(zip(*(x.tolist() for x in suffix_tree.inner_nodes(common, suffix_tree.EDGES))))
        assert deep == {w for w in want if w[0] == suffix_tree.EDGES}


def test_symbols_spell_the_window():
    b = BlockWords(pa.array(["a b c d e f g h i j k l m n o p q r s t u", "x b c d e f g h i j k l m n o p q r s t u v"]))
    assert sum(n for _, n in suffix_tree.edge_words(20)) == 20 and suffix_tree.edge_words(7)[-1][0] + suffix_tree.edge_words(7)[-1][1] == 7
    s = suffix_tree.symbols(b, np.array([0, 1, 21, 22]), 20)
    assert (s[1] == s[3]).all() and s[0, 0] != s[2, 0] and (s[0, 1:] == s[2, 1:]).all()


@pytest.mark.parametrize("held", [1, 1 << 14])
def test_grid_join_holds_a_bounded_set_of_intervals(spark, monkeypatch, held):
    rows, n = vector_rows(8, 200)
    rows = [*rows, *[(1000 + i, rows[3][1], 1, "x") for i in range(5)]]
    x = np.array([r[1] for r in rows[:n] + rows[-5:]])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.95).sum(1) - 1
    monkeypatch.setattr(grid_join, "HELD_BYTES", held)
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.vec_id: r.n_links for r in grid_join.near_duplicates(table, 0.95, interval=30).collect()}
    ids = [r[0] for r in rows[:n] + rows[-5:]]
    assert {i: got[i] for i in ids} == dict(zip(ids, links.tolist()))


def test_blocks_go_to_workers_in_small_batches(spark):
    from murmur.llm.blocks import write_blocks
    from murmur.session import ARROW_BYTES
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    write_blocks(frame(spark, ["a b c"]))
    assert int(spark.conf.get(key)) == ARROW_BYTES
    spark.conf.set(key, "1000")  # a smaller one stays
    write_blocks(frame(spark, ["a b c"]))
    assert spark.conf.get(key) == "1000"
    spark.conf.unset(key)


def test_suffix_blocks_hold_a_bounded_text(spark, monkeypatch):
    from murmur.llm import blocks
    made, write = [], blocks.write_blocks
    monkeypatch.setattr(suffix_array, "write_blocks", lambda *a: made.append(write(*a)) or made[-1])
    texts = [" ".join(f"w{k}x{i % 977}" for i in range(60_000)) for k in range(9)]  # 0.5 MB each
    assert suffix_array.repeated_spans(frame(spark, texts, parts=1), 50).count() >= 9
    assert max(sum(np.frombuffer(r.size, "<i8")) for r in made[0].select("size").collect()) <= 2 << 20
