"""Fill-in-middle, spelling variants and the preference ranking."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import frame
from pyspark.sql import functions as F

from murmur.llm import fill_middle, quality, spelling
from murmur.llm.common import documents
from murmur.llm.queries import op13_quality, remainder
from murmur.session import table

SF = "/root/testdata/sf0.001"
ODD = ["a\nb\nc\n", "a\nb\nc", "\n\n\n", "one line", "", None, "é漢\n😀😀\nend", "x <S> y\nz", "x <P\n>y\nz", "<\n<\n<", "\r\na\r\nb", "same\nrow", "same\nrow",
       "\n".join("l" * (k % 17) for k in range(5000))]


# ---- fill in the middle ---------------------------------------------------------

def test_skip_list_reaches_every_rank():
    r = random.Random(3)
    for n in (0, 1, 2, 7, 8, 9, 63, 64, 65, 700):
        widths = np.array([r.randrange(1, 90) for _ in range(n)], np.int64)
        lines = fill_middle.SkipList(widths)
        assert [lines.chars_before(k) for k in range(n + 1)] == [0, *np.cumsum(widths).tolist()]
        for units, chars, _ in lines.lanes:
            assert sum(units) == n and sum(chars) == widths.sum()
    assert len(lines.lanes) > 2 and len(lines.lanes[1][0]) < 700 / 4


def by_definition(text, doc_id, percent=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    d = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[k:k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(lines)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:lo]), "".join(lines[lo:hi]), "".join(lines[hi:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("percent,spm", [(100, 50), (40, 0), (0, 50)])
def test_fill_in_middle_by_definition(spark, percent, spm):
    r = random.Random(5)
    more = ["".join(r.choice("ab \n\né漢<PSM>") for _ in range(r.randrange(60))) for _ in range(300)]
    table_ = list(enumerate(ODD + more)) + [(None, "no\nid\n"), (3, "id 3\nagain"), (2 ** 60, "long\nid")]
    docs = frame(spark, [t for _, t in table_], [i for i, _ in table_])
    out = fill_middle.transform(docs, 7, percent, spm).withColumn("back", fill_middle.restored())
    rows = out.collect()
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows)
    assert got == Counter((i, *by_definition(t, i, percent, spm)) for i, t in table_)
    assert Counter((r.doc_id, r.back) for r in rows) == Counter((i, t or "") for i, t in table_)
    if percent == 100:
        assert {r.form for r in rows} == {"plain", "spm", "psm"}


def test_fill_in_middle_of_nothing(spark):
    out = fill_middle.transform(frame(spark, [])).withColumn("back", fill_middle.restored())
    assert out.collect() == []


# ---- spelling variants ----------------------------------------------------------

def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def variants_by_definition(rows, least=7, least_n=2, ratio=10, every=31):
    n = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1:]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= least_n}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def spelled(seed, n_words=120, docs=300):
    """Texts of frequent words, their misspellings, and chains of them."""
    r = random.Random(seed)
    letters = "abcdeÉéÿß"
    words = ["".join(r.choice(letters) for _ in range(r.randrange(6, 14))) for _ in range(n_words)]
    words += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "babababa", "prefixed" * 5, "x" * 3000, "x" * 2999 + "y", "x" * 3001]

    def wrong(w):
        k, kind = r.randrange(len(w)), r.randrange(3)
        return w[:k] + (r.choice(letters) if kind else "") + w[k + (kind != 1):]
    out = []
    for _ in range(docs):
        t = []
        for _ in range(60):
            w = words[min(int(r.expovariate(0.05)), len(words) - 1)]
            while r.random() < 0.08:
                w = wrong(w)
            t.append(w.upper() if r.random() < 0.1 else w)
        out.append(r.choice([" ", ", ", "\n", "_"]).join(t))
    # a few runs of one text lose a letter together, so each word stands in several
    for n, w in ((500, "chainlink"), (40, "chainlinx"), (3, "chainlixx"), (500, "chaynlink"), (3, "chainlank")):
        out += [" ".join([w] * n), w]
    return out + [None, "", "1234 %%", out[0], out[0], "ééééééé èééééééé"] + ["×÷×÷×÷×÷"] * 2


def found(df):
    rows = df.collect()
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


def test_variants_by_definition(spark):
    texts = spelled(1)
    ids = [*range(len(texts) - 3), None, 5, 5]
    got = found(spelling.variants(frame(spark, texts, ids)))
    assert got == variants_by_definition(list(zip(ids, texts)))
    assert any(f and root != f for _, f, root, *_ in got)  # a chain


def test_variants_with_every_list_split(spark, monkeypatch):
    monkeypatch.setattr(spelling, "LIST_CHARS", 40)
    texts = ["aaaaaaa", "aaaaaaab aaaaaaac aaaaaaad aaaaaaae", "aaaaaaab aaaaaaaf aaaaaaag " * 5, "baaaaaaa caaaaaaa aaaabaaa aaaacaaa", "x" * 300]
    assert found(spelling.variants(frame(spark, texts), 3, 1, 2)) == variants_by_definition(list(enumerate(texts)), 3, 1, 2)


def test_variants_of_nothing(spark):
    assert spelling.variants(frame(spark, [])).collect() == []
    assert spelling.variants(frame(spark, [None, "", "short words"])).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(frame(spark, []), ratio=1)


def test_every_near_pair_lies_in_one_range():
    r = random.Random(7)
    words = sorted({"".join(r.choice("ab") for _ in range(k)) for k in (1, 2, 3, 4, 5, 9, 10) for _ in range(60)})
    for a, b in itertools.combinations(words, 2):
        if not one_edit(a, b):
            continue
        longer = max(len(a), len(b))
        p = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        at = [k for k, (low, high, _) in enumerate(spelling.ranges(longer)) if low <= min(p, longer - 1) <= high]
        assert len(at) == 1
        low, _, suffix = spelling.ranges(longer)[at[0]]
        assert a[:low] == b[:low] and (not suffix or a[-suffix:] == b[-suffix:])


# ---- quality --------------------------------------------------------------------

def test_pair_loss_falls_to_its_least():
    r = np.random.default_rng(1)
    good, bad = r.normal(0.6, 1, (40, 3)), r.normal(0, 1, (30, 3))

    def loss(w):
        pairs = [math.log1p(math.exp(-(g - b) @ w)) for g in good for b in bad]
        return sum(pairs) / len(pairs) + 1e-3 / 2 * w @ w
    w = quality.fit_pairs(good, bad, 2000)
    for k in range(3):
        for d in (-1e-3, 1e-3):
            moved = w.copy()
            moved[k] += d
            assert loss(w) <= loss(moved) + 1e-7


def test_features_of_a_text_do_not_depend_on_others():
    texts = ["Plain words, here.\nAnd here.", "", "AAA!! BBB!!", "a a a a", "é漢 😀", "\n\n"]
    together = quality.features(pa.array(texts))
    assert together.shape == (len(texts), quality.WIDTH) and np.isfinite(together).all()
    for k, t in enumerate(texts):
        assert np.allclose(quality.features(pa.array([t]))[0], together[k])


def test_features_of_a_long_text_are_counted_in_parts(monkeypatch):
    texts = pa.array(["ab, cd. " * 50, "", "X!\nY?" * 30, "z"])
    whole = quality.features(texts)
    for n in (1, 7, 64):
        monkeypatch.setattr(quality, "AT_ONCE", n)
        assert np.array_equal(quality.features(texts), whole)


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = op13_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9


def test_quality_threshold_is_a_quantile_of_all_scores(spark):
    raw = spark.createDataFrame([(float(k), int(k >= 30)) for k in range(100)], "raw double, _label int").repartition(5)
    cut, gap = quality.threshold(raw)
    assert 29 <= cut <= 30 and gap == pytest.approx(50.0)


def test_quality_edges(spark):
    docs = documents(spark, SF)
    model = quality.train(docs.where(remainder() != 0), table(spark, SF, "labels"))
    texts = ["", None, " ", "Some words.", "Some words.", "X!! " * 90000]
    got = {r.doc_id: r for r in quality.score(frame(spark, texts, [0, 1, 2, 3, None, 5]), model).collect()}
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got.values())
    assert got[0].score == got[1].score and got[3].score == got[None].score
    assert quality.score(frame(spark, []), model).collect() == []
    labels = spark.createDataFrame([(3, 1), (3, None), (None, 0)], "doc_id long, quality int")
    one = quality.train(frame(spark, texts), labels)
    assert {r.predicted for r in quality.score(frame(spark, texts), one).collect()} == {1}
    none = quality.train(frame(spark, texts), labels.where(F.lit(False)))
    assert {r.predicted for r in quality.score(frame(spark, texts), none).collect()} == {0}
