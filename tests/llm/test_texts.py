"""Tokenising, packing, language and toxicity operators."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from cases import frame
from tokenizers import Tokenizer

from murmur.llm import langid, packing, sp_bpe, token_count, toxicity
from murmur.llm.common import documents, grams, hash64, mix, words
from murmur.llm.queries import remainder
from murmur.llm.wordtable import Remembered
from murmur.session import table

SF = "/root/testdata/sf0.001"
SP, BYTE, WORDS = (public_tokenizers.path(x) for x in ("piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"))
TEXTS = ["The quick brown fox, jumped.", "", None, " ", "  two  spaces \n\n x", "<|endoftext|> and <|ENDOFTEXT|> <|startoftext|>x", "İstanbul ΣΑΣ ﬁ é é́",
         "漢字かな😀 ▁mark\x00nul", "it's we're o'clock 'd ,'s", "a" * 3000, "word, word. WORD; word", "x  y z\x1c\x85 k", "tab\tnew\nline\r\n", "same", "same"]


def odd_texts(n, seed):
    r = random.Random(seed)
    letters = " \n\tabcdeé▁ß漢😀'.,!-0123ABĆ\x00<s>​"
    return ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(n)]


def test_grams_are_those_of_equal_words():
    h = hash64(["a", "b", "c", "a", "b", "c", "a"])
    for n in range(1, 8):
        g = grams(h, n)
        assert len(g) == 8 - n
        if n < 5:
            assert g[0] == g[3]
    assert mix(h[:1], h[1:2]) != mix(h[1:2], h[:1])


def test_words_follow_the_pattern():
    codes, distinct, off = words(pa.array(["a  b\x0bc", "", "\x1cx y z"]))
    assert [distinct[int(c)].as_py() for c in codes] == ["a", "b", "c", "\x1cx y", "z"]
    assert off.tolist() == [0, 3, 3, 5]


def test_remembered_keeps_answers(monkeypatch):
    monkeypatch.setattr("murmur.llm.wordtable.CACHE_ENTRIES", 5)
    t = Remembered(lambda xs: [x.upper() for x in xs])
    r = random.Random(1)
    for _ in range(50):
        xs = [r.choice("abcdefghijklmn") for _ in range(9)]
        assert t.get(xs) == [x.upper() for x in xs]


def test_sentencepiece_matches_library(spark):
    texts = TEXTS + odd_texts(400, 2)
    sp = sentencepiece.SentencePieceProcessor(model_file=SP)
    got = {r.doc_id: r for r in sp_bpe.encode(frame(spark, texts), SP).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = sp.encode(t or "")
        assert (got[i].n_tokens, got[i].ids, got[i].decoded) == (len(ids), ids, sp.decode(ids)), t
    assert sp_bpe.encode(frame(spark, texts).limit(0), SP).count() == 0


def test_token_counts_match_library(spark):
    texts = TEXTS + odd_texts(400, 3)
    t = Tokenizer.from_file(BYTE)
    got = {r.doc_id: r for r in token_count.count_tokens(frame(spark, texts), BYTE, 20).collect()}
    for i, x in enumerate(texts):
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((x or "").encode()), n, n > 20), x
    assert token_count.count_tokens(frame(spark, texts).limit(0), BYTE).count() == 0
    sp = sentencepiece.SentencePieceProcessor(model_file=SP)
    got = {r.doc_id: r.n_tokens for r in token_count.count_tokens(frame(spark, texts[:12]), SP).collect()}
    assert got == {i: len(sp.encode(x or "")) for i, x in enumerate(texts[:12])}


@pytest.mark.parametrize("d,bits", [(2, 3), (3, 2), (4, 2)])
def test_hilbert_visits_neighbours(d, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
    key = packing.hilbert(cells, bits)
    assert sorted(key.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_packing_covers_every_id_once(spark):
    texts = TEXTS + odd_texts(200, 4)
    t = Tokenizer.from_file(WORDS)
    own = {i: t.encode(x or "", add_special_tokens=False).ids + [1] for i, x in enumerate(texts)}
    got = packing.pack(frame(spark, texts), WORDS, 64).collect()
    docs, seqs = {}, {}
    for r in got:
        assert r.ids == own[r.doc_id][r.start:r.start + r.length] and r.doc_tokens == len(own[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        docs.setdefault(r.doc_id, []).append((r.start, r.length))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts, whole in ((docs, {i: len(x) for i, x in own.items()}), (seqs, dict.fromkeys(seqs, 64))):
        assert set(parts) == set(whole)
        for i, x in parts.items():
            at = 0
            for lo, n in sorted(x):
                assert lo == at
                at += n
            assert at == whole[i] or (parts is seqs and i == max(seqs) and at < 64)
    assert packing.pack(frame(spark, texts).limit(0), WORDS, 64).count() == 0


def test_near_documents_lie_close_on_the_curve():
    matrix = packing.projection()
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base), " ".join([*base[:-1], "other"]), *(" ".join(f"z{k}_{i}" for i in range(120)) for k in range(30))]
    codes, distinct, off = words(pa.array(texts))
    key = packing.curve_keys(codes, hash64(distinct), off, matrix)
    rank = np.argsort(np.argsort(key, kind="stable"))
    assert abs(int(rank[0]) - int(rank[1])) <= 4


def test_backpropagation_is_the_gradient():
    net = langid.Network(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    g = np.random.default_rng(0)
    rows = g.integers(1, 256, (5, langid.SPAN)).astype(np.uint8)
    used, label = np.array([128, 7, 90, 128, 1]), np.array([0, 1, 2, 1, 0])

    def loss():
        p = net.outputs(net.states(rows)[0])
        own = p[:, np.arange(5), label]
        return -(np.log(own) * (np.arange(langid.SPAN)[:, None] < used)).sum() / used.sum()

    grad = net.gradients(rows, used, label)
    for name, at in (("U", (0, 3, 5)), ("U", (1, 2, 12)), ("A", (0, int(rows[0, 5]), 3)), ("A", (1, int(rows[0, 5]), 11)), ("V", (4, 1)), ("c", (2,))):
        was, step = net.p[name][at], 1e-2
        net.p[name][at] = was + step
        up = loss()
        net.p[name][at] = was - step
        down = loss()
        net.p[name][at] = was
        assert abs((up - down) / (2 * step) - grad[name][at]) < 2e-4 + 0.02 * abs(grad[name][at]), (name, at)


def test_language_held_out_and_edges(spark):
    docs = documents(spark, SF)
    net = langid.train(docs.where(remainder() != 0))
    got = docs.where(remainder() == 0).select("doc_id", "lang").join(langid.identify(docs, net), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) >= 0.9
    long = " ".join(["the of and"] * 30_000)
    edge = {r.doc_id: r for r in langid.identify(frame(spark, [None, "", "12 %", long, "é", "é"]), net).collect()}
    assert [edge[i].lang_pred == "und" for i in range(6)] == [True, True, True, False, False, False]
    assert all(0 <= r.score <= 1 for r in edge.values()) and edge[0].score == 0
    assert langid.identify(docs.limit(0), net).count() == 0
    assert langid.train(frame(spark, ["a", None])) is None
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    kept = langid.kept(frame(spark, [None, "", "12 %", long]), net, 0.0)
    assert kept.columns == frame(spark, []).columns and [r.doc_id for r in kept.collect()] == [3]


def string_kernel(a, b):
    """The kernel by its definition."""
    def features(s):
        s, out = "^" + s, {}
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + toxicity.SPAN)):
                    out[s[i] + s[j] + s[k]] = out.get(s[i] + s[j] + s[k], 0) + toxicity.DECAY ** (k - i - 2)
        return out
    x, y = features(a), features(b)
    dot = lambda p, q: sum(v * q.get(k, 0) for k, v in p.items())
    return dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))


def test_kernel_is_that_of_its_definition():
    names = ["idiot", "idxiot", "aaaa", "clown", "banana"]
    columns = np.unique(toxicity.subsequences(names)[1])
    x = toxicity.dense(names, columns)
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            assert abs(x[i] @ x[j] - string_kernel(a, b)) < 1e-9


def invented(seed=5, n=400):
    """Labelled documents in which a few strings make a document toxic."""
    r = random.Random(seed)
    syllables = ["an", "er", "in", "th", "re", "on", "at", "en", "nd", "ti"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 4)))
    bad = ["gromwik", "plafzug", "skrubble"]
    docs, labels = [], []
    for k in range(n):
        t = [word() for _ in range(r.randrange(5, 60))]
        toxic = int(r.random() < 0.25)
        if toxic:
            for _ in range(r.randrange(1, 3)):
                t.insert(r.randrange(len(t)), r.choice(bad))
        docs.append(" ".join(t).capitalize() + ".")
        labels.append((k, toxic))
    return docs, labels, bad


def test_toxicity_learns_and_tolerates_gaps(spark):
    docs, labels, bad = invented()
    lab = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    machine = toxicity.train(frame(spark, docs).where(remainder() != 0), lab)
    got = {r.doc_id: r for r in toxicity.score(frame(spark, docs), machine).collect()}
    held = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    truth = dict(labels)
    assert np.mean([got[k].predicted == truth[k] for k in held]) >= 0.95
    texts = [None, "", *(f"anth {b}. inre" for b in bad), "tion g r o m w i k ere", "an gr.om-wik there", "plafxzug", "An er in there.", " ".join(["anre"] * 50_000)]
    edge = {r.doc_id: r for r in toxicity.score(frame(spark, texts), machine).collect()}
    assert [edge[i].predicted for i in range(len(texts))] == [0, 0, 1, 1, 1, 1, 1, 1, 0, 0]
    assert all(0 <= r.score <= 1 for r in edge.values())
    assert toxicity.score(frame(spark, texts).limit(0), machine).count() == 0
    assert toxicity.train(frame(spark, docs), lab.where("toxic = 1")) is None
    assert {r.predicted for r in toxicity.score(frame(spark, texts), None).collect()} == {0}
    kept = toxicity.kept(frame(spark, texts), machine)
    assert kept.columns == frame(spark, []).columns and {r.doc_id for r in kept.collect()} == {0, 1, 8, 9}


def test_toxicity_of_given_tables(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    machine = toxicity.train(docs.where(remainder() != 0), labels)
    got = docs.where(remainder() == 0).select("doc_id").join(labels, "doc_id").join(toxicity.score(docs, machine), "doc_id").collect()
    pos, neg = ([r.score for r in got if r.toxic == k] for k in (1, 0))
    assert np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]) > 0.8


def test_a_repeated_text_is_sampled_once(spark):
    texts = ["Ein Satz, der oft da ist.", *["One sentence that stands here."] * 200, "Another one."]
    docs = frame(spark, texts, langs=["de", *["en"] * 201])
    got = sorted((r.lang, bytes(r.span)) for r in langid.training_spans(docs, 500).collect())
    assert got == sorted((lang, t.encode()) for lang, t in {("de", texts[0]), ("en", texts[1]), ("en", texts[-1])})
