"""Small tables with the awkward cases, and plain definitions to compare with."""

import random
import re

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block long, ids string, kept string, score double, v string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(texts, ids=None, langs=None):
    ids = range(len(texts)) if ids is None else ids
    return [(i, t, None if langs is None else langs[k], "s", None if t is None else len(t), 7, "x", "y", 0.5, "z")
            for k, (i, t) in enumerate(zip(ids, texts))]


def frame(spark, texts, ids=None, langs=None, parts=3):
    return spark.createDataFrame(rows(texts, ids, langs), DOC_SCHEMA).repartition(parts)


def corpus(seed=4, n=60, vocabulary=400):
    """Texts with shared passages, copies, near copies and edge cases."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(vocabulary)}"
    passage = [[word() for _ in range(70)] for _ in range(3)]
    out = []
    for k in range(n):
        t = [word() for _ in range(r.randrange(5, 160))]
        if k % 4 == 0:
            at = r.randrange(len(t))
            t[at:at] = passage[k % 3][r.randrange(12):60 + r.randrange(10)]
        out.append(" ".join(t))
    out += [out[3], out[3], out[8].upper(), None, "", " \t\n", "one", "one two", "a a a a a a a a a a a a a a a a a a a a a a a a a a a a"]
    near = out[11].split()
    for k in range(12):
        t = list(near)
        t[k * len(t) // 12] = "changed"
        out.append("  ".join(t))
    out.append(" ".join(word() for _ in range(9000)) + " " + " ".join(passage[0]))
    return out


def words(text):
    return WORD.findall(text or "")


def windows_later(table, n):
    """(row number, start) of windows that also start earlier, with the id
    where each stands first.  ``table``: (id, text) in the order of the rows."""
    order = sorted(range(len(table)), key=lambda k: (table[k][0] is not None, table[k][0] or 0, k))
    seen, out = {}, {}
    for k in order:
        w = words(table[k][1])
        for i in range(len(w) - n + 1):
            key = tuple(w[i:i + n])
            if key in seen:
                out[k, i] = seen[key]
            else:
                seen[key] = table[k][0]
    return out


def shingles(text, n):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words(text)]
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def linked_classes(items, link):
    """Class of each item under the transitive closure of ``link``."""
    up = list(range(len(items)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(items)):
        for j in range(i):
            if link(items[i], items[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(items))]
