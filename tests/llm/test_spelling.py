"""Spelling variants against brute force; skewed blocks, awkward rows, chains of forms."""

import random
import re
import zlib
from collections import Counter

import pytest

from parcelflow.llm import spelling


def words_of(rows, least_letters=7, least=2):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            if len(w) >= least_letters:
                n[w] += 1
    return {w: c for w, c in n.items() if c >= least}


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def brute(n):
    form, near = {}, {}
    for w in n:
        own = [v for v in n if one_edit(w, v)]
        near[w] = len(own)
        best = min(own, key=lambda v: (-n[v], v.encode()), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], near[w], n[form[w]] if form[w] else None))
    return out


def made(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéÿ×") for _ in range(rng.randint(6, 12))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "abababab", "babababa", "Straßenbahn"]
    words = []
    for w in base:
        words += [w] * rng.choice([2, 3, 40, 500])
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(len(w) + 1)
            v = rng.choice([w[:k] + rng.choice("abcé") + w[k:], w[:k] + w[k + 1 :], w[:k] + "e" + w[k + 1 :]])
            words += [rng.choice([v, v.upper(), v.capitalize()])] * rng.choice([1, 2, 4, 45])
    rng.shuffle(words)
    rows = [(i, " ".join(words[i * 50 : i * 50 + 50]) + rng.choice([".", "\n", "9x", "Ā", "Ð"])) for i in range(len(words) // 50 + 1)]
    return rows + [(None, " ".join(words[:30])), (3, None), (4, ""), (5, "z" * 30000 + " " + "z" * 29999 + "y " + "z" * 29999), rows[0], rows[0], (6, "z" * 30000 + " " + "z" * 29999 + "y " + "z" * 29999)]


@pytest.mark.parametrize("few, large", [(16, 4096), (1, 3)])
def test_variants_as_brute_force(spark, monkeypatch, few, large):
    monkeypatch.setattr(spelling, "FEW", few)
    monkeypatch.setattr(spelling, "LARGE", large if large > 1000 else 8)
    rows = made(few)
    if large < 1000:  # blocks with one letter between have as many words as the alphabet; more than that are subdivided
        monkeypatch.setattr(spelling, "LARGE", 40)
        rows = [(d, t) for d, t in rows if not t or len(t) < 5000]
        same = ["prefix" + a + b for a in "abcdefghijklm" for b in "abcdefghijklm"]
        rows += [(1000 + k, " ".join(same)) for k in range(2)]
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, n int, key string").repartition(3)
    got = spelling.variants(docs).collect()
    assert len(got) == len({r.word for r in got})
    assert {tuple(r) for r in got} == brute(words_of(rows))


def test_no_rows(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_forms_are_followed_to_the_last(spark):
    chain = [("aaaaaaab", "aaaaaabb"), ("aaaaaabb", "aaaaabbb"), ("aaaaabbb", "aaaabbbb"), ("xxxxxxxx", "yxxxxxxx"), ("aaaabbbb", "aaabbbbb")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "yxxxxxxx" if w[0] == "x" else "aaabbbbb" for w, _ in chain}


def test_each_pair_has_one_block():
    rng = random.Random(4)
    for _ in range(3000):
        u = "".join(rng.choice("ab") for _ in range(rng.randint(7, 10)))
        v = "".join(rng.choice("ab") for _ in range(rng.randint(7, 10)))
        m = max(len(u), len(v))
        n = spelling.edited(u, v, m, m // 2, 0) + spelling.edited(u, v, m, 0, m - m // 2)
        assert n == (u != v and one_edit(u, v))
