"""One row of each group of near copies, told by rows: repeated ids, copies under one id, rows without ids or n-grams."""

import random
from collections import Counter
from fractions import Fraction

import pytest

from parcelflow.llm import jaccard


def sets(text, words):
    w = (text or "").lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def groups(rows, words=3):
    """Numbers of the groups of similar rows."""
    s = [sets(t, words) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return group, s


def allowed(rows, got):
    """Whether got holds one row of the least id of each group, and all rows without n-grams."""
    group, s = groups(rows)
    left = Counter(got)
    for g in set(group):
        own = [k for k, x in enumerate(group) if x == g]
        ids = [rows[k][0] for k in own if rows[k][0] is not None]
        fit = [rows[k] for k in own if rows[k][0] == (min(ids) if ids else None)]
        hit = next((r for r in fit if left[r]), None)
        if hit is None:
            return False
        left[hit] -= 1
    return sum(left.values()) == 0


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    base = [" ".join(word() for _ in range(40)) for _ in range(6)]
    near = lambda t: t.rsplit(" ", 1)[0] + " " + word()
    return base, near


def run(spark, rows):
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, h1 int, own_id int").repartition(3)
    out = jaccard.representatives(docs, 3, Fraction(4, 5))
    assert out.columns == docs.columns
    return [(r.doc_id, r.text) for r in out.collect()]


def test_an_id_in_several_groups(spark, texts):
    (a, b, *_), _ = texts
    rows = [(3, a), (7, b), (7, a)]
    assert sorted(run(spark, rows)) == [(3, a), (7, b)]


def test_representatives_as_brute_force(spark, texts):
    base, near = texts
    rows = [(3, base[0]), (7, base[1]), (7, near(base[0])), (7, near(base[1])), (7, base[1]), (8, base[1]), (9, base[2]), (9, near(base[2])), (9, near(base[2]))]
    rows += [(None, base[2]), (None, base[3]), (None, base[3]), (None, near(base[3])), (None, base[4]), (1, near(base[4])), (2, None), (2, ""), (2, " "), (None, ""), (11, base[5]), (12, near(base[5]))]
    got = run(spark, rows)
    assert allowed(rows, got), sorted(got, key=str)


def test_no_rows(spark):
    assert run(spark, []) == []
