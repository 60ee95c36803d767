"""Steps whose cost a row or a pair was too high at size."""

from fractions import Fraction

import numpy as np
from parcelflow.llm import embeddings, jaccard

WORDS = "a bb ccc dddd eeeee ffffff ggggggg hhhhhhhh iiiiiiiii".split()


def texts():
    rng = np.random.default_rng(5)
    made = [" ".join(rng.choice(WORDS, int(n))) for n in rng.integers(0, 90, 300)]
    return [None, "", " \n\t", "a", "a bb", *made, " lead", "trail ", "A\x0bBB\x0cCCC dddd", made[7], made[9] + " more"]


def test_short_texts_are_hashed_together(monkeypatch):
    """op1, pipeline: n-grams and signatures of some texts are those of each, and are not made text by text."""
    t = texts()
    alone = [jaccard.shingles((x or "").encode(), 5) for x in t]
    lists = [[y.lower() for y in (x or "").split()] for x in t]
    grams = [{tuple(y[i : i + 5]) for i in range(max(1, len(y) - 4))} if y else set() for y in lists]
    assert [len(x) for x in alone] == [len(g) for g in grams]
    for i in range(40):  # equal n-grams have equal hashes, and no others have
        assert [len(np.intersect1d(alone[i], x)) for x in alone] == [len(grams[i] & g) for g in grams]
    calls, hashed = [], jaccard.hashed
    monkeypatch.setattr(jaccard, "hashed", lambda x: calls.append(1) or hashed(x))
    one, none = jaccard.Bands(Fraction(4, 5)), np.zeros(0, np.uint64)
    out, pairs = jaccard.met(t, one, 5, 1, none)
    assert len(calls) <= 3
    for piece in (1 << 20, 100):
        monkeypatch.setattr(jaccard, "PIECE", piece)
        together = jaccard.all_shingles(t, 5)
        assert len(together) == len(alone) and all((a == b).all() for a, b in zip(alone, together, strict=True))
        again, pairs_ = jaccard.met(t, one, 5, 1, none)
        assert again.select(["low", "high"]).to_pylist() == out.select(["low", "high"]).to_pylist()
    frequent = np.unique(np.concatenate(alone))[::7]
    for common in (none, frequent):
        h, first = jaccard.sets_of([(x or "").encode() for x in t], 5)
        for which, doc, found in one.signed(h, first, common):
            for i, s in enumerate(alone):
                own = dict(one.signatures(s, common)).get(one.band(len(s)) + which, none)
                assert (np.sort(found[doc == i]) == np.sort(own)).all()


def test_pairs_of_blocks_are_not_sent(spark, monkeypatch):
    """op8: blocks meet where they are written; what is sent doesn't grow with their pairs, and no link is lost."""
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(40, 6)), 6, axis=0) + 0.3 * rng.normal(size=(240, 6))
    x[::2] = x[::2].astype(np.float32)  # some in single precision, some in double, all in one block
    x[5] = x[11] = x[4]
    rows = [(i, v[: 5 if i % 9 == 0 else 6].tolist()) for i, v in enumerate(x)] + [(300, None), (301, [0.0] * 6), (302, [1.0, None]), (303, [1e300] * 6), (304, [1e-300] * 6)]
    unit = [embeddings.unit(v) for _, v in rows]
    near = np.array([[a is not None and b is not None and i != j and len(a) == len(b) and float(a @ b) >= 0.9 for j, b in enumerate(unit)] for i, a in enumerate(unit)])
    label = np.arange(len(rows))
    for _ in rows:
        label = np.array([min(label[k], *label[near[k]]) if near[k].any() else label[k] for k in range(len(rows))])
    want = sorted((v, int(near[k].sum()), rows[label[k]][0], rows[label[k]][0] == v) for k, (v, _) in enumerate(rows))
    plans, keep = {}, embeddings.materialise
    monkeypatch.setattr(embeddings, "materialise", lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or keep(df, name))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for cell in (2048, 16):
        monkeypatch.setattr(embeddings, "CELL", cell)
        assert sorted(tuple(r) for r in embeddings.near_duplicates(df).collect()) == want
        assert "CartesianProduct" in plans["links"] and "Exchange" not in plans["links"]
