"""What must hold at any size, without Spark where it can be: bytes sent, run times, exact reductions, kernel values."""

import os
import random
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from parcelflow.llm import graph, jaccard, learning, packing, quality, secrets, suffix, toxicity

DATA = Path(os.environ.get("PARCELFLOW_TESTDATA", "/root/testdata"))


def prose(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(3000)]
    return [" ".join(rng.choices(words, k=rng.randint(20, 200))) for _ in range(n)]


def sent(batch):
    return sum(len(x) for c, f in zip(batch.columns, batch.schema, strict=True) if str(f.type) == "binary" for x in c.to_pylist())


def test_a_slice_sends_the_same_bytes_to_any_number_of_buckets():
    texts = prose(1, 60)
    none = np.zeros(0, np.uint64)
    assert len({sent(jaccard.met(texts, jaccard.Bands(Fraction(4, 5)), 5, n, none)[0]) for n in (10, 500, 10_000)}) == 1
    rows = [(i, t.encode()) for i, t in enumerate(texts)]
    assert len({sent(suffix.asked(rows, n, 7)[0]) for n in (10, 500, 10_000)}) == 1


def test_what_all_texts_of_a_slice_have_asks_twice():
    passage = prose(2, 1)[0]
    rows = [(i, f"{t} {passage}".encode()) for i, t in enumerate(prose(3, 80))]
    ask, answers = suffix.asked(rows, 1, 1)
    names = np.frombuffer(ask.column("hash")[0].as_py(), np.uint32)
    assert Counter(names.tolist()).most_common(1)[0][1] == 2 and answers.num_rows == 1


def test_words_with_equal_polynomials_differ():
    def thue(n, flip):
        return "".join("ab"[(i.bit_count() + flip) % 2] for i in range(n))

    a, b = (jaccard.shingles(f"one two {thue(4096, k)} four five six".encode(), 4) for k in (0, 1))
    assert len(np.intersect1d(a, b)) < len(a)


def test_long_texts_are_cut_between_words(monkeypatch):
    text = " ".join(prose(4, 30)).encode() + b" \x1c\xc2\xa0x\tY"
    whole = jaccard.shingles(text, 5)
    monkeypatch.setattr(jaccard, "PIECE", 64)
    assert (jaccard.shingles(text, 5) == whole).all()


@pytest.mark.parametrize("sign", "/._=~+-")
def test_runs_of_separators_take_no_time(sign):
    model = secrets.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    began = time.perf_counter()
    for text in (f"Section{sign * 10_000}123456", f"a{sign * 10_000}", f"a{sign}" * 5000 + "123456", f"ab12{sign * 9999}zz"):
        secrets.spans(text, model)
    assert time.perf_counter() - began < 1


def fewest(items, size):
    """The least number of sequences, by depth-first search."""
    items = sorted(items, reverse=True)

    def place(k, rooms):
        if k == len(items):
            return True
        for r in set(rooms):
            if r >= items[k]:
                i = rooms.index(r)
                if place(k + 1, [*rooms[:i], r - items[k], *rooms[i + 1 :]]):
                    return True
        return False

    n = -(-sum(items) // size)
    while not place(0, [size] * n):
        n += 1
    return n


def reduced(items, size):
    """The reduction alone: sequences that it fixes, and the lengths that it leaves."""
    plan = packing.Plan.__new__(packing.Plan)
    plan.size, plan.sequences, plan.free, plan.taken, plan.runs = size, 0, dict(Counter(items)), defaultdict(int), []
    plan.reduce()
    return plan.sequences, list(Counter(plan.free).elements())


def test_fixed_sets_always_leave_an_optimum():
    fixed, rest = reduced([29, 27, 18, 14, 12, 8, 7], 58)  # {29, 27} does not dominate {29, 14, 8, 7}
    assert fixed + fewest(rest, 58) == 2
    rng = random.Random(4)
    several = 0
    for _ in range(20_000):
        size = rng.randint(10, 60)
        items = [rng.randint(1, size) for _ in range(rng.randint(1, 9))]
        fixed, rest = reduced(items, size)
        several += fixed
        assert fixed + fewest(rest, size) == fewest(items, size), (size, items)
    assert several > 20_000


def test_discriminant_is_the_difference_of_log_densities():
    rng = np.random.default_rng(3)
    y = (rng.random(400) < 0.7).astype(int)
    x = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 4)) + y[:, None] * [1, 0, -1, 0.5]
    z = (x - x.mean(0)) / (x.std(0) + 1e-6)
    within = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum((y == k).sum() * within[k] for k in (0, 1)) / len(y)
    log = []
    for k in (0, 1):
        c = (1 - quality.POOL) * within[k] + quality.POOL * pooled
        c = (1 - quality.ROUND) * c + quality.ROUND * np.trace(c) / 4 * np.eye(4)
        d = z - z[y == k].mean(0)
        log.append(np.log((y == k).mean()) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    assert np.allclose(quality.Discriminant(x, y).score(x), 1 / (1 + np.exp(log[0] - log[1])))


def test_kernel_counts_gapped_subsequences():
    def brute(a, b):
        def features(word):
            text, out = f"^{word}$", Counter()
            for i in range(len(text)):
                for j in range(i + 1, min(i + toxicity.SPAN, len(text))):
                    out[text[i], text[j]] += toxicity.GAP ** (j - i + 1)
                    for k in range(j + 1, min(i + toxicity.SPAN, len(text))):
                        out[text[i], text[j], text[k]] += 3 * toxicity.GAP ** (k - i + 1)
            return out

        x, y = features(a), features(b)
        dot = lambda p, q: sum(v * q[k] for k, v in p.items())
        return np.exp((dot(x, y) / np.sqrt(dot(x, x) * dot(y, y)) - 1) / toxicity.WIDTH)

    words = ["idiot", "idxiot", "idoit", "stupid", "banana", "iddiiot", "a"]
    got = toxicity.Kernel(words)(words)
    assert np.allclose(got, [[brute(a, b) for b in words] for a in words], atol=0.01)  # features are folded into BITS bits


def test_toxicity_recall_precision_and_inserted_letters():
    folder = DATA / "sf0.1"
    if not folder.exists():
        pytest.skip("no test data")
    docs, marks = (pq.read_table(folder / f"{n}.parquet").to_pandas() for n in ("documents", "labels"))
    rows = docs.merge(marks, on="doc_id")
    rows["text"] = rows.text.fillna("")
    held = np.array([zlib.crc32(str(d).encode()) % 5 == 0 for d in rows.doc_id])
    train, test = rows[~held], rows[held]
    model = toxicity.Machine(train.text.tolist(), train.toxic.to_numpy(dtype=int))
    said, true = model.score(test.text.tolist()) >= 0.5, test.toxic.to_numpy() == 1
    assert (said & true).sum() >= 0.9 * true.sum() and (said & true).sum() >= 0.9 * said.sum()
    insults = "trash pathetic idiot disgusting worthless stupid clown loser scum moron".split()  # for the test only
    clean, rng = test.text[~true].tolist()[:300], random.Random(5)
    for i, text in enumerate(clean):
        w, at = insults[i % 10], rng.randrange(1, len(insults[i % 10]))
        clean[i] = f"{text} {w[:at]}{rng.choice('abcdefghijklmnopqrstuvwxyz')}{w[at:]}"
    assert (model.score(clean) >= 0.5).mean() >= 0.9


def test_components_of_hubs_and_chains(spark, monkeypatch):
    monkeypatch.setattr(graph, "TOGETHER", 64)
    rng = random.Random(8)
    edges = [(7, k) for k in range(100, 700)] + [(k, k + 1) for k in range(1000, 1060)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for u, v in edges if u != v for x in (u, v)}
    got = [tuple(r) for r in graph.components(spark.createDataFrame(edges, "u long, v long").repartition(6)).collect()]
    assert len(got) == len(want) and dict(got) == want


def test_pipeline_on_awkward_rows(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("awkward"))
    long = " ".join(prose(9, 3))
    rows = [(1, long, "a"), (2, None, "b"), (None, None, "c"), (None, long, None), (3, "", "d"), (4, long, "e"), (4, long, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumn("kept", learning.F.lit(1))
    for name, part in (("some", docs), ("none", docs.filter("false"))):
        part.write.parquet(f"{folder}/{name}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/{name}/labels.parquet")
    frame = spark.read.parquet(f"{folder}/some/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, f"{folder}/some")
        assert frame.columns == docs.columns, name
    found = corpus_pipeline.run(spark, f"{folder}/some").collect()
    assert Counter(r.doc_id for r in found) >= Counter([1, 2, 3]) and sum(r.doc_id == 4 for r in found) == 0
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0
