"""What a worker or the driver holds doesn't grow with all vectors."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from parcelflow.llm import bpe, embeddings, jaccard, negatives
from pyspark.sql import functions as F


def test_visitors_of_a_part_are_not_held():
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(30, 4)), 10, axis=0) + 0.05 * rng.normal(size=(300, 4))
    x /= np.sqrt((x * x).sum(1))[:, None]
    rows = lambda a, b: (np.arange(a, b), np.ones(b - a, np.int64), np.full(b - a, 4), x[a:b])
    part = embeddings.Part(0.9)
    part.add(*rows(0, 40))
    part.add(*rows(40, 60))
    assert part.some()
    visits = [part.visited(*rows(k, k + 80)).to_pydict() for k in range(60, 300, 80)]
    own = part.done().to_pydict()
    assert len(part.node) == len(part.x) == 60 and not part.held  # the part's own vectors only
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    near[60:, 60:] = False
    found = {n: k for d in (own, *visits) for n, k in zip(d["node"], d["links"], strict=True) if k}
    assert found == {n: int(k) for n, k in enumerate(near.sum(1)) if k}
    label = np.arange(300)
    for _ in range(300):
        for a, b in ((n, r) for d in (own, *visits) for n, r in zip(d["node"], d["root"], strict=True)):
            label[[a, b]] = min(label[a], label[b])
    want = np.arange(300)
    for _ in range(300):
        want = np.array([min(want[k], *want[near[k]]) if near[k].any() else want[k] for k in range(300)])
    assert [label[a] == label[b] for a, b in np.argwhere(near)] == [True] * int(near.sum()) and len(set(label)) == len(set(want))


def test_vectors_of_a_search_are_not_broadcast(spark):
    rows = [(i, i % 3, [float(i % 7), 1.0, -float(i % 5)]) for i in range(200)]
    v = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    found = negatives.mined(v.select("vec_id", "label", negatives.integers(F.col("embedding")).alias("q")), F.col("vec_id") % 50 == 0)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_worker_keeps_so_many_words_whatever_it_has_seen(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [" ".join(f"common w{k}x{j}," for j in range(200)) for k in range(60)]
    whole = bpe.WordBpe(path).encode_batch(texts)
    monkeypatch.setattr(bpe, "KEEP", 1000)
    model = bpe.WordBpe(path)
    for k, text in enumerate(texts):
        assert model.encode_batch([text]) == [whole[k]]
        assert all(len(c.now) + len(c.before) <= 2 * (1000 + 400) for c in (model.chunks, model.known))
        assert "common" in model.chunks.now  # what is met again stays


def test_words_are_hashed_together_and_none_is_kept():
    rng = random.Random(1)
    texts = [b"", b" ", b"x" * 300 + b" y", b"abcdefgh abcdefg\0 abcdefgh\0 ABCDEFGHI abcdefghi", *(bytes(rng.choices(b"abAB \t\n\0\xff", k=rng.randint(0, 60))) for _ in range(500))]
    seen = {}
    for t in texts:
        words, found = t.lower().split(), jaccard.word_hashes(t).tolist()
        assert len(words) == len(found) and all(seen.setdefault(h, w) == w for h, w in zip(found, words, strict=True))
    assert len(set(seen.values())) == len(seen) and not hasattr(jaccard, "_words")


def test_packing_takes_the_librarys_ids_without_the_tries_tables():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Über naïve ΣΑΣ's, don't 12345 <|endoftext|>x<|startoftext|> ", "", "\x1c \x85  tab\tand\x1fmore 日本語 é é 🙂🙂", "x" * 3000 + " " + "ab.cd," * 900, "<| |> &lt; \x00 �"]
    model = bpe.load(path, bpe.LibraryBpe)
    assert not hasattr(model, "starts")
    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()
    assert model.encode_batch(texts) == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
