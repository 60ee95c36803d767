"""Toxicity by a support vector machine over a gap-weighted subsequence kernel with Nystroem landmarks.

Strings are the words of sentences: lower case, letter-like digits and signs read as letters, other signs dropped, runs
of single letters joined, and each two short neighbours read as one word too, unless FAMILIAR clean training documents
have each of them.  The kernel counts common subsequences of two and three letters inside windows of SPAN letters (word
ends count as letters), each weighted by GAP to the power of what it spans, is normalised, and goes through a Gaussian.
  So "idiot", "id-iot", "i d i o t" and "idxiot" lie close together.

Learning, on at most TRAIN_A_CLASS labelled documents of each class (a documented bound):

1. a word of sentences of toxic documents is a seed if it is far more frequent there than in clean documents
   (likelihood ratio); sentences with a seed are positive, sentences of clean documents negative;
2. landmarks are the seeds, the strong ones with a letter inserted, their nearest clean words and common clean words;
   the kernel matrix of the landmarks gives the Nystroem features;
3. a linear squared-hinge machine is trained on the features of the sentences' words, negatives being words of clean
   sentences, among them those nearest to the seeds;
4. the decision value judges every word; a word is left out only where zero() proves that its value isn't above 0.
   Positive values are weighted by the likelihood ratio of the nearest seed, and a document's TOP largest are
   calibrated to a probability on the same documents.

Null texts count as empty and get the score of a document with no words; rows keep their number and ids.  With no
labelled rows of a class the score is the known class's frequency, or 0.5.  Equal texts get equal scores, an empty table
gives an empty result, and columns other than doc_id and text are not read.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.llm.common import CACHES, documents, held_out, only, slices
from parcelflow.llm.learning import labels, training

TRAIN_A_CLASS = 2000
GAP, SPAN, LENGTHS = 0.8, 4, (2, 3)
WIDTH = 0.35  # of the Gaussian, in squared distance of normalised kernel features
SEEDS, LANDMARKS = 96, 160
#: Seeds with at least this evidence have variants.
STRONG = 0.5
FAMILIAR = 3
PART = 6  # signs of neighbouring chunks that are read as one word too
ANY = "\0"  # is in no word, so it is as far from one letter as from another
FILL = "xqaeno"
TOP = 3  # words of a document that count
LIKELIHOOD, LEAST = 18.0, 3
COST = 10.0
NEGATIVES = 4000  # clean words near the seeds that are trained on
VARIANT = 1.0  # documents that the inserted-letter variants of a seed count for, as a share of its own
NEAREST = 96  # clean words nearest to the seeds with variants, as landmarks
LONGEST = 40  # letters of a word at once; longer ones are read in overlapping parts
BITS = 16
#: Distinct words whose values a worker keeps.
KEEP = 600_000

SENTENCE = re.compile(r"[.!?\n]+(?:\s|$)")
ALIKE = str.maketrans("013457@$|", "oieastasl")
SIGNS = re.compile(r"[\W\d_]+")


def letters(chunk: str) -> str:
    """What the kernel reads of a chunk between white space."""
    low = chunk.lower()
    if low.isalpha():
        return low
    core = low.strip(".,;:!?\"'()[]{}<>*#&%$|")
    if core.isalpha():
        return core
    if any(x.isalpha() for x in core):
        core = core.translate(ALIKE)
    return SIGNS.sub("", core)


def joined(chunks: list[str]) -> list[str]:
    """The words that runs of at least four single letters spell."""
    out, run = [], ""
    for c in chunks:
        x = c.strip(".,-_*")
        if len(x) == 1 and x.isalpha():
            run += x
        else:
            if len(run) >= 4:
                out.append(run)
            run = ""
    return [*out, run] if len(run) >= 4 else out


class Familiar(dict):
    """Whether a chunk is a word that FAMILIAR clean training documents have."""

    def __init__(self, words: frozenset[str] = frozenset()) -> None:
        super().__init__()
        self.words = words

    def __missing__(self, chunk: str) -> bool:
        if len(self) >= KEEP:
            self.clear()
        found = self[chunk] = letters(chunk) in self.words
        return found


def neighbours(chunks: list[str], familiar: Familiar) -> list[str]:
    """Each two neighbouring chunks of at most PART signs as one, if one is not familiar: words that white space splits."""
    return [a + b for a, b in zip(chunks, chunks[1:]) if len(a) <= PART and len(b) <= PART and len(a) + len(b) >= 4 and not (familiar[a] and familiar[b])]


def altered(word: str) -> tuple[list[str], list[str]]:
    """The word with one letter inserted, ANY for all letters; and with one or two of several letters, or one doubled."""
    spots = range(1, len(word))
    marks = [word[:i] + ANY + word[i:] for i in spots]
    said = [word[:i] + x + word[i:] for i in spots for x in (word[i - 1], *FILL)]
    said += [word[:i] + FILL[(i + j) % len(FILL)] + word[i:j] + FILL[(i + 2 * j + 1) % len(FILL)] + word[j:] for i in spots for j in range(i, len(word))]
    return marks, list(dict.fromkeys(said))


#: Offsets of subsequences inside a window that begin at its first letter.
SHAPES = [s for n in LENGTHS for s in ([(0, j) for j in range(1, SPAN)] if n == 2 else [(0, i, j) for i in range(1, SPAN - 1) for j in range(i + 1, SPAN)])]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed subsequences of all words: features, weights and the word that each is of."""
    text = "".join([f"^{w[:LONGEST]}$" for w in words])
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32) * np.uint32(0x9E3779B1)
    lengths = np.array([min(len(w), LONGEST) + 2 for w in words])
    owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    n = len(codes)
    features, weights, owners = [], [], []
    for shape in SHAPES:
        m = n - shape[-1]
        if m <= 0:
            continue
        same = np.flatnonzero(owner[:m] == owner[shape[-1] :])
        key = codes[same] + np.uint32(len(shape))
        for k in shape[1:]:
            key = (key ^ (key >> np.uint32(15))) * np.uint32(0x85EBCA6B) + codes[same + k]
        key = (key ^ (key >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        features.append((key >> np.uint32(32 - BITS)).astype(np.int32))
        weights.append(np.full(len(same), GAP ** (shape[-1] + 1) * (3.0 if len(shape) == 3 else 1.0), np.float32))
        owners.append(owner[same])
    return np.concatenate(features), np.concatenate(weights), np.concatenate(owners)


def merged(f: np.ndarray, w: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with equal subsequences of a word added up, by word."""
    key = o.astype(np.int64) << BITS | f
    order = np.argsort(key, kind="stable")
    key, w = key[order], w[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return (key[first] & ((1 << BITS) - 1)).astype(np.int32), np.add.reduceat(w, first), (key[first] >> BITS).astype(np.int32)


class Kernel:
    """Kernel values of words against fixed landmarks, by lists of the landmarks that have each subsequence."""

    def __init__(self, landmarks: list[str]) -> None:
        self.landmarks = landmarks
        f, w, o = merged(*subsequences(landmarks))
        norm = np.sqrt(np.bincount(o, w.astype(float) ** 2, len(landmarks)))
        order = np.argsort(f, kind="stable")
        self.many = np.bincount(f, minlength=1 << BITS)
        self.first = np.cumsum(self.many) - self.many
        self.owner, self.weight = o[order].astype(np.int64), (w / norm[o])[order]

    def totals(self, direction: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each subsequence: its largest weight in a landmark, and sums by directions above and below 0."""
        f = np.repeat(np.arange(1 << BITS), self.many)
        most = np.zeros(1 << BITS)
        np.maximum.at(most, f, self.weight)
        d = direction[self.owner].astype(float)
        return most, np.bincount(f, self.weight * np.maximum(d, 0), 1 << BITS), np.bincount(f, self.weight * np.maximum(-d, 0), 1 << BITS)

    def __call__(self, words: list[str]) -> np.ndarray:
        """Gaussian values; none is left out or estimated."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        for start in range(0, len(words), 1024):
            part = words[start : start + 1024]
            f, w, o = merged(*subsequences(part))
            norm = np.sqrt(np.bincount(o, w.astype(float) ** 2, len(part)))
            many = self.many[f]
            at = np.repeat(self.first[f] - np.cumsum(many) + many, many) + np.arange(many.sum())
            cell = np.repeat(o.astype(np.int64) * len(self.landmarks), many) + self.owner[at]
            out[start : start + len(part)] = np.bincount(cell, np.repeat(w / norm[o], many) * self.weight[at], len(part) * len(self.landmarks)).reshape(len(part), -1)
        return np.exp((np.minimum(out, 1) - 1) / WIDTH)


def solve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The linear machine with squared hinge loss, by Newton steps; the last column of x is the constant."""
    beta = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1]) / COST
    ridge[-1, -1] = 1e-6
    for _ in range(40):
        active = y * (x @ beta) < 1
        xa, wa = x[active], weight[active]
        new = np.linalg.solve(xa.T @ (xa * wa[:, None]) + ridge, xa.T @ (wa * y[active]))
        if np.allclose(new, beta, atol=1e-9):
            break
        beta = new
    return beta


class Machine:
    def __init__(self, texts: list[str], toxic: np.ndarray) -> None:
        self.constant: float | None = None
        self.values: dict[str, float] = {}
        self.joins: dict[str, float] = {}
        self.familiar = Familiar()
        seen, keep = set(), []
        for i, t in enumerate(texts):  # copies would count as evidence of their own
            if (key := (zlib.crc32(t.encode("utf-8", "replace")), len(t), int(toxic[i]))) not in seen:
                seen.add(key)
                keep.append(i)
        sentences = [[{w for c in s.split() if (w := letters(c))}.union(joined(s.split())) for s in SENTENCE.split(texts[i])] for i in keep]
        known = toxic[keep]
        self.constant = float((toxic.sum() + 1) / (len(toxic) + 2)) if len(toxic) else 0.5
        if len(np.unique(known)) < 2:
            return
        counts = [Counter(), Counter()]
        for doc, y in zip(sentences, known, strict=True):
            counts[int(y)].update({w for s in doc for w in s})
        self.familiar = Familiar(frozenset(w for w, n in counts[0].items() if n >= FAMILIAR))
        n = np.bincount(known.astype(int), minlength=2)
        strength = {w: g for w, a in counts[1].items() if a >= LEAST and (g := self.likelihood(a, counts[0][w], n[1], n[0])) >= LIKELIHOOD}
        seeds = [w for w, _ in sorted(strength.items(), key=lambda x: (-x[1], x[0]))][:SEEDS]
        if not seeds:
            return
        self.evidence = np.sqrt([strength[w] / strength[seeds[0]] for w in seeds])
        # letters inserted: variants of the seeds with most evidence are positive and landmarks too
        strong = {w: (e, *altered(w)) for w, e in zip(seeds, self.evidence, strict=True) if e >= STRONG}
        marks = {v: e for e, own, _ in strong.values() for v in own}
        variants = {v for _, _, own in strong.values() for v in own if v not in strength and v not in counts[0]}
        positive = [*strong, *marks, *(w for w in seeds if w not in strong)]
        self.evidence = np.r_[self.evidence[: len(strong)], list(marks.values()), self.evidence[len(strong) :]]
        # words of clean sentences that are near the seeds or variants, and common ones; joined neighbours count once
        first, ends = Kernel(positive), (len(positive), len(strong) + len(marks))
        tops: list[dict[str, float]] = [{}, {}]

        def offer(words: list[str]) -> None:
            for at in range(0, len(words), 4096):
                part = words[at : at + 4096]
                value = first(part)
                for top, end in zip(tops, ends, strict=True):
                    top.update(zip(part, value[:, :end].max(1, initial=0).tolist(), strict=True))
                    for w in sorted(top, key=lambda w: (-top[w], w))[NEGATIVES:]:
                        del top[w]

        offer(sorted(w for w in counts[0] if w not in strength))
        clean = [i for i in keep if not toxic[i]]
        for at in range(0, len(clean), 64):
            offer(sorted({w for i in clean[at : at + 64] for c in neighbours(texts[i].split(), self.familiar) if (w := letters(c)) and w not in strength}))
        hard, near = (sorted(top, key=lambda w: (-top[w], w)) for top in tops)
        common = [w for w, _ in sorted(counts[0].items(), key=lambda x: (-x[1], x[0])) if w not in strength]
        rest = LANDMARKS - len(seeds)
        self.kernel = Kernel(list(dict.fromkeys([*positive, *hard[: rest - 16], *near[:NEAREST], *common[:16]])))
        own = self.kernel(self.kernel.landmarks).astype(float)
        values, vectors = np.linalg.eigh((own + own.T) / 2)
        good = values > 1e-6 * values.max()
        self.map = vectors[:, good] / np.sqrt(values[good])
        # each word of a positive sentence that is like a seed, and each of a clean one, as often as it occurs
        words = list(dict.fromkeys([*sorted(strength), *hard, *near, *common[:1000], *sorted(variants)]))
        many = [np.array([counts[1][w] / n[1] if w in strength else VARIANT * len(strong) / len(variants) if w in variants else 0.0 for w in words]), np.array([(counts[0][w] or w not in strength and w not in variants) / n[0] for w in words])]
        x = np.c_[self.kernel(words) @ self.map, np.ones(len(words))]
        weight = np.r_[many[0], many[1]] / max(many[0].sum(), 1e-9) * 500
        self.beta = solve(np.r_[x, x], np.r_[np.ones(len(words)), -np.ones(len(words))], weight)
        self.direction, self.bias = (self.map @ self.beta[:-1]).astype(np.float32), float(self.beta[-1])
        self.most, self.up, self.down = self.kernel.totals(self.direction)
        self.calibration = self.calibrated(self.raw(texts), toxic)
        self.constant = None

    @staticmethod
    def likelihood(a: int, b: int, na: int, nb: int) -> float:
        """Twice the log likelihood ratio of a word's document counts, 0 if it is not more frequent in toxic ones."""
        if a * nb <= 4 * b * na:
            return 0.0
        p, total = (a + b) / (na + nb), 0.0
        for k, n in ((a, na), (b, nb)):
            for got, all_, rate in ((k, n, p), (n - k, n, 1 - p)):
                if got:
                    total += 2 * got * math.log(got / all_ / rate)
        return total

    @staticmethod
    def calibrated(raw: np.ndarray, toxic: np.ndarray) -> np.ndarray:
        """Logistic regression of the label on the decision values, each class with the same weight."""
        x = np.c_[raw, np.ones(len(raw))]
        w = np.where(toxic == 1, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (1 - toxic).sum()))
        used = np.ones(x.shape[1], bool)
        while True:  # more evidence must never lower a score
            beta = np.zeros(x.shape[1])
            for _ in range(100):
                p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
                y = x * used
                step = np.linalg.solve(y.T @ (y * (w * p * (1 - p))[:, None]) + 1e-4 * np.eye(len(beta)), y.T @ (w * (toxic - p)) - 1e-4 * beta)
                beta = beta + np.clip(step, -2, 2)
                if np.abs(step).max() < 1e-9:
                    break
            if (beta[:-1] >= 0).all():
                return beta
            used[:-1] &= beta[:-1] > 0

    def zero(self, words: list[str]) -> np.ndarray:
        """Which words have a decision value that is proved not to be above 0.

        The Gaussian is convex, so between 0 and the largest kernel value it lies below the chord, which bounds the
        landmarks that speak for a word, and above the tangent at 0, which bounds those against it.
        """
        f, w, o = subsequences(words)
        add = lambda x: np.bincount(o, w * x, len(words))
        norm = np.sqrt(add(w))  # smaller than that of merged weights
        least = np.exp(-1 / WIDTH)
        most = np.clip(add(self.most[f]) / norm, 1e-6, 1)
        chord = (np.exp((most - 1) / WIDTH) - least) / most
        rise = chord * add(self.up[f]) - least / WIDTH * add(self.down[f])
        return self.bias + least * self.direction.sum(dtype=float) + np.maximum(rise, 0) / norm < -1e-3

    def decided(self, words: list[str]) -> np.ndarray:
        """Decision values above 0, weighted by the evidence of the nearest seed or variant."""
        out = np.zeros(len(words))
        open_ = np.flatnonzero(~self.zero(words))
        if len(open_):
            out[open_] = self.valued([words[i] for i in open_])
        return out

    def valued(self, words: list[str]) -> np.ndarray:
        value = self.kernel(words)
        got = np.clip(np.einsum("ij,j->i", value, self.direction) + self.bias, 0, 1)  # by one thread
        some = np.flatnonzero(got)
        got[some] *= self.evidence[value[some, : len(self.evidence)].argmax(1)]
        return got

    def learn(self, chunks: set[str], values: dict[str, float]) -> None:
        if len(values) > KEEP:
            values.clear()
        new = sorted(chunks.difference(values))
        words: dict[str, list[int]] = {}
        for i, c in enumerate(new):
            w = letters(c)
            for at in range(0, max(1, len(w)), LONGEST // 2):
                words.setdefault(w[at : at + LONGEST], []).append(i)
                if at + LONGEST >= len(w):
                    break
        distinct = list(words)
        out = np.zeros(len(new), np.float32)
        for start in range(0, len(distinct), 4096):
            part = distinct[start : start + 4096]
            got = self.decided(part)
            for k in np.flatnonzero(got):
                for i in words[part[k]]:
                    out[i] = max(out[i], got[k])
        values.update(zip(new, out.tolist(), strict=True))

    def raw(self, texts: list[str]) -> np.ndarray:
        """The TOP largest values of the words of each text: positive decision values, by the nearest seed's evidence."""
        split = [t.split() for t in texts]
        pairs = [neighbours(chunks, self.familiar) for chunks in split]
        for k, chunks in enumerate(split):
            short = np.fromiter(map(len, chunks), np.int32, len(chunks)) <= 2
            if len(short) >= 4 and (short[:-3] & short[1:-2] & short[2:-1] & short[3:]).any():
                split[k] = chunks + joined(chunks)
        self.learn({c for chunks in split for c in chunks}, self.values)
        self.learn({c for chunks in pairs for c in chunks}, self.joins)
        out = np.zeros((len(texts), TOP))
        for k, (chunks, two) in enumerate(zip(split, pairs, strict=True)):
            best = heapq.nlargest(TOP, [*map(self.values.__getitem__, chunks), *map(self.joins.__getitem__, two)])
            out[k, : len(best)] = best
        return out

    def forget(self) -> None:
        for known in (self.values, self.joins, self.familiar):
            known.clear()

    def score(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(np.c_[self.raw(texts), np.ones(len(texts))] @ self.calibration, -500, 500)))


def fit(docs: DataFrame, marks: DataFrame, column: str = "toxic", rows_a_class: int = TRAIN_A_CLASS) -> Machine:
    rows = training(docs, marks, column, rows_a_class).select("text", "label").collect()  # bounded: 2 * rows_a_class
    model = Machine([r["text"] for r in rows], np.array([r["label"] for r in rows], dtype=int))
    model.values, model.joins, model.familiar = {}, {}, Familiar(model.familiar.words)
    return model


def score(docs: DataFrame, model: Machine) -> DataFrame:
    """doc_id and score of every row."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        CACHES["toxicity"] = model.forget
        only("toxicity")
        for batch in batches:
            for part in slices(batch):
                got = model.score([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(got, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, score double")


def op2_toxicity_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score(docs, fit(docs, labels(spark, sf_dir)))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
