"""Documents whose sets of word n-grams have a Jaccard similarity of at least a bound, joined by signature trees.

1. Equal sets are one class (128-bit digests).
2. Candidates: the n-grams' hashes are cut into K ranges, K more than the sizes' greatest possible difference, so two
   similar sets agree on the whole content of some range.  Sets meet that agree on one; K depends on the larger set's
   size band, and a set takes part in its own band and the next.  Sets with more empty ranges than a band's allowance
   also meet by their first hashes, in an order that puts frequent n-grams last.  So no similar pair is missed, and sets that merely share a passage hardly meet.
   Sets that meet in a band, directly or through others, form a cluster of that band.
   A signature takes the same bytes whatever the number of buckets, and of the sets that share one where they are read
   only one sends it on.
   N-grams that a share of FREQUENT of all documents have count in neither way as long as others are left, so documents
   with a common passage don't meet by it; the share bounds their number, and whatever they are, no pair is missed.
3. Join: a cluster's sets go into a signature tree.  Leaves hold up to LEAF sets, nodes up to FAN children; each has the
   OR and the AND of its sets' token bitmaps and the range of their sizes.  Two nodes are traversed together unless all
   their sets are linked already, or the greatest overlap that bitmaps and sizes allow is below what similarity needs.
   The join runs twice.  First the trees have bitmaps only, less than a byte for each n-gram: sets that bitmaps and sizes
   let be similar, directly or through others, stay together, and all similar sets do.  Then the n-grams of those that are
   not left alone travel, and pairs at the leaves are counted exactly.
4. Links make components.  Links between sets that are connected already are not looked for, so a group of thousands of
   copies costs about as many comparisons as it has sets.

Clusters above LARGE n-grams are joined in blocks, all with the same few PIVOTS; what remains unconnected in such a cluster
is then joined block by block against its largest component.

A null text, or one without words, has no n-grams and is linked with nothing.  Shorter texts have one n-gram, of all
their words.  Rows keep their number and ids; repeated rows are in one class; rows without an id are classed too but are
never a component's id; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelflow.llm.common import documents, fresh, materialise, only, slices
from parcelflow.llm.graph import beside, components, stars
from parcelflow.llm.suffix import BASE, blobs, utf8

WORDS, SIMILARITY = 5, Fraction(4, 5)
LEAF, FAN = 16, 8
#: Bits of a bitmap for each n-gram of a middling set, and the least and most bits; fewer would let pairs through that differ.
BITS_EACH, BITS = 8, (1024, 1 << 16)
#: Bits for each n-gram, at least, of the bitmaps that are sent alone.
SKETCH_BITS = 4
#: N-grams of all sets of a cluster from which it is joined in blocks, of a task of small clusters, of a bucket's sets.
LARGE, TASK, BUCKET = 8 << 20, 1 << 20, 1 << 20
#: So many times LARGE and TASK where bitmaps are sent alone.
SKETCHED = 8
#: Rows whose signatures are sent together, and buckets that a task has one after the other.
SENT, STREAM = 2048, 4
PIVOTS = 8
#: Rows of a counted plan or list of ids that texts are joined with where they lie, instead of being sent to it.
CARRIED = 200_000
#: Stands for a null doc_id: rows without an id link like others, and their groups have an id only from other rows.
NO_ID = (1 << 63) - 1
#: N-grams of so large a share of the documents come last in the order; how many are told to the tasks at most; how
#: often one must occur among the documents that are read together to be counted.
FREQUENT, MOST_FREQUENT, SEVERAL = 0.003, 200_000, 3

#: Bytes of a text whose words are made at once, and of a word that is not hashed by itself.
PIECE, LONG = 1 << 20, 256
BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of words, and masks of so many first bytes.
LETTER = np.array([not BLANK.match(bytes([x])) for x in range(256)])
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: Bits of a signature's hash that travel; those before them follow from the bucket, but for a few.
LOW = 40


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hashed(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a text in lower case, by eight bytes of all of them at once, and where they start.

    Words of eight bytes at most don't collide.
    """
    padded = text + bytes(8)
    word = np.zeros(len(text) + 2, bool)
    word[1:-1] = LETTER[np.frombuffer(text, np.uint8)]
    edges = np.flatnonzero(word[1:] != word[:-1])
    start, size = edges[::2], edges[1::2] - edges[::2]
    window = np.ndarray((len(text) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each place on
    h = mix(window[start] & FIRST[np.minimum(size, 8)] ^ mix(size.astype(np.uint64)))
    for k in range(8, LONG, 8):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        h[more] = mix(h[more] * np.uint64(BASE) + (window[start[more] + k] & FIRST[np.minimum(size[more] - k, 8)]))
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(text[start[i] : start[i] + size[i]])
    return h, start


def words_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's words in lower case and where they start, made of so many bytes at once; bytes know A-Z and the six blanks only."""
    out, at = [], 0
    while at < len(text):
        cut = BLANK.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = cut.start() if cut else len(text)
        h, start = hashed(text[at:end].lower())
        out.append((h, start + at))
        at = end
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return out[0] if len(out) == 1 else tuple(np.concatenate(c) for c in zip(*out, strict=True))


def word_hashes(text: bytes) -> np.ndarray:
    return words_of(text)[0]


def sets_of(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of the word n-grams of each text, one text after the other, and where each text's begin.

    All texts are worked on at once: most are short, and calls for each would cost more than the work in them.
    """
    w, start = words_of(b" ".join(texts))
    edge = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    count = np.diff(edge)
    # a weight for each place, as powers of one number have texts that collide
    weight = mix(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    size = mix(np.arange(words + 1, dtype=np.uint64) ^ np.uint64(BASE))
    h = np.zeros(len(w), np.uint64)
    n = max(0, len(w) - words + 1)
    for k in range(words):
        h[:n] += w[k : k + n] * weight[k]
    h = mix(h ^ size[words])
    there = np.arange(len(w)) <= np.repeat(edge[1:] - words, count)
    for i in np.flatnonzero((count > 0) & (count < words)).tolist():  # all words of a short text are one
        own, at = int(count[i]), int(edge[i])
        h[at : at + 1] = mix((w[at : at + own] * weight[:own]).sum(keepdims=True) ^ size[own])
        there[at] = True
    h = h[there]
    first = np.r_[0, np.cumsum(there)][edge]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        h[a:b].sort()
    kept = np.r_[True, h[1:] != h[:-1]][: len(h)]
    kept[first[:-1][np.diff(first) > 0]] = True
    return h[kept], np.r_[0, np.cumsum(kept)][first]


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams."""
    return sets_of([text], words)[0]


def groups(texts: list[str | None]) -> Iterator[list[bytes]]:
    """The texts in UTF-8, so many together that they have PIECE bytes or are one."""
    held, size = [], 0
    for t in map(utf8, texts):
        if held and size + len(t) > PIECE:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def all_shingles(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The sets of some texts."""
    out = []
    for some in groups(texts):
        h, first = sets_of(some, words)
        out += [h[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    return out


def digest(h: np.ndarray) -> tuple[int, int]:
    d = hashlib.md5(h.tobytes()).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def bitmap(h: np.ndarray, width: int) -> np.ndarray:
    """The token bitmap of a set, as 64-bit words."""
    row = np.zeros(width, bool)
    row[(h & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(row).view(np.uint64)


def sketch(h: np.ndarray) -> bytes:
    """Size, least hash and bitmap of a set; the greater the set, the wider the bitmap."""
    width = min(max(1 << (SKETCH_BITS * len(h)).bit_length(), 64), BITS[1])
    return np.r_[np.array([len(h), h[0] if len(h) else 0], np.uint64), bitmap(h, width)].tobytes()


class Bands:
    """Size bands of a similarity: similar sets are in one band or in neighbours."""

    def __init__(self, similarity: Fraction) -> None:
        self.t = similarity
        self.low = [1]

    def band(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(math.floor(self.low[-1] / self.t) + 1)
        return int(np.searchsorted(self.low, n, "right")) - 1

    def ranges(self, band: int) -> tuple[int, int]:
        """Ranges and the empty ones allowed; 0 ranges where only equal sets are similar."""
        self.band(self.low[band] if band < len(self.low) else 1)
        while len(self.low) <= band + 1:
            self.low.append(math.floor(self.low[-1] / self.t) + 1)
        most = self.low[band + 1] - 1
        differ = math.floor((1 - self.t) * 2 * most / (1 + self.t))
        if not differ:
            return 0, 0
        k = differ + 1
        allowed = 2 + math.ceil(1.3 * k * math.exp(-self.low[band] / k))
        return k + allowed, allowed

    def signatures(self, h: np.ndarray, frequent: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """What a set meets others by, for each of its bands."""
        own = self.band(len(h))
        return [(own + which, found) for which, _, found in self.signed(h, np.array([0, len(h)]), frequent) if self.ranges(own + which)[0]]

    def signed(self, h: np.ndarray, first: np.ndarray, frequent: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """What sets, given as by sets_of(), meet others by: in its own band (0) or the next (1), the set's number and the signature."""
        n = np.diff(first)
        self.band(int(n.max(initial=1)))
        own = np.searchsorted(self.low, n, "right") - 1
        late = np.zeros(len(h), bool)
        if len(frequent):
            at = np.searchsorted(frequent, h)
            late = frequent[np.minimum(at, len(frequent) - 1)] == h
        cold, edge = h[~late], np.r_[0, np.cumsum(~late)][first]
        mixed, count = mix(cold ^ np.uint64(0xA5A5A5A5A5A5A5A5)), np.diff(edge)
        of = np.repeat(np.arange(len(n)), count)
        begins = edge[:-1][count > 0]
        for which in (0, 1):
            band = own + which
            known = {int(b): self.ranges(int(b)) for b in np.unique(band)}
            k, allowed = (np.array([known[b][i] for b in band.tolist()], dtype=np.int64) for i in (0, 1))
            part = (cold >> np.uint64(32)) * k.astype(np.uint64)[of] >> np.uint64(32)
            new = np.r_[True, part[1:] != part[:-1]][: len(part)]
            new[begins] = True
            start = np.flatnonzero(new)
            doc = of[start]
            salt = band.astype(np.uint64) << np.uint64(32)
            found = mix(np.add.reduceat(mixed, start) + mix(part[start] + salt[doc])) if len(start) else np.zeros(0, np.uint64)
            more = [(doc, found)]
            for d in np.flatnonzero((k > 0) & (k - np.bincount(doc, minlength=len(n)) > allowed)).tolist():
                whole, last = h[first[d] : first[d + 1]], late[first[d] : first[d + 1]]
                prefix = len(whole) - math.ceil(self.t * len(whole)) + 1
                other = mix(np.r_[whole[~last], whole[last]][:prefix] + (salt[d] + np.uint64(1)))
                more.append((np.full(len(other), d), other))
            doc, found = (np.concatenate(c) for c in zip(*more, strict=True))
            there = k[doc] > 0  # where there are no ranges, only equal sets are similar
            yield which, doc[there], found[there]


def classify(docs: DataFrame, words: int, similarity: Fraction) -> DataFrame:
    """doc_id, n_shingles, the size band, the digest h1, h2 and the sketch of every row's set.

    Rows without a band are n-grams (h1) that several of the documents read together have, with their number.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(similarity)
        names = ["doc_id", "n_shingles", "band", "h1", "h2", "sketch"]
        for batch in batches:
            for part in slices(batch):
                sets = all_shingles(part.column("text").to_pylist(), words)
                h = np.array([digest(s) for s in sets], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([bands.band(max(1, len(s))) for s in sets], pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array([sketch(s) for s in sets], pa.binary())], names)
                grams, n = np.unique(np.concatenate([s for s in sets if len(s)] or [np.zeros(0, np.uint64)]), return_counts=True)
                many = n >= max(SEVERAL, FREQUENT * len(sets))
                none = pa.nulls(int(many.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.array(n[many].astype(np.int64)), none, pa.array(grams[many].view(np.int64)), none, pa.nulls(len(none), pa.binary())], names)

    return docs.mapInArrow(work, "doc_id long, n_shingles long, band long, h1 long, h2 long, sketch binary")


def place(first: np.ndarray, which: int) -> np.ndarray:
    """The places of sets in their own bands or the next, from the first halves of their digests; what shares one meets too."""
    return first & ~1 | which


def met(texts: list[str | None], bands: Bands, words: int, buckets: int, frequent: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
    """What the sets of some texts send to each bucket, and the pairs of places that meet among them.

    Of the places that share a signature one goes out for all; a signature takes the same bytes for any number of
    buckets: LOW bits of its hash and its place.
    """
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    seen = set()
    for some in groups(texts):
        h, first = sets_of(some, words)
        keys = [digest(h[a:b])[0] if a < b else None for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        own = np.array([not (k is None or k in seen or seen.add(k)) for k in keys])  # equal sets once
        n = np.diff(first)
        h, first = h[np.repeat(own, n)], np.r_[0, np.cumsum(n[own])]
        key = np.array([k for k, o in zip(keys, own, strict=True) if o], dtype=np.int64)
        for which, doc, found in bands.signed(h, first, frequent) if len(key) else ():
            hashes.append(found)
            places.append(place(key[doc], which))
    h, p = np.concatenate(hashes), np.concatenate(places)
    order = np.argsort(h)  # any of the places that share a hash may stand for them
    h, p = h[order], p[order]
    pairs, first = meeting(h, p)
    h, p = h[first], p[first]
    bucket = (h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)  # as h is sorted, so are these
    return blobs(bucket, "bucket", {"low": h.astype(np.uint32), "high": (h >> np.uint64(32)).astype(np.uint8), "place": p}), pairs


def meeting(h: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (u, v) that share a hash, as stars, and where each of the sorted hashes begins."""
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, int)
    pivot = np.repeat(p[first], np.diff(np.r_[first, len(h)]))
    other = pivot != p
    return np.stack(stars(p[other], pivot[other])), first


def meetings(docs: DataFrame, words: int, similarity: Fraction, buckets: int, frequent: np.ndarray) -> DataFrame:
    """Pairs of places (u, v) that connect all places with a common signature."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("jaccard")
        bands = Bands(similarity)
        for batch in batches:
            for part in slices(batch, rows=SENT):
                out, pairs = met(part.column("text").to_pylist(), bands, words, buckets, frequent)
                names = [*out.schema.names, "pairs"]
                if out.num_rows:
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.nulls(out.num_rows, pa.binary())], names)
                if pairs.shape[1]:
                    to = int(pairs[0, 0]) % buckets  # pairs that are found go along with any bucket
                    yield pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), *(pa.nulls(1, pa.binary()) for _ in range(3)), pa.array([pairs.tobytes()], pa.binary())], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("jaccard")
        bucket, held = None, []
        for batch in batches:
            for k, *sent, pairs in zip(*(batch.column(c) for c in ("bucket", "low", "high", "place", "pairs")), strict=True):
                if pairs.is_valid:
                    yield edges(np.frombuffer(pairs.as_py(), np.int64).reshape(2, -1))
                else:
                    if k.as_py() != bucket:
                        yield from one(held)
                        bucket, held = k.as_py(), []
                    held.append([np.frombuffer(x.as_py(), kind) for x, kind in zip(sent, (np.uint32, np.uint8, np.int64), strict=True)])
        yield from one(held)

    def one(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if held:
            low, high, p = (np.concatenate(c) for c in zip(*held, strict=True))
            h = low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)
            order = np.argsort(h)
            yield edges(meeting(h[order], p[order])[0])

    def edges(pairs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])

    sent = docs.mapInArrow(send, "bucket int, low binary, high binary, place binary, pairs binary")
    return sent.repartition(max(1, buckets // STREAM), "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "u long, v long")


class SignatureTree:
    """Nodes over sets: OR and AND of bitmaps, sizes from and to, children or leaf members, and a component if shared.

    The sets are either given whole, as sorted hashes, or as what sketch() makes of them; then all pairs that bitmaps and
    sizes let be similar count as links.
    """

    def __init__(self, sets: list[np.ndarray], sketches: bool = False) -> None:
        self.sets = None if sketches else sets
        if sketches:
            self.sizes, least = np.array([int(s[0]) for s in sets]), np.array([s[1] for s in sets], dtype=np.uint64)
            words = min(len(s) - 2 for s in sets)
            # a bitmap of half the width is the OR of its halves, as widths are powers of two
            self.bits = np.stack([np.bitwise_or.reduce(s[2:].reshape(-1, words)) for s in sets])
        else:
            self.sizes, least = np.array([len(s) for s in sets]), np.array([s[0] if len(s) else 0 for s in sets], dtype=np.uint64)
            width = min(max(1 << int(BITS_EACH * float(np.median(self.sizes))).bit_length(), BITS[0]), BITS[1])
            self.bits = np.stack([bitmap(s, width) for s in sets])
        order = np.lexsort((self.sizes, least))
        level = [self.node([], order[k : k + LEAF]) for k in range(0, len(order), LEAF)]
        while len(level) > 1:
            level = [self.node(level[k : k + FAN], None) for k in range(0, len(level), FAN)]
        self.root = level[0]

    def node(self, children: list, members) -> dict:  # noqa: ANN001
        if children:
            own = {"some": np.bitwise_or.reduce([c["some"] for c in children]), "all": np.bitwise_and.reduce([c["all"] for c in children]), "low": min(c["low"] for c in children), "high": max(c["high"] for c in children)}
            members = np.concatenate([c["members"] for c in children])
        else:
            b, s = self.bits[members], self.sizes[members]
            own = {"some": np.bitwise_or.reduce(b), "all": np.bitwise_and.reduce(b), "low": int(s.min()), "high": int(s.max())}
        return own | {"children": children, "members": members}

    def links(self, similarity: Fraction, groups: np.ndarray | None = None, across: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Links that connect all similar sets, but for those of one group; across: only between sets that differ there."""
        num, den = similarity.numerator, similarity.denominator
        parent = list(range(len(self.sizes)))
        if groups is not None:
            seen: dict[int, int] = {}
            parent = [seen.setdefault(g, k) for k, g in enumerate(groups.tolist())]
        out: list[tuple[int, int]] = []

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def one(node: dict) -> int:
            """The component that all sets of a node are in, or -1."""
            if (known := node.get("one")) is not None:
                return find(known)
            roots = {find(x) for x in node["members"].tolist()}
            if len(roots) > 1:
                return -1
            node["one"] = next(iter(roots))
            return node["one"]

        def close(x: dict, y: dict) -> bool:
            most = min(x["high"] - int(np.bitwise_count(x["all"] & ~y["some"]).sum()), y["high"] - int(np.bitwise_count(y["all"] & ~x["some"]).sum()))
            return most * (num + den) >= num * (x["low"] + y["low"]) and x["high"] * den >= num * y["low"] and y["high"] * den >= num * x["low"]

        stack = [(self.root, self.root)]
        while stack:
            x, y = stack.pop()
            a = one(x)
            if a >= 0 and a == (one(y) if x is not y else a) or not close(x, y):
                continue
            if x["children"] or y["children"]:
                if x is y:
                    c = x["children"]
                    stack += [(c[i], c[j]) for i in range(len(c)) for j in range(i, len(c))]
                elif x["children"] and (not y["children"] or len(x["members"]) >= len(y["members"])):
                    stack += [(c, y) for c in x["children"]]
                else:
                    stack += [(x, c) for c in y["children"]]
                continue
            p, q = x["members"], y["members"]
            lost = np.bitwise_count(self.bits[p][:, None] & ~self.bits[q][None]).sum(2, dtype=np.int64), np.bitwise_count(self.bits[q][None] & ~self.bits[p][:, None]).sum(2, dtype=np.int64)
            most = np.minimum(self.sizes[p][:, None] - lost[0], self.sizes[q][None] - lost[1])
            hit = most * (num + den) >= num * (self.sizes[p][:, None] + self.sizes[q][None])
            for i, j in zip(*(v.tolist() for v in np.nonzero(hit)), strict=True):
                u, v = int(p[i]), int(q[j])
                if x is y and i >= j or across is not None and across[u] == across[v]:
                    continue
                ru, rv = find(u), find(v)
                if ru == rv:
                    continue
                if self.sets:
                    both = len(np.intersect1d(self.sets[u], self.sets[v], assume_unique=True))
                if not self.sets or den * both >= num * (len(self.sets[u]) + len(self.sets[v]) - both):
                    parent[max(ru, rv)] = min(ru, rv)
                    out.append((u, v))
        return out


def carried(rows: DataFrame) -> DataFrame:
    """rows, which are written, told to all tasks if there are no more than CARRIED."""
    return F.broadcast(rows) if rows.limit(CARRIED + 1).count() <= CARRIED else rows


#: What a plan says of each set of a task, beside doc_id, h1 and h2.
NAMES = ["task", "cluster", "node", "side", "component"]


def whole_sets(docs: DataFrame, plan: DataFrame, words: int) -> DataFrame:
    """The n-grams of the sets of a plan.  Sets travel, not texts, and texts stay in place while the plan is small."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("jaccard")
        for batch in batches:
            for part in slices(batch):
                got = all_shingles(part.column("text").to_pylist(), words)
                # another row of the same id may have another set
                own = [digest(s) == (a, b) for s, a, b in zip(got, part.column("h1").to_pylist(), part.column("h2").to_pylist(), strict=True)]
                kept = part.filter(pa.array(own, pa.bool_()))
                yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in NAMES), pa.array([s.tobytes() for s, o in zip(got, own, strict=True) if o], pa.binary())], [*NAMES, "data"])

    return docs.join(plan, "doc_id").select(*NAMES, "h1", "h2", "text").mapInArrow(sets, "task string, cluster long, node long, side int, component long, data binary")


def join_tasks(sent: DataFrame, similarity: Fraction, tasks: int, sketches: bool) -> DataFrame:
    """Links (u, v) of nodes; sent has NAMES and the data of each set of a task: its n-grams or its sketch.

    A task's rows are sorted by cluster, so that a worker holds one cluster's sets at a time.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("jaccard")
        cluster, own = None, {}
        for batch in batches:
            for i, (t, c, node, side, comp) in enumerate(zip(*(batch.column(n).to_pylist() for n in NAMES), strict=True)):
                if (t, c) != cluster:
                    yield from joined(own)
                    cluster, own = (t, c), {}
                if node not in own:
                    own[node] = (np.frombuffer(batch.column("data")[i].as_py(), np.uint64), side, comp)
        yield from joined(own)

    def joined(own: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
        if len(own) > 1:
            nodes = sorted(own)
            sides = np.array([own[n][1] for n in nodes])
            found = SignatureTree([own[n][0] for n in nodes], sketches).links(similarity, np.array([own[n][2] for n in nodes]), sides if len(set(sides.tolist())) > 1 else None)
            yield pa.RecordBatch.from_arrays([pa.array([nodes[x[k]] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    return sent.repartition(tasks, "task").sortWithinPartitions("task", "cluster").mapInArrow(work, "u long, v long")


def connected(members: DataFrame, send: Callable[[DataFrame], DataFrame], similarity: Fraction, times: int, sketches: bool) -> DataFrame:
    """Components of the links within clusters; members has doc_id, h1, h2, node, n, cluster and its size.

    send gives the sets of a plan to join_tasks(); a cluster or a task has `times` as many n-grams as of whole sets.
    """
    most = LARGE * times
    blocks = F.ceil(F.col("size") / most).cast("long")
    small = members.filter(F.col("size") <= most)
    large = members.filter(F.col("size") > most)
    bins = max(1, -(-(small.agg(F.sum("n")).first()[0] or 0) // (TASK * times)))
    columns = ["doc_id", "h1", "h2", "node", "task", "cluster", "side", "component"]
    plain = small.withColumns({"task": F.pmod(F.xxhash64("cluster"), F.lit(bins)).cast("string"), "side": F.lit(0), "component": F.col("node")}).select(*columns)
    block = large.withColumns({"block": F.pmod(F.xxhash64("node"), blocks), "side": F.lit(0), "component": F.col("node")})
    pivot = lambda k: F.min(F.struct(F.xxhash64("node", F.lit(k)), "node", "doc_id", "h1", "h2")).alias(f"p{k}")
    pivots = large.groupBy("cluster", "size").agg(*(pivot(k) for k in range(PIVOTS)))
    each = pivots.select("cluster", "size", F.explode(F.array(*(F.col(f"p{k}") for k in range(PIVOTS)))).alias("p"))
    each = each.select("cluster", "size", F.col("p.node").alias("node"), F.col("p.doc_id").alias("doc_id"), F.col("p.h1").alias("h1"), F.col("p.h2").alias("h2")).distinct()
    spread = each.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).withColumns({"side": F.lit(0), "component": F.col("node")})
    blocked = block.select("cluster", "node", "doc_id", "h1", "h2", "block", "side", "component").unionByName(spread.select("cluster", "node", "doc_id", "h1", "h2", "block", "side", "component")).distinct()
    first = plain.unionByName(blocked.withColumn("task", F.concat_ws("/", "cluster", "block")).select(*columns))
    # the number of tasks to deal out to: those of small clusters and of blocks of large ones
    many = bins + (large.select("cluster", "size").distinct().agg(F.sum(blocks)).first()[0] or 0)
    links = materialise(join_tasks(send(carried(materialise(first, "plan"))), similarity, many, sketches), "links")
    found = components(links)

    if many > bins:
        # large clusters: whatever is not in the largest component, against everything else
        state = large.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        parts = state.groupBy("cluster", "component").agg(F.sum("n").alias("own"))
        top = parts.groupBy("cluster").agg(F.max(F.struct("own", "component")).alias("top"), F.sum("own").alias("all")).select("cluster", F.col("top.component").alias("main"), F.col("top.own").alias("mains"), (F.col("all") - F.col("top.own")).alias("others")).filter("others > 0")
        state = state.join(top, "cluster")
        a, b = (F.ceil(F.col(c) / most).cast("long") for c in ("mains", "others"))
        is_main = F.col("component") == F.col("main")
        rest = F.sequence(F.lit(0).cast("long"), b - 1)
        own_block = F.pmod(F.xxhash64("node"), F.when(is_main, a).otherwise(b))
        with_main = F.transform(F.sequence(F.lit(0).cast("long"), a - 1), lambda i: F.concat_ws("/", F.lit("m"), i, F.col("own")))
        with_rest = F.transform(rest, lambda i: F.concat_ws("/", F.lit("r"), F.least(i, F.col("own")), F.greatest(i, F.col("own"))))
        to = F.when(is_main, F.transform(rest, lambda j: F.concat_ws("/", F.lit("m"), F.col("own"), j))).otherwise(F.concat(with_main, with_rest))
        second = state.withColumn("own", own_block).withColumn("task", F.explode(to)).withColumns({"task": F.concat_ws("/", "cluster", "task"), "side": F.lit(0)}).select(*columns)
        again = top.agg(F.sum(a * b + b * (b + 1) / 2)).first()[0]
        if again:
            links = links.unionByName(materialise(join_tasks(send(carried(materialise(second, "again"))), similarity, int(again), sketches), "links"))
            found = components(links)
    return found


def similar(docs: DataFrame, words: int = WORDS, similarity: Fraction = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs."""
    return grouped(docs, words, similarity).select("doc_id", "n_shingles", "component_id")


def grouped(docs: DataFrame, words: int, similarity: Fraction) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs, the digest h1, h2 of its set and, if it has n-grams, its component."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = materialise(classify(own, words, similarity), "sets")
    rows = found.filter("band is not null")
    share = F.sum("n_shingles") >= FREQUENT * F.lit(rows.count())
    grams = found.filter("band is null").groupBy("h1").agg(share.alias("many"), F.sum("n_shingles").alias("n")).filter("many").orderBy(F.desc("n"), "h1").limit(MOST_FREQUENT).select("h1").collect()  # bounded
    frequent = np.sort(np.array([r["h1"] for r in grams], dtype=np.int64).view(np.uint64))
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    classes = rows.filter("n_shingles > 0").groupBy("h1", "h2", "band").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"), F.count("*").alias("copies"))
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    # a set's places, as in place(): in its own band and in the next
    even = F.col("h1").bitwiseAND(F.lit(-2))
    places = classes.withColumn("place", F.explode(F.array(even, even.bitwiseOR(F.lit(1)))))

    buckets = max(1, -(-total // BUCKET))
    clusters = components(meetings(own, words, similarity, buckets, frequent))
    members = clusters.select(F.col("node").alias("place"), F.col("component").alias("cluster")).join(places.select("place", "node", "doc_id", "h1", "h2", "n"), "place").filter("doc_id is not null")
    members = materialise(members, "members")
    sets = members.count()
    # where all sets are one band below, those that are similar meet in that band too
    per = members.groupBy("cluster").agg(F.max(F.col("place").bitwiseAND(F.lit(1)) == 0).alias("own"), F.sum("n").alias("size"), F.count("*").alias("sets"))
    per = materialise(per, "sizes")
    members = beside(members, per, sets, ["cluster"], "sets").filter("own").drop("own")

    # first by bitmaps; whatever stays together is one cluster, whichever bands it met in
    sketched = rows.select("doc_id", "h1", "h2", F.col("sketch").alias("data"))
    kept = connected(members, lambda plan: sketched.join(plan, ["doc_id", "h1", "h2"]).select(*NAMES, "data"), similarity, SKETCHED, True)
    chosen = kept.select("node", F.col("component").alias("cluster")).join(classes.select("node", "doc_id", "h1", "h2", "n"), "node")
    chosen = materialise(chosen, "chosen")
    per = materialise(chosen.groupBy("cluster").agg(F.sum("n").alias("size"), F.count("*").alias("sets")), "sizes")
    chosen = beside(chosen, per, chosen.count(), ["cluster"], "sets")
    found = connected(chosen, lambda plan: whole_sets(own, plan, words), similarity, 1, False)

    node = materialise(classes.join(found, "node", "left").select("h1", "h2", "doc_id", "copies", F.coalesce("component", "node").alias("component")), "nodes")
    ids = materialise(node.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("sets")), "ids")
    named = materialise(beside(node, ids, node.count(), ["component"], "sets").select("h1", "h2", "component_id", "component", "copies"), "named")
    columns = ["doc_id", "n_shingles", "component_id", "h1", "h2", "component"]
    some = beside(rows.filter("n_shingles > 0"), named, rows.count(), ["h1", "h2"], "copies").select(*columns)
    none = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "h1", "h2", F.lit(None).cast("long").alias("component"))
    return some.unionByName(none).withColumns({c: F.nullif(F.col(c), F.lit(NO_ID)) for c in ("doc_id", "component_id")})


def representatives(docs: DataFrame, words: int = WORDS, similarity: Fraction = SIMILARITY) -> DataFrame:
    """docs with one row of each group of similar rows, that of the least id; rows without n-grams all stay.

    If several rows of the group have that id, one of those with the least digest of n-grams stays.  A row without an id
    stays only where no row of its group has one.
    """
    found = grouped(docs, words, similarity)
    own, rows, firsts, *digests = (fresh(docs.columns, n) for n in ("own_id", "rows_of_id", "firsts_of_id", "h1", "h2"))
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    # ids with several rows, or with one that goes, as there are fewer of them than of others
    per = found.groupBy(F.col("doc_id").alias(own)).agg(F.count("*").alias(rows), F.count_if(first).alias(firsts))
    marks = materialise(per.filter((F.col(rows) > 1) | (F.col(firsts) == 0)), "marks")
    marked = docs.join(carried(marks), F.col("doc_id").cast("long").eqNullSafe(F.col(own)), "left").drop(own)
    single = marked.filter(F.col(rows).isNull()).drop(rows, firsts)
    repeated = marks.filter(F.col(rows) > 1).select(own)
    if repeated.isEmpty():
        return single
    # repeated ids are the exception, so only their rows are told apart by what they hold
    several = found.filter(first).join(carried(repeated), F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")
    least = several.filter("n_shingles > 0").groupBy("doc_id", "component").agg(F.min(F.struct("h1", "h2")).alias("least")).select(F.col("doc_id").alias(own), "least.*")
    least = least.unionByName(several.filter("n_shingles = 0").select(F.col("doc_id").alias(own), "h1", "h2").distinct()).withColumnsRenamed(dict(zip(("h1", "h2"), digests, strict=True)))
    same = [F.col(f"a.{d}") == F.col(f"b.{d}") for d in digests]
    kept = digested(marked.filter(F.col(rows) > 1).drop(rows, firsts), digests, words).alias("a").join(materialise(least, "least").alias("b"), [F.col("a.doc_id").cast("long").eqNullSafe(F.col(f"b.{own}")), *same]).select("a.*")
    empty = F.col(digests[0]) == digest(np.zeros(0, np.uint64))[0]
    return single.unionByName(kept.filter(~empty).dropDuplicates(["doc_id", *digests]).unionByName(kept.filter(empty)).drop(*digests))


def digested(docs: DataFrame, names: list[str], words: int) -> DataFrame:
    """docs with the digest of each row's set in two more columns."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h = np.array([digest(x) for x in all_shingles(part.column("text").cast(pa.string()).to_pylist(), words)], dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(h[:, 0]), pa.array(h[:, 1])], [*part.schema.names, *names])

    return docs.mapInArrow(work, T.StructType([*docs.schema, *(T.StructField(n, T.LongType()) for n in names)]))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(documents(spark, sf_dir), words=4, similarity=Fraction(85, 100))
