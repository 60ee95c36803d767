"""Byte-pair encoding of distinct words, equal to the tokenizers library's results: over a prefix-sharing trie, or by its model.

White space never takes part in a token, so a text is a sequence of chunks between white space and every chunk is
encoded by itself; a worker encodes each distinct chunk once.  In `WordBpe`, distinct words of a batch go into a trie over byte
symbols.  A depth-first walk gives each node the last token of its prefix's encoding, derived from the states of its
ancestors: token t ends the encoding of prefix p exactly when t is a suffix of p and may follow the last token of the
rest.  Shared prefixes are therefore encoded once.
"""

from __future__ import annotations

import gc
import json
import re
import struct
import unicodedata
from collections.abc import Iterable

import numpy as np
import regex
from tokenizers import Tokenizer

from parcelflow.llm.common import CACHES, only

#: Code points that the tokenizers library's patterns take as white space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: White space to str.split() but not to the library.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Distinct chunks, and words, that a worker keeps twice at most: so many new ones, and those before them; and pairs of tokens.
#: Most chunks are met once only, so more of them would take memory and save little.
KEEP = 100_000
PAIRS = 500_000
#: Longer words are encoded by merging rather than through the trie, whose depth is thereby bounded.
LONGEST = 400

_loaded: dict[tuple[type, str], Chunked] = {}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class Recent:
    """Encodings by text: the latest ones, and those of the generation before, which are taken over when they are met again."""

    def __init__(self, times: float = 1) -> None:
        self.times = times
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def turn(self) -> None:
        """Begins a new generation if the present one is full."""
        if len(self.now) > self.times * KEEP:
            self.before, self.now = self.now, {}

    def missing(self, texts: set[str]) -> set[str]:
        """Those of the texts that neither generation has; all others are then in the present one."""
        self.turn()
        lacking = texts.difference(self.now)
        old = [t for t in lacking if t in self.before]
        for t in old:
            self.now[t] = self.before.pop(t)
        return lacking.difference(old)

    def clear(self) -> None:
        self.now, self.before = {}, {}


class Chunked:
    """Texts by their chunks, each distinct one encoded once: NFC, lower case, words of a vocabulary file's own pattern."""

    def __init__(self, spec: dict) -> None:
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        split = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words = regex.compile(split.replace(r"\s", SPACE))
        self.space = re.compile(f"[{SPACE}]+")
        self.chunks = Recent()

    def clear(self) -> None:
        self.chunks.clear()

    def pieces(self, chunk: str) -> list[str]:
        if not chunk.isascii():
            # the library lowers each code point by itself, so a final sigma has no form of its own
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        low = chunk.lower()
        if low.isalpha():
            return [low]
        if low[-1] in ".," and low[:-1].isalpha():
            return [low[:-1], low[-1]]
        return self.words.findall(low)

    def learn(self, found: set[str]) -> None:
        """Encodes the chunks that are not known yet."""
        raise NotImplementedError

    def split(self, text: str) -> list[str]:
        """The chunks of a text without special tokens."""
        return text.split() if not ODD_SPACE.search(text) else [c for c in self.space.split(text) if c]

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        watching = gc.isenabled()
        gc.disable()  # many small objects and no cycles: looking for some would take a fifth of the time
        try:
            return self._encode_packed(texts)
        finally:
            if watching:
                gc.enable()

    def _encode_packed(self, texts: list[str]) -> list[bytes]:
        cut = [self.special_pattern.split(t) if "<|" in t else [t] for t in texts]  # every second one is special
        split = [[self.split(p) if k % 2 == 0 else p for k, p in enumerate(parts)] for parts in cut]
        new: set[str] = set()
        for parts in split:
            for chunks in parts[::2]:
                new.update(chunks)
        self.learn(new)
        get = self.chunks.now.__getitem__
        return [b"".join(b"".join(map(get, p)) if k % 2 == 0 else struct.pack("<I", self.special[p]) for k, p in enumerate(parts)) for parts in split]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(x, "<u4").tolist() for x in self.encode_packed(texts)]


class WordBpe(Chunked):
    """A vocabulary file with word-end symbols, its words encoded over a trie."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        super().__init__(spec)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.text = {i: t for t, i in vocab.items()}
        self.text |= {i: t for t, i in self.special.items()}
        letters = byte_symbols()
        self.inner = [vocab[x] for x in letters]
        self.final = [vocab[x + end] for x in letters]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for k, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            key, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.rank.setdefault(key, k)
            self.made.setdefault(key, whole)
            self.parts.setdefault(whole, key)
        spelt: dict[int, tuple[int, ...]] = {i: (i,) for i in (*self.inner, *self.final)}
        byte_of = {i: bytes([b]) for ids in (self.inner, self.final) for b, i in enumerate(ids)}
        last = set(self.final)
        self.open: dict[bytes, int] = {}  # tokens by their bytes, inside words and at their ends
        self.close: dict[bytes, int] = {}
        for t, (a, b) in self.parts.items():  # parts come before what they make
            spelt[t] = spelt[a] + spelt[b]
        for t, s in spelt.items():
            (self.close if s[-1] in last else self.open)[b"".join(byte_of[i] for i in s)] = t
        self.starts = {x[:k] for x in (*self.open, *self.close) for k in range(1, len(x) + 1)}
        self.size = {t: len(x) for t, x in spelt.items()}
        self.spelt = spelt
        self.order = {self.made[p]: k for p, k in self.rank.items()}
        self.stands: dict[int, bool] = {}
        self.follows: dict[tuple[int, int], bool] = {}
        self.known = Recent()

    def clear(self) -> None:
        super().clear()
        self.known.clear()
        self.follows.clear()

    def merged(self, symbols: Iterable[int]) -> list[int]:
        """Plain merging, lowest rank first and leftmost of equals; in O(n^2), for long words and for pairs of tokens."""
        ids = list(symbols)
        while len(ids) > 1:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(ids, ids[1:])]
            best = min(ranks)
            if best == 1 << 60:
                break
            out, i = [], 0
            while i < len(ids):
                if i < len(ranks) and ranks[i] == best:
                    out.append(self.made[ids[i], ids[i + 1]])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def long_word(self, symbols: list[int]) -> list[int]:
        """The same for long words in O(n log n): a heap of pairs over a linked list."""
        import heapq

        ids, n = list(symbols), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.rank[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.made[a, b], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (p := (ids[i], ids[after[i]])) in self.rank:
                    heapq.heappush(heap, (self.rank[p], i, *p))
            if before[i] >= 0 and (p := (ids[before[i]], ids[i])) in self.rank:
                heapq.heappush(heap, (self.rank[p], before[i], *p))
        return [t for t in ids if t >= 0]

    def stand(self, t: int) -> bool:
        """Whether the token's own symbols are encoded as that token."""
        if (known := self.stands.get(t)) is None:
            known = self.stands[t] = self.merged(self.spelt[t]) == [t]
        return known

    def follow(self, a: int, t: int) -> bool:
        """Whether a and then t is what their joint symbols are encoded as: no merge across the border comes first.

        Undoes the later of the two tokens' merges step by step; the border holds if at no step the two tokens that
        touch it would have merged before the merge that is undone next.
        """
        if len(self.follows) > PAIRS:
            self.follows.clear()
        rank, parts, order = self.rank, self.parts, self.order
        left, right, known = a, t, self.stand(a) and self.stand(t)
        upto = 1 << 60
        while known:
            if (r := rank.get((left, right), upto)) < upto:
                known = False
                break
            # of equals the right one is undone first, as it was merged last
            x, y = order.get(left, -1), order.get(right, -1)
            if x < 0 and y < 0:
                break
            if x > y:
                upto, left = x, parts[left][1]
            else:
                upto, right = y + 1, parts[right][0]
        self.follows[a, t] = known
        return known

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """The encodings of distinct words (already normalised, each one match of the pattern).

        The trie is held as the sorted words with the length that each shares with its predecessor; their order is
        the depth-first walk.  For the nodes on the current path, `last` has the last token of the prefix's encoding
        and `reach` the start of its longest suffix with which some token begins.
        """
        out: dict[str, bytes] = {}
        last, reach = [0], [0]  # of the empty prefix
        size, follows, starts, pack = self.size, self.follows, self.starts, struct.pack
        before = b""
        for b, w in sorted((w.encode("utf-8"), w) for w in words):
            n = len(b)
            if n > LONGEST:
                ids = self.long_word([*(self.inner[x] for x in b[:-1]), self.final[b[-1]]])
                out[w] = pack(f"<{len(ids)}I", *ids)
                continue
            shared, most = 0, min(len(last), n) - 1
            while shared < most and b[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], reach[shared + 1 :]
            k = reach[shared]
            for at in range(shared + 1, n + 1):
                tokens = self.close if at == n else self.open
                while b[k:at] not in starts:
                    k += 1
                j = k
                while True:  # every prefix has an encoding, so some token ends it
                    if (t := tokens.get(b[j:at])) is not None:
                        if j == 0:
                            if self.stand(t):
                                break
                        elif (known := follows.get((last[j], t))) or known is None and self.follow(last[j], t):
                            break
                    j += 1
                if at < n:
                    last.append(t)
                    reach.append(k)
            before = b
            ids = [t]
            while j > 0:
                ids.append(t := last[j])
                j -= size[t]
            out[w] = pack(f"<{len(ids)}I", *reversed(ids))
        return out

    def learn(self, found: set[str]) -> None:
        """Encodes the chunks that are not known yet."""
        new = {c: self.pieces(c) for c in self.chunks.missing(found)}
        words = self.known.missing({w for ws in new.values() for w in ws})
        known, chunks = self.known.now, self.chunks.now
        known.update(self.encode_words(words))
        for c, ws in new.items():
            chunks[c] = known[ws[0]] if len(ws) == 1 else b"".join([known[w] for w in ws])

    def decode(self, ids: Iterable[int]) -> str:
        """The file names no decoder, so the library joins the tokens by spaces."""
        return " ".join(self.text[i] for i in ids)


class LibraryBpe(Chunked):
    """The same ids, with words merged by the tokenizers library's own model: a quarter of the trie's time, and none of its tables."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            super().__init__(json.load(f))
        self.model = Tokenizer.from_file(path).model
        self.chunks, self.known = Recent(1.5), Recent(1.5)  # without the tables there is room
        self.letters = str.maketrans(dict(enumerate(byte_symbols())))

    def clear(self) -> None:
        super().clear()
        self.known.clear()

    def encode_word(self, word: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(word.encode("utf-8").decode("latin-1").translate(self.letters))]  # a character a byte
        return struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, found: set[str]) -> None:
        missing = self.chunks.missing(found)
        self.known.turn()
        encode, pieces, chunks = self.encode_word, self.pieces, self.chunks.now
        known, before = self.known.now, self.known.before
        for c in missing:
            out = []
            for w in pieces(c):
                if (x := known.get(w)) is None:
                    x = known[w] = before.get(w) or encode(w)
                out.append(x)
            chunks[c] = out[0] if len(out) == 1 else b"".join(out)


def forget() -> None:
    for model in _loaded.values():
        model.clear()


def load(path: str, kind: type[Chunked] = WordBpe) -> Chunked:
    """One copy of a kind for each worker process."""
    CACHES["bpe"] = forget
    only("bpe")
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]
