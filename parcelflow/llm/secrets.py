"""Secret scans: stated patterns, and strings that a tokenizer's vocabulary can't shorten.

Natural words and code identifiers take about four characters a token; random strings take about two or fewer.  The
token-efficiency test looks at runs of LONG or more characters of key alphabets that have letters, leaves out digests
of known lengths, UUIDs, dates and names of which words that pass the same test hold half, and reports what has fewer
than RATIO characters a token.  Its spans (kind `random`) never overlap those of the patterns.

Offsets are code points, ends exclusive.  A null text counts as empty: no spans.  Rows keep their number; repeated
ids and rows are scanned one by one; an empty table gives an empty result; only doc_id and text are read by scan().
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelflow.llm.common import CACHES, documents, only, slices

KINDS = ("assign", "access", "hex", "random")
LONG, RATIO, AT_ONCE = 20, 2.4, 2000
MASK = "[SECRET]"

# fixed values: the patterns that the scan is asked for, and the least length of each
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run is taken whole, so a short one fails wherever it starts
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.~-]{%d,}" % LONG)
DIGEST = re.compile(r"[0-9a-fA-F]+={0,2}")
DIGEST_LENGTHS = {32, 40, 48, 56, 64, 96, 128}
KNOWN = re.compile(
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"  # UUID
    r"|[0-9.:TZ+/_=~-]+"  # numbers, dates, versions
)
# names are words with short numbers between separators: paths, hosts, snake_case; each part is matched by itself
SEPARATORS, PART, LAST = re.compile(r"[/._=~+-]+"), re.compile(r"[A-Za-z]*\d{0,4}"), re.compile(r"[A-Za-z]+\d{0,4}")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

_loaded: dict[str, tiktoken.Encoding] = {}


def encoding(path: str) -> tiktoken.Encoding:
    """One copy for each worker process, as long as it scans."""
    CACHES["secrets"] = _loaded.clear
    only("secrets")
    if path not in _loaded:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def is_random(run: str, vocabulary: tiktoken.Encoding) -> bool:
    run = run.rstrip("=").strip(".-_/+~")
    if len(run) < LONG or not re.search("[A-Za-z]", run):
        return False
    if DIGEST.fullmatch(run) and len(run) in DIGEST_LENGTHS or KNOWN.fullmatch(run):
        return False
    if len(run) >= RATIO * tokens(run, vocabulary):
        return False
    return not (is_name(run) and named(run, vocabulary))


def tokens(run: str, vocabulary: tiktoken.Encoding) -> int:
    """Tokens of a run, of which so many characters are encoded at once, as merging takes longer than in proportion."""
    return sum(len(vocabulary.encode_ordinary(run[k : k + AT_ONCE])) for k in range(0, len(run), AT_ONCE))


def is_name(run: str) -> bool:
    *parts, last = SEPARATORS.split(run)
    return bool(LAST.fullmatch(last)) and all(map(PART.fullmatch, parts))


def named(run: str, vocabulary: tiktoken.Encoding) -> bool:
    """Whether words of three or more letters that pass the ratio test hold half of the letters, or few signs recur."""
    if len(set(run)) <= 4:
        return True
    words = WORD.findall(run)
    held = sum(len(w) for w in words if len(w) >= 3 and len(w) >= RATIO * tokens(w, vocabulary))
    return 2 * held >= sum(map(len, words))


def spans(text: str, vocabulary: tiktoken.Encoding) -> list[tuple[int, int, int]]:
    """(start, index of its kind, end) of all spans, sorted."""
    low = text.lower()
    found = []
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    most = max(map(len, text.split()), default=0)  # neither of the next has white space
    if most >= HEX_LEAST:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if most >= LONG:
        base = sorted(found)
        k = reach = 0
        for m in CANDIDATE.finditer(text):
            while k < len(base) and base[k][0] < m.end():
                reach, k = max(reach, base[k][2]), k + 1
            if reach <= m.start() and is_random(m[0], vocabulary):
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def scan(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end) sorted by start and kind."""
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoding(path)
        for batch in batches:
            for part in slices(batch):
                found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans(t, model)] if t else [] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.list_(kind))], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def redact(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """docs with every secret replaced by MASK (overlapping spans by one) and n_chars, where there is one, put right.

    All other columns, null texts and texts without secrets stay as they are.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    names = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoding(path)
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                for i, t in enumerate(texts):
                    if t and (found := spans(t, model)):
                        out, at = [], 0
                        for a, _, b in found:
                            if a >= at:
                                out += [t[at:a], MASK]
                            at = max(at, b)
                        texts[i] = "".join([*out, t[at:]])
                columns = [pa.array(texts, part.schema.field("text").type) if n == "text" else part.column(n) for n in names]
                yield pa.RecordBatch.from_arrays(columns, names)

    out = docs.mapInArrow(work, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """scan(), reduced in the workers to counts, a digest of the patterns' spans and all spans as text."""
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoding(path)
        for batch in batches:
            for part in slices(batch):
                found = [spans(t, model) if t else [] for t in part.column("text").to_pylist()]
                said = [[f"{KINDS[k]}:{a}:{b}" for a, k, b in x] for x in found]
                base = [hashlib.sha256(",".join(s for s, (_, k, _) in zip(y, x, strict=True) if k < 3).encode()).hexdigest() for x, y in zip(found, said, strict=True)]
                counts = [pa.array([sum(y[1] == k for y in x) for x in found], pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, pa.array(base, pa.string()), pa.array([",".join(y) for y in said], pa.string())], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
