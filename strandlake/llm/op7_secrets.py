"""Secret scans: base patterns, and random strings by token efficiency.

Base kinds are patterns over the whole text.  The method's own kind, ``token``,
takes runs of at least ``MIN_RUN`` characters of ``[A-Za-z0-9+/_=-]`` and
measures characters per token under a byte-level vocabulary: text that people
write compresses to 3 or more characters a token, random strings stay under
2.2.  Spans of the base kinds are cut out of a run first, and what is left of it
is judged by itself.  Excluded are digests of known lengths in hexadecimal, UUIDs
and plain numbers, and by the same measure identifiers: words joined by case,
``_``, ``-``, ``/`` or short numbers, if the words alone compress to
``WORD_RATIO`` letters a token.  A run need hold no digit.

Defined cases: null and empty texts have no span; very long texts are scanned whole,
in time that grows with their length; of spans of different kinds that start together
each stays, in the order of the kinds; repeated rows are scanned alike; a null doc_id stays null; an empty table gives no rows; ``redact`` keeps
every column of its input, whatever its name.
"""

from __future__ import annotations

import base64
import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, mapped, read, spark_schema

#: The base kinds, in their order, and their patterns and least lengths.
KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
#: Fixed: hexadecimal lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)

MIN_RUN = 20
MAX_RATIO = 2.2
#: Least letters a token of an identifier's words, each in lower case; of 20 random letters about 0.1 % reach it.
WORD_RATIO = 2.5
RUN = re.compile(r"[A-Za-z0-9+/_=\-]{%d,}" % MIN_RUN)
_HEXADECIMAL = re.compile(r"[0-9a-fA-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[A-Z]")
_LONG_NUMBER = re.compile(r"[0-9]{5}")
_NUMBER = re.compile(r"[0-9_/=+\-]+")

_ENCODERS: dict[str, object] = {}


def _encoder(path: str):
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def is_known_form(run: str) -> bool:
    """A digest of a known length, a UUID or a number."""
    if _HEXADECIMAL.fullmatch(run) and len(run) in DIGEST_LENGTHS:
        return True
    return bool(_UUID.fullmatch(run) or _NUMBER.fullmatch(run))


def is_identifier(run: str, path: str | None = None) -> bool:
    """Words with short numbers at most between them: the words compress to long tokens, as random letters don't."""
    words = _WORD.findall(run)
    letters = sum(map(len, words))
    if not words or _LONG_NUMBER.search(run) or sum(map(str.isdigit, run)) > letters:
        return False
    encode = _encoder(path or vocabulary_path()).encode_ordinary
    return letters >= WORD_RATIO * sum(len(encode(w.lower())) for w in words)


def characters_per_token(run: str, path: str | None = None) -> float:
    return len(run) / len(_encoder(path or vocabulary_path()).encode_ordinary(run))


def _pieces(runs: list[tuple[int, int]], spans: list[tuple[int, int, int]]):
    """The parts of the runs that no span covers; both by start, and each is passed once."""
    joined: list[list[int]] = []
    for x, y, _ in spans:
        if joined and x <= joined[-1][1]:
            joined[-1][1] = max(y, joined[-1][1])
        else:
            joined.append([x, y])
    at = 0
    for a, b in runs:
        while at < len(joined) and joined[at][1] <= a:
            at += 1
        while at < len(joined) and joined[at][0] < b:
            x, y = joined[at]
            if x > a:
                yield a, x
            a = y
            if y >= b:  # it may cover the next run, too
                break
            at += 1
        if a < b:
            yield a, b


def find_spans(text: str | None, path: str | None = None, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, int]]:
    """(start, end, kind index) in code points, sorted by start, then kind."""
    if not text:
        return []
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(k in low for k in ASSIGN_KEYS):
        found += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(*m.span(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    runs = [m for m in RUN.finditer(text)]
    if runs:
        found += [(*m.span(), 2) for m in HEX.finditer(text)]
        for a, b in _pieces([m.span() for m in runs], sorted(found)):
            run = text[a:b].strip("=-_/+")
            # a key may begin or end with a sign or two
            if b - a < MIN_RUN or len(run) < MIN_RUN - 2 or is_known_form(run):
                continue
            if characters_per_token(run, path) < max_ratio and not is_identifier(run, path):
                found.append((a, b, 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def redacted(text: str | None, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str | None:
    """The text with overlapping spans joined and each replaced by ``mark``."""
    if not spans:
        return text
    parts, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            parts += [text[at:a], mark]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def scan(docs: DataFrame, vocabulary: str | None = None, max_ratio: float = MAX_RATIO) -> DataFrame:
    """doc_id, kinds (array<int>), starts, ends (array<bigint>): the spans of each document."""
    path = vocabulary or vocabulary_path()
    schema = arrow_schema("doc_id long, kinds ints, starts longs, ends longs")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            spans = [find_spans(t, path, max_ratio) for t in batch.column("text").to_pylist()]
            columns = [[[s[i] for s in x] for x in spans] for i in (2, 0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, schema.types[1:]))], schema=schema)

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(run, spark_schema("doc_id long, kinds ints, starts longs, ends longs"))


def redact(docs: DataFrame, vocabulary: str | None = None, max_ratio: float = MAX_RATIO) -> DataFrame:
    """``docs`` with the secrets of ``text`` replaced; every row and column stays (n_chars, if any, is counted anew)."""
    path, at = vocabulary or vocabulary_path(), docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [redacted(t, find_spans(t, path, max_ratio)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.types[at]) if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    clean = mapped(docs, run)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.coalesce(F.length("text"), F.lit(0))).cast(docs.schema["n_chars"].dataType))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = scan(read(spark, sf_dir, "documents")).withColumn("span", F.arrays_zip("kinds", "starts", "ends"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(names, s["kinds"] + 1), s["starts"].cast("string"), s["ends"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("long")
    base = F.filter("span", lambda s: s["kinds"] < 3)
    return spans.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("span")).alias("spans"), count(3).alias("n_token"))
