"""Secrets in texts: fixed patterns, and strings that a token vocabulary encodes badly."""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake.llm.common import map_batches

#: Fixed patterns, in the order that spans with the same start have, with the group measured and its least length.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{16}")
KINDS = ("assign", "access", "hex", "random")
#: Words of which a text must have one for ASSIGN to match.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: A string worth measuring: long enough, of the letters that keys and encodings use; and its parts.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PART = re.compile(r"[^/=]{20,}")
URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{0,20}://[^\s\"'<>]+")
EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])")
#: Characters per token below which a string counts as random, and classes of characters it must mix.
MAX_RATIO, MIN_CLASSES = 2.4, 2
#: Digests of known algorithms in base64 or base32, as integrity attributes and archives write them, and what may stand before the digest.
NAMED_DIGEST = re.compile(r"(?:md5|sha-?(?:1|224|256|384|512))-[A-Za-z0-9+/_-]{22,88}={0,2}", re.IGNORECASE)
BARE_DIGEST = re.compile(r"[A-Za-z0-9+/_-]{22}(?:==)?|[A-Za-z0-9+/_-]{27}=?|[A-Za-z0-9+/_-]{43}=?|[A-Za-z0-9+/_-]{64}|[A-Za-z0-9+/_-]{86}(?:==)?|[A-Z2-7]{32}")
DIGEST_NAME = re.compile(r"(?:md5|sha-?(?:1|224|256|384|512))[:=]\x20?\Z", re.IGNORECASE)
#: Lengths in hexadecimal digits of the digests that texts quote: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGESTS = {32, 40, 56, 64, 96, 128}
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
IDENTIFIER = re.compile(
    r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"  # UUID
    r"|[A-Z]{0,2}[a-z]+(?:[_/-][A-Z]{0,2}[a-z]+|[A-Z]{1,2}[a-z]+)*[0-9]{0,4}"  # words joined by case or by marks
    r"|[A-Z]+(?:[_/-][A-Z]+)*[0-9]{0,4}"
    r"|[0-9+/_=-]+"  # numbers and rules
)


@lru_cache(maxsize=2)
def vocabulary(path: str):
    """This worker's encoding for a file of ranks."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the fixed patterns, by start, then in the order of ``KINDS``."""
    out = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if LONG_HEX.search(text):
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= 16]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def quoted(s: str) -> bool:
    """A digest of known length, or a UUID."""
    return bool(len(s) in DIGESTS and DIGEST.fullmatch(s) or UUID.fullmatch(s))


def named_digest(text: str, a: int, b: int) -> bool:
    """Whether the string at a place is a digest whose algorithm is named in it or just before it."""
    s = text[a:b]
    return bool(NAMED_DIGEST.fullmatch(s) or BARE_DIGEST.fullmatch(s) and DIGEST_NAME.search(text, max(0, a - 9), a))


def within(spans: list[tuple], a: int, b: int) -> bool:
    """Whether one of ``spans``, sorted and apart from each other, overlaps a place."""
    k = bisect_left(spans, (b,))
    return k > 0 and spans[k - 1][1] > a


def encodes_badly(s: str, ranks: str) -> bool:
    """Whether a string has few characters per token and is neither a digest nor made of words."""
    if quoted(s) or IDENTIFIER.fullmatch(s):
        return False
    classes = sum(bool(re.search(c, s)) for c in ("[a-z]", "[A-Z]", "[0-9]"))
    return classes >= MIN_CLASSES and len(s) < MAX_RATIO * len(vocabulary(ranks).encode_ordinary(s))


def random_spans(text: str, ranks: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Further strings with few characters per token, but those that lie inside a span already taken.

    A string is measured whole and, where that does not mark it, in its parts between ``/`` and ``=``; in URLs,
    and beside a digest or UUID, only the parts are. Digests of known lengths, UUIDs, e-mail addresses and
    strings made of words are left out, and so are digests in base64 or base32 after the name of their algorithm; the name
    and password of a URL are no e-mail address. ``taken`` is sorted. Time is linear in the text.
    """
    out = []
    urls = [m.span() for m in URL.finditer(text)] if "://" in text else []
    # Up to the first slash after its mark a URL holds a name and password, which are no e-mail address.
    hosts = [(u, next((k for k in (text.find("/", text.index("://", u) + 3, v),) if k >= 0), v)) for u, v in urls]
    mails = [m.span() for m in EMAIL.finditer(text)] if "@" in text else []
    mails = [(x, y) for x, y in mails if not within(hosts, x, x + 1)]
    at, most = 0, 0  # spans taken that begin before a part, and how far they reach
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        if within(mails, a, b) or named_digest(text, a, b):
            continue
        parts = [(a + k.start(), a + k.end()) for k in PART.finditer(m[0])]
        whole = not within(urls, a, a + 1) and not any(quoted(text[x:y]) for x, y in parts)
        if whole and encodes_badly(m[0], ranks):
            parts = [(a, b)]
        else:
            parts = [(x, y) for x, y in parts if encodes_badly(text[x:y], ranks)]
        for x, y in parts:
            while at < len(taken) and taken[at][0] <= x:
                most, at = max(most, taken[at][1]), at + 1
            if y > most:
                out.append((x, y, "random"))
    return out


def all_spans(text: str | None, ranks: str) -> list[tuple[int, int, str]]:
    """Base and further spans, by start, then in the order of ``KINDS``."""
    base = base_spans(text or "")
    return sorted(base + random_spans(text or "", ranks, base), key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, ranks: str, name: str = "secrets") -> DataFrame:
    """``docs`` with ``name``: an array of (start, end, kind), in code points, end exclusive.

    Sorted by start, then by kind in the order of ``KINDS``. Null and empty texts have an empty
    array; whole texts are searched; other columns, repeated rows and empty tables pass through, but a column
    of that name is replaced.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            spans = [[{"start": a, "end": b, "kind": k} for a, b, k in all_spans(t, ranks)] for t in texts]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], names=[*batch.schema.names, name])

        return step

    docs = docs.drop(name)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{name}` array<struct<start:bigint,`end`:bigint,kind:string>>"])
    return map_batches(docs, make, schema)


def digest_columns(found: DataFrame) -> DataFrame:
    """The counts, digest and list that stand for a document's spans."""
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("secrets")).alias("spans"))


def redact(docs: DataFrame, ranks: str, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each run of overlapping spans replaced by ``mark``, and ``n_chars`` as it is then.

    Texts without a secret, null ones too, stay as they are. The columns are those of ``docs``.
    """

    def clean(text: str) -> str:
        out, at = [], 0
        for start, end, _ in all_spans(text, ranks):
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            i = batch.schema.get_field_index("text")
            columns = batch.columns
            columns[i] = pa.array([clean(t) if t else t for t in batch.column(i).to_pylist()], pa.string())
            return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        return step

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = map_batches(docs, make, schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kind)))
    return out
