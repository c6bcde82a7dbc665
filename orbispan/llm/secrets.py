"""Secret scan with a token-efficiency test (operator 5).

Three patterns give the base spans. On top, every separate run of 20 or more key characters is encoded with a byte-level
BPE vocabulary: prose and names cost few tokens, random strings many, so few characters per token expose them, once
known digests and identifiers are set aside. One pass over the texts, no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbispan.llm.common import map_arrow, texts_of
from orbispan.llm.tokens import byte_bpe

# The base patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")

#: Characters of a run to be tested, and the fewest that may be asked for: shorter ones have too few tokens to tell.
MIN_RUN, LEAST_RUN = 20, 8
#: Listed digests and identifiers that go to every task.
MOST_KNOWN = 1_000_000
#: Characters per token below which a run counts as random. Prose and compound words have 2.4 and more, base64 about 1.4.
MAX_RATIO = 2.0
_RUN = r"[A-Za-z0-9+/_=-]{%d,}"
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_DIGEST = re.compile(r"(?:(?:md5|sha-?\d+)[-_=]?)?(?:[0-9a-f]+|[0-9A-F]+)", re.A)
_DIGEST_SIZES = frozenset({32, 40, 56, 64, 96, 128})
_NUMBER = re.compile(r"[0-9_+/=-]+")
#: Scheme, host and path of a URL. Scheme and host are set aside, the path's segments are tested one by one; what stands
#: before an @, in the query or in the fragment is tested like other text.
_URL = re.compile(r"(?:(?:https?|ftp|s3|file)://(?P<user>[^\s/?#@\"'<>,]*@)?|www\.)(?P<place>[\w.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~%!$*+:@/=-]*)?|/[A-Za-z0-9._~%!$*+:@/=-]*)")
_MAIL = re.compile(r"(?:(?<=mailto:)|(?<![A-Za-z0-9._%+:/-]))[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of the base patterns, leftmost and non-overlapping for each kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]


def is_known(run: str, known: frozenset[str]) -> bool:
    """A digest, UUID or number by form, or a listed digest or identifier."""
    if run in known or _UUID.fullmatch(run) or _NUMBER.fullmatch(run):
        return True
    return bool(_DIGEST.fullmatch(run)) and len(re.sub(r"^(?:md5|sha-?\d+)[-_=]?", "", run)) in _DIGEST_SIZES


def aside(text: str) -> list[tuple[int, int]]:
    """Spans of mail addresses, of schemes and hosts of URLs, and of the slashes that part their paths."""
    found = [m.span() for m in _MAIL.finditer(text)] if "@" in text else []
    for m in _URL.finditer(text) if "://" in text or "www." in text else ():
        at, place = m.start("place"), m["place"]
        host = place.find("/") if "/" in place else len(place)
        found.append((at if m["user"] else m.start(), at + host))
        found += [(at + i, at + i + 1) for i in range(host, len(place)) if place[i] == "/"]
    return sorted(found)


def random_spans(text: str, encode, known: frozenset[str], max_ratio: float, taken: list[tuple[int, int, int]], runs: re.Pattern, min_run: int) -> list[tuple[int, int, int]]:
    found, spans = [], None
    for m in runs.finditer(text):
        if any(s < m.end() and m.start() < e for s, _, e in taken):
            continue
        if spans is None:
            spans = aside(text)
        at, parts = m.start(), []
        for s, e in spans[max(0, bisect_left(spans, (at, 0)) - 1) :]:
            if s >= m.end():
                break
            if e > at:
                parts.append((at, s))
                at = e
        for s, e in [*parts, (at, m.end())]:
            if e - s >= min_run and not is_known(run := text[s:e], known) and len(run) < max_ratio * len(encode(run)):
                found.append((s, 3, e))
    return found


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: Iterable[str] | DataFrame = (), max_ratio: float = MAX_RATIO, min_run: int = MIN_RUN, vocabulary: str | None = None) -> DataFrame:
    """id, spans array<struct<kind, start, end>> for every row, by start and then kind; code points, end exclusive.

    Kinds: assign, access and hex by pattern, random by token efficiency: runs of at least min_run key characters, outside
    spans of the others, mail addresses and schemes and hosts of URLs; segments of a URL's path are runs of their own. known:
    digests and identifiers that are no secrets, or a table whose first column lists them, MOST_KNOWN at most. A null text counts as empty and has no spans; repeated rows give repeated results; an empty table gives
    none; very long texts are scanned whole; further columns are ignored.
    """
    if min_run < LEAST_RUN:
        raise ValueError(f"runs under {LEAST_RUN} characters cannot be told from words")
    if isinstance(known, DataFrame):
        rows = known.select(F.col(known.columns[0]).cast("string")).where(F.col(known.columns[0]).isNotNull()).limit(MOST_KNOWN + 1).collect()
        if len(rows) > MOST_KNOWN:
            raise ValueError(f"at most {MOST_KNOWN} known digests go to the tasks")
        known = [r[0] for r in rows]
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(known))
    runs = re.compile(_RUN % min_run)

    def run(batches):
        encode, listed = byte_bpe(vocabulary).encode_ordinary, shared.value
        for b in batches:
            rows = []
            for _, texts in texts_of(b.column(1)):
                for t in texts:
                    if not t or max(map(len, t.split()), default=0) < min(16, min_run) and ":" not in t and "=" not in t:
                        rows.append([])
                        continue
                    spans = base_spans(t)
                    spans += random_spans(t, encode, listed, max_ratio, spans, runs, min_run)
                    rows.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(spans)])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], ["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), run, f"id {kind}, spans array<struct<kind: string, start: long, end: long>>")


def redact(text: str | None, spans: Iterable[tuple[int, int]], mark: str = "[SECRET]") -> str | None:
    """text with each span replaced; overlapping spans are replaced once."""
    if text is None:
        return None
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts by base kind, the digest of the base spans and the text of all spans."""
    named = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != "random")
    return found.select("id", *[count(k) for k in KINDS], F.sha2(named(base).cast("binary"), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))
