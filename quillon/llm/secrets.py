"""Secret scan with multipart credential linking (operator 2).

Base kinds by pattern: assign, access and hex. Beyond them there are weak candidates, too common to report alone:
an access identifier (key ids, client ids, user names), a secret (a random-looking run, a short assigned value) and
an endpoint (URL with a host, connection string, host:port). Parts of different roles are joined when their
intervals lie within REACH characters of each other inside one scope, a block of lines between blank lines. A weak
candidate is reported only in such company: a secret with an identifier or an endpoint that itself stands with an
identifier; an identifier with a secret or an endpoint that itself stands with a secret; an endpoint with a secret that
is reported. Base spans take part as the roles they have.

A scope belongs to one document, so the join runs document by document as a sorted interval join (bisection over
starts and running ends), in O(n log n) for n parts and without a shuffle.

Defined cases: null or empty text has no spans; repeated rows are scanned each; overlapping weak candidates of one
role keep the leftmost, then the longest; one that overlaps a base span gives way to it; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, per_text, prepare

REACH = 400
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "weak_endpoint")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
CUE = re.compile(r"pass|secret|token|api", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of 32 or more can't start inside a run, so the lookbehind only saves attempts.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")

WEAK_ID = re.compile(r"(?i:\b(?:access[_-]?key(?:[_-]?id)?|key[_-]?id|client[_-]?id|account|login|user(?:name)?))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9][A-Za-z0-9@._-]{2,})|\b(?:ASIA|AGPA|AIDA|AROA)[A-Z0-9]{12,}", re.ASCII)
WEAK_SECRET = re.compile(r"(?i:\b(?:pwd|pass|auth|credential|private[_-]?key|signature|key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=!@$%^-]{6,})|(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])", re.ASCII)
WEAK_ENDPOINT = re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://[^\s\"'<>]+|(?i:\b(?:endpoint|host(?:name)?|server|bucket))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9][A-Za-z0-9._-]{2,}(?::[0-9]{2,5})?)|(?<![a-z0-9.-])(?:[a-z0-9-]++\.)++[a-z]{2,}+:[0-9]{2,5}\b", re.ASCII)
BLANK = re.compile(r"\n[\x20\t\r]*\n")
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "weak_endpoint": "endpoint"}

#: How identifiers begin that need no sign after a name.
BARE_ID = ("AKIA", "ASIA", "AGPA", "AIDA", "AROA")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches per kind; a match that fails its length is dropped, without another try."""
    out: list[Span] = []
    if ("=" in text or ":" in text) and CUE.search(text):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def random_looking(value: str) -> bool:
    """Mixed classes and an entropy that prose doesn't reach."""
    classes = sum((any(c.islower() for c in value), any(c.isupper() for c in value), any(c.isdigit() for c in value)))
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    return classes == 3 and entropy >= 3.5


def weak_parts(text: str) -> list[Span]:
    out: list[Span] = []
    # without a sign there are no endpoints and only bare identifiers, and nothing is linked where there is neither
    if not ("=" in text or ":" in text or any(p in text for p in BARE_ID)):
        return out
    for m in WEAK_ID.finditer(text):
        out.append(("weak_id", m.start(), m.end()))
    for m in WEAK_SECRET.finditer(text):
        if m[1] is not None or random_looking(m[0]):
            out.append(("weak_secret", m.start(), m.end()))
    for m in WEAK_ENDPOINT.finditer(text):
        out.append(("weak_endpoint", m.start(), m.end()))
    return out


class Places:
    """Spans of a role, to be asked whether one of them lies near."""

    def __init__(self, spans: list[Span], reach: int):
        self.reach, self.starts = reach, [s[1] for s in spans]
        self.ends = list(accumulate((s[2] for s in spans), max))  # of those that start no later, where the last one ends

    def near(self, span: Span) -> bool:
        i = bisect_right(self.starts, span[2] + self.reach)
        return i > 0 and self.ends[i - 1] >= span[1] - self.reach


def link(text: str, base: list[Span], reach: int = REACH) -> list[Span]:
    """The weak candidates that complementary parts support."""
    weak = weak_parts(text)
    if not weak:
        return []
    taken = sorted((s[1], s[2]) for s in base)
    ends = [e for _, e in taken]
    top = 0
    for i, e in enumerate(ends):  # running maximum, as base spans of different kinds may overlap
        top = ends[i] = max(top, e)
    begins = [s for s, _ in taken]
    free = [s for s in weak if not ((i := bisect_left(begins, s[2]) - 1) >= 0 and ends[i] > s[1])]
    cuts = [m.start() for m in BLANK.finditer(text)]
    scopes: dict[int, list[Span]] = {}
    for s in base + free:
        scopes.setdefault(bisect_right(cuts, s[1]), []).append(s)
    out: list[Span] = []
    for parts in scopes.values():
        roles: dict[str, list[Span]] = {"id": [], "secret": [], "endpoint": []}
        for s in sorted(parts, key=lambda s: (s[1], -s[2])):
            own = roles[ROLE[s[0]]]
            if not own or s[1] >= own[-1][2] or not s[0].startswith("weak"):
                own.append(s)
        if not roles["secret"] or not (roles["id"] or roles["endpoint"]):
            continue
        ids, secrets = Places(roles["id"], reach), Places(roles["secret"], reach)
        id_ends = Places([s for s in roles["endpoint"] if ids.near(s)], reach)
        secret_ends = Places([s for s in roles["endpoint"] if secrets.near(s)], reach)
        sure = [s for s in roles["secret"] if not s[0].startswith("weak") or ids.near(s) or id_ends.near(s)]
        told = Places(sure, reach)
        out += [s for s in roles["id"] if s[0].startswith("weak") and (secrets.near(s) or secret_ends.near(s))]
        out += [s for s in sure if s[0].startswith("weak")]
        out += [s for s in roles["endpoint"] if told.near(s)]
    return out


def scan(text: str | None, reach: int = REACH) -> tuple[list[Span], list[Span]]:
    """Base spans and linked weak ones."""
    text = text or ""
    base = base_spans(text)
    return base, link(text, base, reach)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row per document: counts of the base kinds, the hash of the base spans, all spans."""
    prepare(docs.sparkSession)

    def run(texts: list[str]) -> list[list]:
        columns: list[list] = [[] for _ in range(6)]
        for t in texts:
            base, linked = scan(t, reach)
            n = Counter(s[0] for s in base)
            row = (n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + linked), len(linked))
            for c, v in zip(columns, row):
                c.append(v)
        return columns

    return per_text(id_text(docs, id_col, text_col), run, SCHEMA)


def redact(text: str | None) -> str | None:
    """The text with each found span, or run of overlapping ones, replaced by a mark of its kind."""
    if not text:
        return text
    base, linked = scan(text)
    out, at = [], 0
    for kind, s, e in sorted(base + linked, key=lambda s: (s[1], -s[2])):
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns, with secrets taken out of the text and the length column brought up to date.

    A null or empty text stays as it is; null and repeated ids don't matter; a length of a text that doesn't change
    stays, null or wrong as it may be; without a length column only the text changes; no helper column is added.
    """
    import pyarrow as pa

    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            old = batch.column(text_col).to_pylist()
            new = [redact(t) for t in old]
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns[text_col] = pa.array(new, batch.schema.field(text_col).type)
            if length_col in columns:
                columns[length_col] = pa.array([n if a == b else len(b) for n, a, b in zip(columns[length_col].to_pylist(), old, new)], batch.schema.field(length_col).type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
