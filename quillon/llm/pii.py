"""Personal data: patterns for four kinds, and a conditional random field for what patterns can't tell (operator 1).

email, ip, card and phone come from fixed patterns and checks. A linear-chain CRF over word-shape features adds the
kinds name, natid, iban and local_phone, whose shapes are ambiguous and need their context. It is trained from a small
labelled table, (text) with spans marked [kind text]: that of labelled.py or another. A document is cut into
sentences of blank-separated tokens; all sentences of a batch are decoded together.

Defined cases: null or empty text has no spans; matches that fail their check are dropped without another try;
repeated rows are scanned each; a CRF span that overlaps a base span is dropped; an empty table gives none; a
sentence of any length is decoded whole.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, per_text, prepare
from .crf import TRIM_LEFT, TRIM_RIGHT, Crf
from .labelled import sentences

BASE = ("email", "ip", "card", "phone")
ADDED = ("name", "natid", "iban", "local_phone")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Rows of the labelled table that are trained on, at most.
LABELLED_ROWS = 5000
TOKEN = re.compile(r"\S+")
DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    values = [ord(c) - 48 for c in reversed(digits)]
    return (sum(values[::2]) + sum(DOUBLED[v] for v in values[1::2])) % 10 == 0


def emails(text: str) -> Iterable[Span]:
    """As the whole pattern would match: the local part reaches left over its class, though not into the match before."""
    end = 0
    for m in AT.finditer(text):
        s = m.start()
        while s > end and text[s - 1] in LOCAL:
            s -= 1
        if s < m.start():
            end = m.end()
            yield ("email", s, end)


def base_spans(text: str) -> list[Span]:
    """By kind in the order of BASE, then by start."""
    out = list(emails(text))
    # an octet is at most 255; leading zeros don't count. A match starts where its digits do, as one that fails there fails inside too
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


# -- the labelled table ----------------------------------------------------------------------------------------------
MARKED = re.compile(r"\[(\w+) ([^\]]+)\]")


def parse(marked: str) -> tuple[list[str], list[str]]:
    """Tokens and their B-/I-/O tags."""
    tokens: list[str] = []
    tags: list[str] = []
    at = 0
    text, spans = "", []
    for m in MARKED.finditer(marked):
        text += marked[at : m.start()]
        spans.append((m[1], len(text), len(text) + len(m[2])))
        text += m[2]
        at = m.end()
    text += marked[at:]
    for m in TOKEN.finditer(text):
        kind = next(((k, s) for k, s, e in spans if m.start() < e and m.end() > s), None)
        tokens.append(m[0])
        tags.append("O" if kind is None else ("B-" if m.start() <= kind[1] else "I-") + kind[0])
    return tokens, tags


@functools.lru_cache(maxsize=4)
def train(table: tuple[str, ...] | None = None) -> Crf:
    """Deterministic, whatever the order of the rows; a hundred sentences take about a second. None: the default table."""
    rows = [parse(x) for x in sorted(table if table is not None else sentences()) if x.strip()]
    rows = rows or [(["."], ["O"])]
    kinds = sorted({t[2:] for _, tags in rows for t in tags if t != "O"}) or ["none"]
    return Crf(["O", *(f"{p}-{k}" for k in kinds for p in "BI")]).fit([t for t, _ in rows], [y for _, y in rows])


#: By labelled table the codes of tokens that this Python worker has met; a Tagger bounds its own.
_KNOWN: dict[str, dict[str, int]] = {}


class Tagger:
    """The CRF with a memory of the ids of known tokens, bounded by MEMORY entries."""

    MEMORY = 400_000

    def __init__(self, crf: Crf):
        self.crf = crf
        key = hashlib.sha256(b"".join(x.tobytes() for x in crf.weights)).hexdigest()
        self.known = _KNOWN.setdefault(key, {})

    def __getstate__(self):
        return self.crf

    def __setstate__(self, crf):
        self.__init__(crf)

    def code(self, token: str) -> int:
        """shape id, word id and whether a sentence ends here, in one number."""
        s, w = self.crf.ids(token)
        c = (s << 33) | (w << 1) | (token[-1] in ".!?" and not (len(token) == 2 and token[0].isupper()) and token.lower() not in ("mr.", "mrs.", "ms.", "dr.", "prof.", "tel.", "no."))
        if len(self.known) >= self.MEMORY:
            self.known.clear()
        self.known[token] = c
        return c

    def spans(self, texts: list[str]) -> list[list[Span]]:
        """For each text the CRF's spans."""
        found: list[list[Span]] = [[] for _ in texts]
        known, code = self.known, self.code
        per = [[known[w] if w in known else code(w) for w in t.split()] for t in texts]
        sizes = np.array([len(p) for p in per])
        if not sizes.sum():
            return found
        codes = np.concatenate([np.array(p, dtype=np.int64) for p in per])
        begin = np.cumsum(sizes) - sizes
        first = np.zeros(len(codes), dtype=bool)
        first[1:] = (codes[:-1] & 1) == 1
        first[begin[sizes > 0]] = True
        s, w = codes >> 33, (codes >> 1) & 0xFFFFFFFF
        starts = np.nonzero(first)[0]
        lengths = np.diff(np.append(starts, len(codes)))
        pick = np.nonzero(self.crf.doubtful(s, w, first))[0]
        if not len(pick):
            return found
        inner = np.cumsum(lengths[pick]) - lengths[pick]
        rows = np.repeat(starts[pick] - inner, lengths[pick]) + np.arange(lengths[pick].sum())
        y = self.crf.viterbi(self.crf.emissions(s[rows], w[rows], first[rows]), lengths[pick])
        hit = np.nonzero(y)[0]
        if not len(hit):
            return found
        heads = set(starts[pick].tolist())
        marks: dict[int, list[tuple[int, int]]] = {}
        for at, tag in zip(rows[hit].tolist(), y[hit].tolist()):
            d = int(np.searchsorted(begin, at, side="right")) - 1
            while sizes[d] == 0:  # empty texts share their begin with the next
                d -= 1
            marks.setdefault(d, []).append((at, tag))
        for d, tagged in marks.items():
            places = [m.span() for m in TOKEN.finditer(texts[d])]
            if len(places) != sizes[d]:  # pragma: no cover - both split at the same blanks
                raise AssertionError("tokens differ")
            run: list[int] = []
            kind = ""
            for at, tag in [*tagged, (-9, 0)]:
                label = self.crf.labels[tag] if tag else "O"
                if run and not (label == f"I-{kind}" and at == run[-1] + 1 and at not in heads):
                    a, b = places[run[0] - int(begin[d])][0], places[run[-1] - int(begin[d])][1]
                    t = texts[d]
                    while a < b and t[b - 1] in TRIM_RIGHT:
                        b -= 1
                    while a < b and t[a] in TRIM_LEFT and not (t[a] == "(" and ")" in t[a:b]):
                        a += 1
                    if a < b:
                        found[d].append((kind, a, b))
                    run = []
                if tag:
                    if not run:
                        kind = label[2:]
                    run.append(at)
        return found


def joined(spans: list[Span]) -> str:
    order = {k: i for i, k in enumerate(BASE + ADDED)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda s: (order.get(s[0], 99), s[0], s[1])))


def all_spans(texts: list[str], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and added ones of each text."""
    out = []
    for text, extra in zip(texts, tagger.spans(texts)):
        base = base_spans(text)
        out.append((base, [x for x in extra if not any(x[1] < e and s < x[2] for _, s, e in base)]))
    return out


def personal_data(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, the hash of the base spans, all spans.

    labelled: (text) with marked spans. Of more than LABELLED_ROWS rows those of the smallest hash are trained on; null
    and empty ones aren't used, and a table without a mark adds no spans.
    """
    prepare(docs.sparkSession)
    rows = labelled.select("text").dropna().orderBy(F.xxhash64("text"), "text").limit(LABELLED_ROWS).collect()
    tagger = Tagger(train(tuple(r.text for r in rows)))

    def run(texts: list[str]) -> list[list]:
        columns: list[list] = [[] for _ in range(7)]
        for base, added in all_spans(texts, tagger):
            n = Counter(s[0] for s in base)
            row = (*(n[k] for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added))
            for c, v in zip(columns, row):
                c.append(v)
        return columns

    return per_text(id_text(docs, id_col, text_col), run, SCHEMA)
