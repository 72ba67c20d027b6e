"""Operator 1, secret scans: multipart credential linking by an interval join within scopes.

Base spans (certain enough alone) are always reported. Weak candidates, i.e. account identifiers, opaque secret-like
values and endpoints, say nothing alone: each is reported only when complementary parts start within `scope` code
points of it. The scope never leaves the document, so the join runs inside the task that holds the text, as a sorted
interval lookup (O(n log n), no pairs are made), and the operator needs no shuffle.

Defined cases: null text is an empty text (no spans, the digest of the empty string); equal rows and equal or null ids give
rows of their own; spans with the same start are ordered by kind as in KINDS; a very long text is read whole, in time linear
in its length; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from wayfare.llm.common import map_texts, table

#: Kinds in report order; the first three are the base ones.
KINDS = ("assign", "access", "hex", "identifier", "opaque", "endpoint")
#: Code points between the starts of complementary parts.
SCOPE = 400

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ASSIGN_HINT = re.compile(r"passw|secret|token|api_?key", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_LONG = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+", re.ASCII)
_IDENTIFIER = re.compile(
    r"""\b(?:client_?id|user_?name|user|login|account|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""",
    re.ASCII | re.IGNORECASE,
)
#: Up to three parts may follow the scheme's own name (jdbc:mysql://, postgresql+ssl://); bounded, so that time is linear.
_ENDPOINT = re.compile(
    r"\b(?:https?|ftp|jdbc|postgres|mysql|mongodb|redis|amqp)[a-z]{0,8}(?:[+:][a-z]{1,16}){0,3}://[^\s\"'<>|]{4,}", re.ASCII
)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, leftmost and non-overlapping within a kind."""
    out = []
    if _ASSIGN_HINT.search(text):
        out += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    for run in _LONG.finditer(text):
        out += [(m.start() + run.start(), m.end() + run.start(), "hex") for m in _HEX.finditer(run[0])]
    return out


def _opaque(run: str) -> bool:
    """A mixed run of letters of both cases and digits, as random keys have."""
    return any(c.isdigit() for c in run) and any(c.islower() for c in run) and any(c.isupper() for c in run)


def weak_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(*m.span(), "opaque") for m in _LONG.finditer(text) if _opaque(m[0])]
    if "=" in text or ":" in text:
        out += [(*m.span(), "identifier") for m in _IDENTIFIER.finditer(text)]
    if "://" in text:
        out += [(*m.span(), "endpoint") for m in _ENDPOINT.finditer(text)]
    return out


#: What each weak kind must meet within its scope: a part of every listed group.
_NEEDS = {
    "identifier": (("assign", "hex", "opaque"),),
    "opaque": (("access", "identifier", "endpoint"),),
    "endpoint": (("access", "identifier"), ("assign", "hex", "opaque")),
}


def link(base: list[tuple[int, int, str]], weak: list[tuple[int, int, str]], scope: int) -> list[tuple[int, int, str]]:
    """The weak spans with a part of each needed group within scope; spans inside a base span are that span's own."""
    taken = sorted(base)
    starts = np.array([s for s, _, _ in taken])
    ends = np.maximum.accumulate([e for _, e, _ in taken]) if taken else starts

    def covered(s: int) -> bool:
        at = int(np.searchsorted(starts, s, "right"))
        return at > 0 and s < ends[at - 1]

    weak = [w for w in weak if not covered(w[0])]
    at = {k: np.sort([s for s, _, kind in [*base, *weak] if kind == k]) for k in KINDS}

    def near(start: int, kinds: tuple[str, ...]) -> bool:
        return any(
            np.searchsorted(at[k], start + scope, "right") > np.searchsorted(at[k], start - scope) for k in kinds
        )

    return [w for w in weak if all(near(w[0], group) for group in _NEEDS[w[2]])]


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def scan(text: str | None, scope: int = SCOPE) -> tuple:
    text = text or ""
    base = base_spans(text)
    weak = weak_spans(text)
    found = base + (link(base, weak, scope) if weak else [])
    count = [sum(k == kind for _, _, k in base) for kind in KINDS[:3]]
    return (*count, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found))


def masked(text: str | None, mask: str, scope: int = SCOPE) -> str | None:
    """The text with every found span replaced; overlapping spans are replaced together."""
    if not text:
        return text
    base, weak = base_spans(text), weak_spans(text)
    out, at, until = [], 0, -1
    for s, e, _ in sorted(base + (link(base, weak, scope) if weak else [])):
        if s >= until:
            out += [text[at:s], mask]
        at = until = max(until, e)
    return "".join([*out, text[at:]]) if out else text


FIELDS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row for each document: counts and digest of the base spans, and all spans as kind:start:end."""
    return map_texts(docs, id_col, text_col, lambda texts: [scan(t, scope) for t in texts], FIELDS)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
