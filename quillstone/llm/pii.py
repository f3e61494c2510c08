"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust a score.

Base kinds, leftmost and not overlapping within a kind: email, ip (four parts of at most 255), card (16 to
19 digits passing Luhn) and phone (8 to 15 digits); a match that fails its test is dropped and not
retried. They are always reported, whatever their score. Added kinds are reported from a score of 0.6: iban (the mod-97
check confirms it), short_card (13 to 15 digits passing Luhn), national_id (3-2-4 digits) and secret (32
or more letters and digits of both sorts in a row, as keys and tokens have), of which
the last three have no or a weak checksum and need a context word. A strong checksum or an address's own form gives
0.6, a weak one 0.4, a bare pattern 0.3; a word of the kind's context within 48 characters adds 0.3, a word that
speaks against it takes 0.3.

Scale. One pass over each row, no shuffle, no state; every pattern takes time linear in the text, so a
very long run of digits or letters is no trap.

Defined cases: a null or empty text has no spans; repeated rows each give a row; null ids stay null;
other columns are kept by `redact` and ignored by `find`.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import common
from quillstone.llm.common import batches

KINDS = ("email", "ip", "card", "phone")
ADDED = ("iban", "short_card", "national_id", "secret")
REPORT_FROM = 0.6

# Possessive forms of the contract's patterns: what follows a run can't be part of it, so they match the same.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{32,}+(?![A-Za-z0-9])")
# Words that speak for a kind, and against any.
_FOR = {
    "email": r"e-?mail|mail|contact|write",
    "ip": r"ip|address|host|server|login",
    "card": r"card|visa|mastercard|credit|debit|payment",
    "phone": r"phone|tel|call|mobile|fax|contact",
    "iban": r"iban|account|bank|transfer|konto|compte|cuenta",
    "short_card": r"card|amex|visa|credit|debit|payment",
    "national_id": r"ssn|social|security|national|identity|tax",
    "secret": r"token|secret|password|passwd|bearer|credential|(?:api|access|private)[ _-]?key",
}
_FOR = {k: re.compile(rf"\b(?:{v})\b", re.I) for k, v in _FOR.items()}
_AGAINST = re.compile(r"\b(?:version|isbn|order|invoice|serial|part|example|test)\b", re.I)
_NEAR = 48
#: Scores without context.
BASE_SCORE = {"email": 0.6, "ip": 0.4, "card": 0.6, "phone": 0.3, "iban": 0.6, "short_card": 0.4, "national_id": 0.3, "secret": 0.3}
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    """Does the last digit fit the others, every second one doubled?"""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Is the number that the rearranged IBAN spells 1 modulo 97?"""
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str):
    at, done = text.find("@"), 0
    while at >= 0:
        # A match starts where the run of local characters before the @ does. No run is looked at twice: an @ ends it.
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        tail = _DOMAIN.match(text, at + 1) if start < at else None
        if tail:
            yield start, tail.end()
            done = tail.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in KINDS, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x) <= 9 and int(x) <= 255 or not x.lstrip("0")[3:] and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in _DIGITS.finditer(text):
        if 16 <= m.end() - m.start() <= 40:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def added_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the added kinds whose score reaches REPORT_FROM."""
    found = []
    for m in _IBAN.finditer(text):
        whole = m[0]
        while len(whole) >= 15 and not mod97(whole) and " " in whole:  # words that follow may have been taken in
            whole = whole.rpartition(" ")[0]
        if mod97(whole):
            found.append(("iban", m.start(), m.start() + len(whole)))
    for m in _DIGITS.finditer(text):
        if 13 <= m.end() - m.start() <= 32:
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 15 and luhn(digits) and not text[max(0, m.start() - 1) : m.start()] == "+":
                found.append(("short_card", m.start(), m.end()))
    found += [("national_id", m.start(), m.end()) for m in _NATIONAL.finditer(text)]
    found += [("secret", m.start(), m.end()) for m in _SECRET.finditer(text) if not m[0].isdigit() and not m[0].isalpha()]
    return [s for s in found if context_score(text, *s) >= REPORT_FROM]


def context_score(text: str, kind: str, a: int, b: int) -> float:
    """How sure a span is: its kind's score, more or less what the words near it say."""
    near = text[max(0, a - _NEAR) : a] + " " + text[b : b + _NEAR]
    return round(BASE_SCORE[kind] + 0.3 * bool(_FOR[kind].search(near)) - 0.3 * bool(_AGAINST.search(near)), 1)


def all_spans(text: str) -> list[tuple[str, int, int]]:
    base = base_spans(text)
    order = {k: i for i, k in enumerate((*KINDS, *ADDED))}
    return sorted(base + added_spans(text), key=lambda s: (order[s[0]], s[1])) if _ANY.search(text) else base


_ANY = re.compile(r"[0-9]")


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str) -> str:
    """`text` with each span, overlapping ones together, replaced by the first one's kind in brackets."""
    out, at, last = [], 0, None
    for kind, a, b in sorted(all_spans(text), key=lambda s: (s[1], -s[2])):
        if last and a < at:
            at = max(at, b)
            continue
        out += [text[at:a], f"[{kind.upper()}]"]
        at, last = b, kind
    return "".join([*out, text[at:]]) if last else text


def _find(parts):
    for part in parts:
        rows = {c: [] for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "scores")}
        for text in part.column("text").to_pylist():
            spans = all_spans(text)
            base = [s for s in spans if s[0] in KINDS]
            for k in KINDS:
                rows[f"n_{k}"].append(sum(s[0] == k for s in base))
            rows["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            rows["spans"].append(_joined(spans))
            rows["n_spans"].append(len(spans))
            rows["scores"].append(",".join(str(context_score(text, *s)) for s in spans))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(v, pa.int64() if c[:2] == "n_" else pa.string()) for c, v in rows.items())], ["doc_id", *rows])


def find(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end, comma-joined), n_spans and scores (of the spans, in their order)."""
    batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, scores string")


def _redact(parts):
    for part in parts:
        text = pa.array([t if t is None else redacted(t) for t in part.column("text").to_pylist()], pa.string())
        yield part.set_column(part.schema.get_field_index("text"), "text", text)


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns of `docs`, with found spans in `text` replaced by their kind; null texts stay null."""
    batches(docs.sparkSession)
    return docs.mapInArrow(_redact, docs.schema)


common.ship(__name__)
