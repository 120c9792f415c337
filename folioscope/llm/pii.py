"""Personal data: regular expressions propose spans, checksums confirm them, context adjusts the score.

Base kinds are email, ip, card (16 to 19 digits that pass Luhn) and phone. The method adds iban
(mod-97) and short cards (13 to 15 digits that pass Luhn, with a context word near). Spans are
in code points, the end exclusive; matches of one kind do not overlap.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import text_slices

KINDS = ("email", "ip", "card", "phone")  # base kinds in their order
EXTRA = ("iban", "short_card")
NEAR = 40  # characters on either side that context words are sought in
# Context words of each kind, and what is added to the score for one of them.
CONTEXT = {
    "email": "mail|email|e-mail|contact|write|correo|courriel|adresse",
    "ip": "ip|host|server|address|addr|login|client|adresse",
    "card": "card|visa|mastercard|credit|debit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|sms|telefon|téléphone|teléfono",
    "iban": "iban|account|bank|transfer|konto|compte|cuenta",
    "short_card": "card|visa|amex|credit|payment|karte|carte|tarjeta",
}
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.85, "phone": 0.6, "iban": 0.9, "short_card": 0.4}
BONUS = 0.1
_CONTEXT = {k: re.compile(rf"(?<![^\W_])(?:{v})(?![^\W_])", re.I) for k, v in CONTEXT.items()}

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_RUN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Checksum of an international account number without spaces."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address pattern, found from their @ signs.

    The part before a sign is the longest run of its characters that starts after the last match;
    so a long run without a sign is never looked at twice.
    """
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _RUN:
            start -= 1
        free_next = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free_next = m.end()
        # Characters before this sign cannot start a later match: the sign stands between.
        free = free_next
        at = text.find("@", free)
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(q := p.lstrip("0")) < 4 and int(q or 0) < 256 for p in m[0].split("."))]


def _digits(found: str) -> str:
    return "".join(c for c in found if "0" <= c <= "9")


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind, then start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS + EXTRA}
    if "@" in text:
        found["email"] = emails(text)
    if "." in text:
        found["ip"] = _ips(text)
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 13:
            continue
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found["card" if len(digits) > 15 else "short_card"].append(m.span())
    if "+" in text:
        found["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    for m in _IBAN.finditer(text):
        # Groups of letters after the number may be words; the checksum decides where it ends.
        parts = m[0].split(" ")
        for n in range(len(parts), 0, -1):
            own = "".join(parts[:n])
            if 15 <= len(own) <= 34 and mod97(own):
                found["iban"].append((m.start(), m.start() + len(" ".join(parts[:n]))))
                break
    out = []
    for kind, places in found.items():
        for start, end in places:
            near = text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]
            context = bool(_CONTEXT[kind].search(near))
            if kind == "short_card" and not context:
                continue
            out.append((kind, start, end, min(1.0, SCORES[kind] + BONUS * context)))
    return out


def mask(text: str, least: float = 0.5) -> str:
    """``text`` with the spans of at least that score replaced by their kind in angle brackets.

    Overlapping spans are replaced together, under the kind of the first.
    """
    out, at = [], 0
    for kind, start, end, score in sorted(spans(text), key=lambda s: (s[1], -s[2])):
        if score < least or end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = end
    return "".join(out) + text[at:]


def _joined(found: list[tuple[str, int, int, float]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in found)


_SUSPECT = r"@|[0-9]"


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores), a row for each row.

    A null text counts as empty. Texts without a digit or an @ are passed over without a search.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            suspect = pc.match_substring_regex(texts, _SUSPECT).to_pylist()
            counts, sha, joined, scored = [], [], [], []
            for text, look in zip(texts.to_pylist(), suspect, strict=True):
                found = spans(text) if look else []
                base = [s for s in found if s[0] in KINDS]
                counts.append([sum(s[0] == k for s in base) for k in KINDS])
                sha.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                joined.append(_joined(found))
                scored.append(",".join(f"{s[3]:.2f}" for s in found))
            columns = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, pa.array(sha), pa.array(joined), pa.array(scored)],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "scores"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string"
    return rows.mapInArrow(run, schema)


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` masked; null texts stay null."""

    @F.arrow_udf("string")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            suspect = pc.match_substring_regex(part, _SUSPECT).to_pylist()
            rows = zip(part.to_pylist(), suspect, strict=True)
            yield pa.array([mask(t) if look else t for t, look in rows], pa.string())

    return docs.withColumn("text", run("text"))
