"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Kinds, in order: email, ip, card, phone (the base kinds, whose confirmed spans always stay),
then iban (mod 97), ssn and secret, which stay if their score reaches ``least``. A card needs
16 to 19 digits that pass Luhn, an address four parts of at most 255, a phone number 8 to 15
digits. Spans are code points, end exclusive; those of one kind do not overlap, spans of
different kinds may. Null text is the empty text (``redacted`` hands null on); a null doc_id stays
null. Rows are looked at one by one, so repeated rows and ids do no harm; without rows the result
is empty. ``scan`` does not look at other columns, ``redacted`` keeps them, whatever their names.
Every search is linear in the text, also over digits or signs without end.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(code: str) -> bool:
    code = code.replace(" ", "").upper()
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _card(s: str) -> bool:
    d = _NOT_DIGIT.sub("", s)
    return 16 <= len(d) <= 19 and luhn(d)


def _ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in s.split("."))


def _phone(s: str) -> bool:
    return 8 <= len(_NOT_DIGIT.sub("", s)) <= 15


def _ssn(s: str) -> bool:
    a, b, c = s.split("-")
    return a not in ("000", "666") and a < "900" and b != "00" and c != "0000"


@dataclass(frozen=True)
class Kind:
    """A kind of span; ``needs``: a character without which the pattern can't match; ``score``: before the words nearby."""

    name: str
    pattern: re.Pattern
    valid: object
    needs: str
    score: float
    words: tuple[str, ...]
    base: bool = False
    group: int = 0


#: An address that fails at the first digit of a run fails at all others, so only run starts are tried.
KINDS = (
    Kind("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), None, "@", 0.9, ("mail", "contact", "write", "correo", "courriel"), True),
    Kind("ip", re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"), _ip, ".", 0.7, ("ip", "host", "server", "address", "login"), True),
    Kind("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), _card, "", 0.8, ("card", "visa", "mastercard", "credit", "karte", "tarjeta", "carte"), True),
    Kind("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), _phone, "+", 0.7, ("phone", "tel", "call", "mobile", "fax", "telefon"), True),
    Kind("iban", re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b"), mod97, "", 0.8, ("iban", "bank", "account", "konto", "cuenta", "compte")),
    Kind("ssn", re.compile(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"), _ssn, "-", 0.4, ("ssn", "social", "security")),
    Kind("secret", re.compile(r"\b(?:token|secret|password|passwd|api_?key|access_?key)\b[\x20\t]*[:=][\x20\t]*[\"']?([A-Za-z0-9+/_=-]{16,})", re.I), None, "", 0.7, ("token", "secret", "key", "password")),
)
_DIGIT = re.compile(r"[0-9]")
_SECRET = re.compile(r"[:=]")


def _hint(text: str, s: int, e: int, words: tuple[str, ...], reach: int) -> bool:
    near = (text[max(0, s - reach) : s] + " " + text[e : e + reach]).lower()
    return any(re.search(rf"\b{w}", near) for w in words)


def find(text: str | None, least: float = 0.6, reach: int = 40) -> list[tuple[int, int, int, float]]:
    """Spans (index of the kind, start, end, score) by kind, then start."""
    out: list[tuple[int, int, int, float]] = []
    if not text:
        return out
    digit = _DIGIT.search(text) is not None
    for k, kind in enumerate(KINDS):
        if kind.name != "email" and not digit and kind.name != "secret":
            continue
        if kind.needs and kind.needs not in text:
            continue
        if kind.name == "secret" and not _SECRET.search(text):
            continue
        if kind.name == "email":
            found = _emails(text, kind.pattern)
        else:
            found = kind.pattern.finditer(text)
        for m in found:
            s, e = m.span(1) if kind.name == "secret" else m.span()
            if kind.valid is not None and not kind.valid(text[s:e]):
                continue
            score = min(1.0, kind.score + 0.2) if _hint(text, s, e, kind.words, reach) else kind.score
            if kind.base or score >= least:
                out.append((k, s, e, round(score, 2)))
    return out


_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")


def _emails(text: str, pattern: re.Pattern) -> Iterator[re.Match]:
    """The matches of finditer, looked for only around the @ signs (the words of a text need no attempts)."""
    at, done = text.find("@"), 0
    while at != -1:
        s = at
        while s > done and (c := text[s - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            s -= 1
        m = pattern.match(text, s) if s < at else None
        if m:
            yield m
            done = m.end()
        at = text.find("@", max(at + 1, done))


def redact(text: str, spans: list[tuple[int, int, int, float]]) -> str:
    """``text`` with each span as [KIND]; overlapping spans become one, named after its first."""
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e, _ in spans):
        if s >= at:
            out.append(text[at:s] + f"[{KINDS[k].name.upper()}]")
        at = max(at, e)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.6) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                rows = []
                for text in part.column(1).to_pylist():
                    spans = find(text, least)
                    said = [f"{KINDS[k].name}:{s}:{e}" for k, s, e, _ in spans]
                    base = [x for x, (k, *_) in zip(said, spans) if KINDS[k].base]
                    n = [sum(k == j for k, *_ in spans) for j in range(4)]
                    rows.append((*n, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(said), ",".join(f"{x[3]:g}" for x in spans)))
                cols = [list(c) for c in zip(*rows)] if rows else [[]] * 7
                kinds = [pa.int64()] * 4 + [pa.string()] * 3
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds)]], names)

    return docs.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string")


def redacted(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", least: float = 0.6) -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by its kind; a length column, if there is one, follows. Null text stays null."""
    at = docs.columns.index(text_col)
    length = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            texts = [t if not (s := find(t, least)) else redact(t, s) for t in b.column(at).to_pylist()]
            cols = list(b.columns)
            cols[at] = pa.array(texts, pa.string())
            if length is not None:
                cols[length] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(b.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    return docs.mapInArrow(run, docs.schema)
