"""Personal data in whole texts: patterns propose spans, checksums confirm
them, words nearby adjust their score.

Four kinds are reported wherever their pattern and check hold, whatever the
score (``base``): mail addresses, IPv4 addresses, card numbers (Luhn) and
international phone numbers.  Further spans count only from a score of
``min_score`` on: IBANs (mod 97), French and Spanish identity numbers (mod 97,
mod 23), US social security numbers, and card numbers found among the groups
of a longer run of digits.

Every pattern starts at a fixed kind of place (the start of a run, an "@" or a
"+") and cannot match a run twice, so a scan is linear in the text's length
however periodic the text is.  Texts without a digit and an "@" are passed over
by a byte test of the whole batch.  One scan, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, prepare, utf8_buffers

BATCH = 4 << 20
MIN_SCORE = 0.6
BEFORE, AFTER = 40, 20
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "nir", "dni", "ssn")

# Word beginnings that speak for a kind when they stand nearby.
CONTEXT = {
    "email": ("mail", "contact", "kontakt", "correo", "courriel", "write"),
    "ip": ("ip", "address", "host", "server", "client"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "tel", "call", "mobil", "fax", "cell", "movil", "handy"),
    "iban": ("iban", "bank", "konto", "account", "compte", "cuenta", "transfer"),
    "nir": ("nir", "insee", "social", "assur", "vitale"),
    "dni": ("dni", "nif", "nie", "identidad", "documento"),
    "ssn": ("ssn", "social", "security"),
}
# Word beginnings that speak against any kind.
AGAINST = ("example", "sample", "test", "dummy", "version", "isbn", "order", "serial")
# What a confirmed span of a kind scores without a word nearby.
SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "nir": 0.4, "dni": 0.4, "ssn": 0.4}
FOR_WORD, AGAINST_WORD = 0.3, -0.3
# Lengths of IBANs by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "BR": 29, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20,
    "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GI": 23, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24,
    "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
# Fixed value: the letter of a Spanish number by its remainder of 23.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_DIGITS = re.compile(r"(?<![0-9])[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_EDGE, _END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
_IBAN_HEAD = re.compile(_EDGE + r"[A-Z]{2}[0-9]{2}")
_IBAN = {n: re.compile(rf"[A-Z]{{2}}[0-9]{{2}}(?: ?[0-9A-Z]){{{n - 4}}}" + _END) for n in sorted(set(IBAN_LENGTHS.values()))}
_NIR = re.compile(_EDGE + r"[12] ?[0-9]{2} ?(?:0[1-9]|1[0-2]) ?[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}" + _END)
_DNI = re.compile(_EDGE + r"(?:[0-9]{8}|[XYZ]-?[0-9]{7})-?[A-Z]" + _END)
_SSN = re.compile(_EDGE + r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}" + _END)
_GROUP = re.compile(r"[0-9]+")
_SHAPES = {(4, 4, 4, 4), (4, 6, 5), (4, 4, 4, 4, 3), *((n,) for n in range(13, 20))}
_WORDS = {k: re.compile(rf"(?:^|[^a-z])(?:{'|'.join(v)})") for k, v in {**CONTEXT, "": AGAINST}.items()}
_LOWER = {c: c + 32 for c in range(65, 91)}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    base: bool
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod_97(iban: str) -> int:
    """Remainder of an IBAN without blanks: 1 if it is right."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses around each "@", the local part reaching back to the previous match."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            floor = m.end()
        at = text.find("@", max(at + 1, floor))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(g := p.lstrip("0")) < 4 and int(g or 0) <= 255 for p in m.groups()):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole run): runs of 13 to 19 digits that pass Luhn and,
    among the groups of other runs, the first groups of a card's shape."""
    for m in _DIGITS.finditer(text):
        a, b = m.span()
        if b - a <= 2 * 19 and 13 <= len(d := re.sub(r"[ -]", "", m[0])) <= 19 and luhn(d):
            yield a, b, True
            continue
        groups = [g.span() for g in _GROUP.finditer(text, a, b)]
        i = 0
        while len(groups) > 1 and i < len(groups):
            for n in range(1, 6):
                own = groups[i:i + n]
                if len(own) == n and tuple(e - s for s, e in own) in _SHAPES and luhn("".join(text[s:e] for s, e in own)):
                    yield own[0][0], own[-1][1], False
                    i += n - 1
                    break
            i += 1


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    floor = 0
    for head in _IBAN_HEAD.finditer(text):
        n = IBAN_LENGTHS.get(head[0][:2])
        m = _IBAN[n].match(text, head.start()) if n and head.start() >= floor else None
        if m and mod_97(m[0].replace(" ", "")) == 1:
            floor = m.end()
            yield m.span()


def french_numbers(text: str) -> Iterator[tuple[int, int]]:
    for m in _NIR.finditer(text):
        d = m[0].replace(" ", "")
        if 97 - int(d[:13]) % 97 == int(d[13:]):
            yield m.span()


def spanish_numbers(text: str) -> Iterator[tuple[int, int]]:
    for m in _DNI.finditer(text):
        d = m[0].replace("-", "")
        if DNI_LETTERS[int(d[:-1].translate({88: "0", 89: "1", 90: "2"})) % 23] == d[-1]:
            yield m.span()


def social_security_numbers(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        yield m.span()


_FINDERS = {"email": emails, "ip": addresses, "phone": phones, "iban": ibans, "nir": french_numbers, "dni": spanish_numbers,
            "ssn": social_security_numbers}


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's score, raised by a word for it and lowered by a word against
    it within BEFORE characters ahead of the span or AFTER behind it."""
    near = [text[max(0, start - BEFORE):start].translate(_LOWER), text[end:end + AFTER].translate(_LOWER)]
    s = SCORE[kind]
    s += FOR_WORD * any(_WORDS[kind].search(x) for x in near) + AGAINST_WORD * any(_WORDS[""].search(x) for x in near)
    return round(min(1.0, max(0.0, s)), 2)


def text_spans(text: str, min_score: float = MIN_SCORE) -> list[Span]:
    """All spans of a text by kind as in KINDS, then by start."""
    out = []
    for kind in KINDS:
        found = cards(text) if kind == "card" else ((a, b, kind in BASE) for a, b in _FINDERS[kind](text))
        for a, b, base in found:
            s = score(text, kind, a, b)
            if base or s >= min_score:
                out.append(Span(kind, a, b, base, s))
    return out


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """One row per row of ``docs``: its id and ``spans``, an array of
    struct<kind, start, end, base, score> in code points, the end exclusive,
    by kind as in KINDS, then by start.

    Null and empty texts have no spans; texts of any length are searched
    whole; null and repeated ids and repeated rows stay rows of their own; an
    empty table gives no rows.  Spans of different kinds may overlap; within a
    kind they do not.  Columns that are not named are not read."""
    return _scan(docs, id_col, text_col, min_score, None)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """As ``personal_data``, with ``redacted``: the text with every span as
    its kind in angle brackets (where spans overlap, the first one's from its
    start to the last one's end); a null text stays null."""
    return _scan(docs, id_col, text_col, min_score, "redacted")


def _redacted(text: str, spans: list[Span]) -> str:
    out, done = [], 0
    for x in sorted(spans, key=lambda x: (x.start, x.end)):
        if x.start >= done:
            out += [text[done:x.start], f"<{x.kind}>"]
        done = max(done, x.end)
    return "".join([*out, text[done:]])


def _scan(docs: DataFrame, id_col: str, text_col: str, min_score: float, as_text: str | None) -> DataFrame:
    prepare(docs.sparkSession)
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 1, BATCH):
            data, off = utf8_buffers(b.column(1))
            spot = np.flatnonzero(((data >= 48) & (data <= 57)) | (data == 64))
            seen = np.searchsorted(spot, off[1:]) > np.searchsorted(spot, off[:-1])
            spans: list[list] = [[] for _ in range(b.num_rows)]
            texts = b.column(1).to_pylist() if as_text else None
            for i in np.flatnonzero(seen).tolist():
                text = texts[i] if as_text else b.column(1)[i].as_py()
                spans[i] = text_spans(text, min_score)
                if as_text:
                    texts[i] = _redacted(text, spans[i])
            cols = [b.column(0), pa.array([[x._asdict() for x in s] for s in spans], struct)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string())] if as_text else cols,
                                             names=["id", "spans", "redacted"] if as_text else ["id", "spans"])

    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, "
                         "spans array<struct<kind:string,start:long,end:long,base:boolean,score:double>>"
                         + (", redacted string" if as_text else ""))
    return out.withColumnRenamed("id", id_col)


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    one = F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    return F.array_join(one, ",")
