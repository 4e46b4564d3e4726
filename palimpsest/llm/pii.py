"""Personal data in whole texts: patterns propose spans, checksums confirm them, words nearby adjust the score.

Base kinds, leftmost and not overlapping within a kind; a match that fails its rule is dropped and not tried again:
email; ip (four parts, each at most 255); card (16 to 19 digits, Luhn); phone (+, 8 to 15 digits). Base spans stay
whatever their score. Further kinds need a score of `threshold`: iban (country's length, mod-97), ssn (3-2-4 digits with
valid parts), tel (3-3-4 digits), card13 (13 to 15 digits with a known issuer prefix and Luhn), key (access-key ids) and
secret (a long value assigned to a name such as password or token). A candidate starts at its kind's score, gains for a checksum and for a
context word of its kind within `reach` characters, and loses for a word that speaks against it (version, order, ISBN).

Patterns are written so that a failing start is left at once: starts inside a run of the same class are ruled out by a
look-behind and runs are possessive, so a pass over a text of any length takes linear time; what overlaps a base span is
looked up in their sorted union.

Defined cases: null text is empty and has no spans. Offsets are code points, the end is exclusive. Very long texts are read
whole; a row's result hangs on its text alone, so rows may repeat and ids may be null. Empty tables give no rows. Other
columns pass by under any name; one named `to` is replaced.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.runtime import ship

BASE = ("email", "ip", "card", "phone")
MORE = ("card13", "iban", "ssn", "tel")
CREDENTIALS = ("key", "secret")
KINDS = BASE + MORE + CREDENTIALS

_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_TEL = re.compile(r"(?<![0-9+.(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9]|[.-][0-9])")
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?i)(?<![a-z0-9])(?:password|passwd|secret|token|api[_-]?key)[\x20\t]*[=:][\x20\t]*[\"']?([A-Za-z0-9+/_-]{12,}+)")

#: Characters of a whole number, by country, as in the registry.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
#: The rest of a number after its four characters: single blanks may stand between, no letter or digit directly after.
_IBAN_REST = {c: re.compile(rf"(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for c, n in IBAN_LENGTH.items()}
FOR = {
    "email": ("mail", "contact", "write", "e-mail", "correo", "adresse"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "card13": ("card", "visa", "amex", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
    "tel": ("phone", "call", "tel", "mobile", "fax", "cell"),
    "key": ("key", "access", "aws"),
    "secret": ("secret", "login", "credential"),
}
AGAINST = ("version", "isbn", "issn", "order", "invoice", "serial", "part")
START = {"email": 0.9, "ip": 0.6, "card": 0.5, "phone": 0.6, "card13": 0.3, "iban": 0.4, "key": 0.8, "secret": 0.8, "ssn": 0.4, "tel": 0.4}
CHECKED = {"card": 0.4, "card13": 0.3, "iban": 0.5}
GAIN, LOSS, REACH, THRESHOLD = 0.3, 0.3, 40, 0.7


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    rest = 0
    for c in iban[4:] + iban[:4]:
        rest = int(f"{rest}{int(c, 36)}") % 97
    return rest == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    for m in _AT.finditer(text):
        at = i = m.start()
        while i > last and text[i - 1] in _LOCAL:
            i -= 1
        if i < at:
            yield i, m.end()
            last = m.end()


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    if "@" in text:
        for a, b in emails(text):
            yield "email", a, b
    if not _FIRST_DIGIT.search(text):
        return
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
                yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end()


_FIRST_DIGIT = re.compile("[0-9]")


def more_candidates(text: str, credentials: bool = True) -> Iterator[tuple[str, int, int, bool]]:
    """kind, start, end, whether a checksum confirmed it; candidates that their rule refutes don't come."""
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 15 and luhn(d) and (d[:2] in ("34", "37", "36", "38") or d[0] == "4"):
            yield "card13", m.start(), m.end(), True
    for m in _IBAN.finditer(text):
        rest = (r := _IBAN_REST.get(m[0][:2])) and r.match(text, m.end())
        if rest and mod97((m[0] + rest[0]).replace(" ", "")):
            yield "iban", m.start(), rest.end(), True
    if "-" in text:
        for m in _SSN.finditer(text):
            a, b, c = m[0].split("-")
            if a not in ("000", "666") and a[0] != "9" and b != "00" and c != "0000":
                yield "ssn", m.start(), m.end(), False
    for m in _TEL.finditer(text):
        yield "tel", m.start(), m.end(), False
    if not credentials:
        return
    for m in _KEY.finditer(text):
        yield "key", m.start(), m.end(), False
    if "=" in text or ":" in text:
        for m in _SECRET.finditer(text):
            if _FIRST_DIGIT.search(m[1]):
                yield "secret", m.start(1), m.end(1), False


def score(text: str, kind: str, a: int, b: int, checked: bool, reach: int = REACH) -> float:
    near = set(re.findall(r"[a-z]+(?:-[a-z]+)?", (text[max(0, a - reach) : a] + " " + text[b : b + reach]).lower()))
    s = START[kind] + (CHECKED.get(kind, 0) if checked else 0)
    return round(max(0.0, min(1.0, s + GAIN * bool(near & set(FOR[kind])) - LOSS * bool(near & set(AGAINST)))), 4)


def union(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def find(text: str | None, threshold: float = THRESHOLD, credentials: bool = True) -> list[tuple[str, int, int, float]]:
    """kind, start, end, score; by kind as listed, then start."""
    if not text:
        return []
    out = [(k, a, b, score(text, k, a, b, k == "card")) for k, a, b in base_spans(text)]
    if _FIRST_DIGIT.search(text):
        starts, ends = union([(a, b) for _, a, b, _ in out])
        # The stretch that ends first after a is the only one that could begin before b and overlap.
        free = lambda a, b: (i := bisect.bisect_right(ends, a)) == len(ends) or starts[i] >= b
        for k, a, b, ok in more_candidates(text, credentials):
            s = score(text, k, a, b, ok)
            if s >= threshold and free(a, b):
                out.append((k, a, b, s))
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1]))


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def with_spans(docs: DataFrame, text: str = "text", to: str = "pii", threshold: float = THRESHOLD, credentials: bool = True) -> DataFrame:
    """docs and a column `to` of all spans. No shuffle."""
    ship(docs.sparkSession)

    @F.pandas_udf(SPANS)
    def spans(s: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": a, "end": b, "score": x} for k, a, b, x in find(t, threshold, credentials)] for t in s])

    return docs.withColumn(to, spans(F.col(text)))


def redact(docs: DataFrame, text: str = "text", to: str = "text", credentials: bool = True) -> DataFrame:
    """docs with spans replaced by [KIND]; of spans that overlap the first, then the longest, names the whole stretch."""
    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def cut(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            out, at = [], 0
            for k, a, b, _ in sorted(find(t, credentials=credentials), key=lambda x: (x[1], -x[2])):
                if a >= at:
                    out += [t[at:a], f"[{k.upper()}]"]
                at = max(at, b)
            return t if not out else "".join(out) + t[at:]

        return pd.Series([one(t) for t in s])

    return docs.withColumn(to, cut(F.col(text)))


def query(spark, sf_dir: str) -> DataFrame:
    docs = with_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
    count = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long")
    join = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("pii", lambda x: x["kind"].isin(*BASE))
    return docs.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(join(base), 256).alias("base_sha256"), join(F.col("pii")).alias("spans"), *[count(k).alias(f"n_{k}") for k in MORE + CREDENTIALS]
    )
