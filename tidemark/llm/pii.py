"""Personal data: patterns propose spans, checksums confirm them, context words adjust scores.

Kinds, in the order in which spans with the same start are listed: email, ip, card (Luhn),
phone, iban (mod 97), ssn, secret (a quoted or assigned hexadecimal or random string). The
first four follow fixed rules and always stay; the others need a score of `least` or more.
A span's score starts from its kind's prior and rises with a word of that kind near it (40
characters before it, 20 after) or falls with a word that speaks against it.

Matching is leftmost and without overlap inside a kind, over the whole text. Patterns start
only where a match can start, and texts without the characters that a kind needs are passed
over, so that plain prose costs one scan.

Defined results: a null or empty text has no spans; repeated rows keep their own rows; no
documents give no rows; further columns stay out of the result; positions are code points,
the end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]
SPANS = "array<struct<kind:string,start:int,end:int,score:double,text:string>>"


def luhn(text: str) -> bool:
    digits = [int(c) for c in reversed(text) if c in "0123456789"]
    return sum(d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(digits)) % 10 == 0


def mod97(text: str) -> bool:
    chars = re.sub(r"[^0-9A-Z]", "", text.upper())
    return int("".join(str(int(c, 36)) for c in chars[4:] + chars[:4])) % 97 == 1


def _digits(text: str) -> int:
    return sum(c in "0123456789" for c in text)


def _real_ssn(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _random_looking(text: str) -> bool:
    """Letters and digits mixed, and many different characters."""
    return any(c.isdigit() for c in text) and any(c.isalpha() for c in text) and len(set(text)) >= 8


@dataclass(frozen=True)
class Kind:
    pattern: re.Pattern
    needs: re.Pattern  # a text without this has no match
    confirm: Callable[[str], bool]
    prior: float
    near: re.Pattern
    against: re.Pattern = re.compile(r"(?!)")


def _words(words: str) -> re.Pattern:
    return re.compile(rf"(?<![a-z])(?:{words})(?![a-z])")


_LOCAL = "A-Za-z0-9._%+-"
SPEC = {
    "email": Kind(re.compile(rf"[{_LOCAL}]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), re.compile("@"), lambda s: True, 0.9, _words("e?-?mail|contact|write|reply|courriel|correo|kontakt")),
    "ip": Kind(re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"), re.compile("[0-9]"), lambda s: all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split(".")), 0.7, _words("ip|host|server|address|login|adresse"), _words("version|release|section|chapter")),
    "card": Kind(re.compile(r"[0-9](?:[ -]?[0-9])+"), re.compile("[0-9]"), lambda s: 12 <= _digits(s) <= 19 and luhn(s), 0.8, _words("card|visa|mastercard|credit|payment|carte|karte|tarjeta"), _words("isbn|serial|order|tracking")),
    "phone": Kind(re.compile(r"\+[0-9][ ().0-9-]+[0-9]"), re.compile(r"\+[0-9]"), lambda s: 9 <= _digits(s) <= 15, 0.8, _words("phone|tel|call|mobile|fax|telefon|teléfono|téléphone")),
    "iban": Kind(re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"), re.compile("[A-Z][A-Z][0-9][0-9]"), mod97, 0.9, _words("iban|account|bank|konto|compte|cuenta")),
    "ssn": Kind(re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), re.compile("[0-9]-[0-9]"), _real_ssn, 0.4, _words("ssn|social security|social")),
    "secret": Kind(re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+={0,2}(?![A-Za-z0-9_/+=-])"), re.compile(r"[A-Za-z0-9_/+-]{20}"), _random_looking, 0.3, _words("token|api[ _-]?key|key|secret|password|passwd|pwd|credential|auth|bearer"), _words("sha1|sha256|md5|checksum|commit|hash|digest")),
}
_ANY = re.compile(r"[0-9@]")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of the e-mail pattern; each "@" is tried from where the run before it starts."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_SET:
            start -= 1
        found = start < at and SPEC["email"].pattern.match(text, start)
        if found:
            yield found.span()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def find_spans(text: str | None, least: float = 0.5, kinds: tuple[str, ...] = KINDS) -> list[tuple[str, int, int, float, str]]:
    """(kind, start, end, score, text) by start, then kind."""
    if not text or not _ANY.search(text):
        return []
    found, lower = [], None
    for order, name in enumerate(kinds):
        kind = SPEC[name]
        if not kind.needs.search(text):
            continue
        for start, end in _emails(text) if name == "email" else (m.span() for m in kind.pattern.finditer(text)):
            if not kind.confirm(text[start:end]):
                continue
            around = (text[max(0, start - 40) : start] + " | " + text[end : end + 20]).lower()
            score = kind.prior + 0.3 * bool(kind.near.search(around)) - 0.3 * bool(kind.against.search(around))
            if name in BASE or score >= least:
                found.append((start, order, name, end, min(1.0, max(0.0, score))))
    return [(name, start, end, score, text[start:end]) for start, _, name, end, score in sorted(found)]


def find_pii(documents: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id and spans: an array of (kind, start, end, score, text)."""

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        names = ("kind", "start", "end", "score", "text")
        return pd.Series([[dict(zip(names, s)) for s in find_spans(t, least)] for t in texts])

    return documents.select("doc_id", spans("text").alias("spans"))


def query(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), *[count(k) for k in KINDS[4:]])
