"""PII by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, plus
signs, digits, URL schemes and the words that announce addresses and accounts.
From each anchor a local parser expands to the boundaries of what it announces
and validates it. Texts without anchors cost the pass alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, pieces

#: Kinds in the order in which spans with the same start are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "url", "account", "address")
#: Words that announce an account number, and street words before or after a name.
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "compte", "cuenta", "passport", "ssn")
STREET_AFTER = ("street", "avenue", "road", "lane", "drive", "boulevard", "straße", "strasse")
STREET_BEFORE = ("rue", "calle", "avenida")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*\Z")
_URL = re.compile(r"[^\s<>\"'|]+")
_NUMBER = re.compile(r"[A-Za-z ]{0,12}[:#. ]{1,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[0-9](?:[ -]?[0-9]){5,29})(?![A-Za-z0-9])")
_HOUSE = re.compile(r"[0-9]{1,5}[A-Za-z]?,? (?:[A-ZÀ-Ý][\w'-]*\s){0,4}\Z")
_NAMED = re.compile(r"\s(?:[\w'-]+\s){0,3}?[A-ZÀ-Ý][\w'-]*(?:,? [0-9]{1,5})?")


@cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in [("@", "@"), ("+", "+"), ("://", ":"), *((d, "0") for d in "0123456789")]:
        found.add_word(word, (kind, 1 if kind != ":" else 3))
    for words, kind in ((ACCOUNT_CUES, "account"), (STREET_AFTER, "after"), (STREET_BEFORE, "before")):
        for word in words:
            for form in {word, word.capitalize(), word.upper()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _iban(number: str) -> bool:
    moved = number[4:] + number[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of all personal data in the text, in order."""
    anchors: dict[str, list[int]] = {}
    for last, (kind, size) in _automaton().iter(text):
        anchors.setdefault(kind, []).append(last + 1 - size)
    if not anchors:
        return []
    found: list[tuple[int, int, int]] = []
    end = 0
    for at in anchors.get("@", ()):
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, 0, end := m.end()))
    digits = anchors.get("0", ())
    end = 0
    for at in digits:  # a number's first digit: later ones can't begin a match where the first can't
        if at >= end and not (at > end and "0" <= text[at - 1] <= "9") and (m := _IP.match(text, at)):
            end = m.end()
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                found.append((at, 1, end))
    end = 0
    for at in digits:
        if at >= end and (m := _CARD.match(text, at)):
            end = m.end()
            number = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(number) <= 19 and _luhn(number):
                found.append((at, 2, end))
    end = 0
    for at in anchors.get("+", ()):
        if at >= end and (m := _PHONE.match(text, at)):
            end = m.end()
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append((at, 3, end))
    found += _added(text, anchors)
    return sorted(set(found))


def _added(text: str, anchors: dict[str, list[int]]) -> Iterator[tuple[int, int, int]]:
    for at in anchors.get(":", ()):
        scheme, rest = _SCHEME.search(text, max(0, at - 16), at), _URL.match(text, at + 3)
        if scheme and rest:
            yield scheme.start(), 4, at + 3 + len(rest[0].rstrip(".,;:!?)"))
    for at in anchors.get("account", ()):
        if m := _NUMBER.match(text, at):
            number = m[1].replace(" ", "").replace("-", "")
            if not number[0].isalpha() or 15 <= len(number) <= 34 and _iban(number):
                yield m.start(1), 5, m.end(1)
    for at in anchors.get("after", ()):
        if m := _HOUSE.search(text, max(0, at - 80), at):
            word = re.compile(r"\w+").match(text, at)
            yield m.start(), 6, word.end()
    for at in anchors.get("before", ()):
        if m := re.compile(r"[0-9]{1,5},? \Z").search(text, max(0, at - 8), at):
            word = re.compile(r"\w+").match(text, at)
            if name := _NAMED.match(text, word.end()):
                yield m.start(), 6, name.end()


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
_ARROW = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:4]), ("base_sha256", pa.string()), ("spans", pa.string())])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in pieces(batches):
        rows = []
        for text in texts:
            found = spans(text)
            base = [s for s in found if s[1] < 4]
            count = Counter(s[1] for s in base)
            rows.append((*(count[k] for k in range(4)), sha256(_joined(base).encode()).hexdigest(), _joined(found)))
        yield pa.RecordBatch.from_arrays([ids, *map(pa.array, zip(*rows))], schema=_ARROW)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA for every row: counts of the base kinds, their digest, and all spans.

    Spans count code points, end exclusive. A null or empty text has none. Ids may be
    null or repeat; other columns are ignored. No rows: no rows.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_rows, SCHEMA)


def masked(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with every span, overlaps merged, replaced by its first kind in angle brackets."""
    out, at = [], 0
    for start, kind, end in found:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))


QUERIES = {"op7_pii": op7_pii}
ORACLES: dict[str, str] = {}
