"""Format-preserving pseudonyms for personal data.

Card, phone, social security and IP numbers, dates, mail addresses and
long hexadecimal secrets are found, validated, and permuted within their format
by a keyed Feistel network: a card stays a card with a right check digit, a date
a date; what is not valid stays.  The permutation depends on the key and the kind
alone, so equal values stay equal across documents, also where a card, a phone number
or a date is written in another form, different ones stay different, and the key's
holder can undo it.

Defined results: a null text stays null with no finding; an empty one stays empty;
every row of a repeated document is treated alike; other columns pass through
untouched (columns that bear the name of an added one are replaced); an empty
table stays empty; a text of any length is searched whole.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkgrid.llm.arrowtext import slices

ROUNDS = 10


def feistel(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of range(size): additive Feistel on two halves, walked until inside."""
    if size < 2:
        return value
    a = max(2, int(size**0.5) + 1 if size < 1 << 52 else 1 << (size.bit_length() + 1) // 2)
    b = -(-size // a)
    rounds = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    sign = -1 if back else 1
    while True:
        left, right = divmod(value, b)
        for r in rounds:
            if r % 2:
                right = (right + sign * _round(key, tweak, r, left)) % b
            else:
                left = (left + sign * _round(key, tweak, r, right)) % a
        value = left * b + right
        if value < size:
            return value


def _round(key: bytes, tweak: str, r: int, half: int) -> int:
    return int.from_bytes(hashlib.shake_256(key + f"|{tweak}|{r}|{half}".encode()).digest(16 + half.bit_length() // 8), "big")


def check_digit(digits: str) -> str:
    """The digit that makes ``digits`` and it a valid card number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 * (d > 9)
    return str(-total % 10)


ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
HEX = ("0123456789abcdef", "0123456789ABCDEF")


def permute(text: str, key: bytes, tweak: str, alphabets: tuple[str, ...] = ALPHABETS, back: bool = False) -> str:
    """Permute the characters of the alphabets within theirs; the others stay."""
    which = [next((a for a in alphabets if c in a), "") for c in text]
    value, size = 0, 1
    for c, a in zip(text, which, strict=True):
        if a:
            value, size = value * len(a) + a.index(c), size * len(a)
    form = tweak + ":" + "".join("x" if a else c for c, a in zip(text, which, strict=True)) + ":" + ",".join(str(len(a)) for a in which if a)
    value = feistel(value, size, key, form, back)
    out = []
    for c, a in zip(reversed(text), reversed(which), strict=True):
        if a:
            value, at = divmod(value, len(a))
            out.append(a[at])
        else:
            out.append(c)
    return "".join(reversed(out))


def _walk(text: str, key: bytes, tweak: str, valid: Callable[[str], bool], back: bool) -> str:
    """Permute until the outcome is valid too: a permutation of the valid values."""
    while True:
        text = permute(text, key, tweak, back=back)
        if valid(text):
            return text


def _card(text: str, key: bytes, back: bool) -> str:
    digits = re.sub(r"\D", "", text)
    body = permute(digits[:-1], key, "card", back=back)
    fresh = iter(body + check_digit(body))
    return "".join(next(fresh) if c.isdigit() else c for c in text)


def _ssn_valid(text: str) -> bool:
    area, group, serial = text[:3], text[4:6], text[7:]
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _ip_valid(text: str) -> bool:
    return all(int(x) < 256 for x in text.split("."))


def _ip(text: str, key: bytes, back: bool) -> str:
    value = 0
    for x in text.split("."):
        value = value << 8 | int(x)
    value = feistel(value, 1 << 32, key, "ip", back)
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


#: Date forms, as the groups' meaning and the pattern of the form.
DATE_FORMS = {
    "iso": ("ymd", re.compile(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})")),
    "tail": ("dmy", re.compile(r"(\d{1,2})([-/.])(\d{1,2})\2(\d{4})")),
}
DAYS = datetime.date.max.toordinal()


def _date_parts(text: str) -> tuple[str, str, datetime.date] | None:
    """Form, separator and day of a valid date; before a year a first number above 12 is the day, else the month.

    Where the day or month has one digit the form bears the digits of both.
    """
    for name, (_, form) in DATE_FORMS.items():
        if m := form.fullmatch(text):
            y, a, b = (m[1], m[3], m[4]) if name == "iso" else (m[4], m[1], m[3])
            day_first = name == "tail" and int(a) > 12
            month, day = (b, a) if day_first else (a, b)
            try:
                digits = "" if len(a) == len(b) == 2 else f"{len(a)}{len(b)}"
                return (name if name == "iso" else "dmy" if day_first else "mdy") + digits, m[2], datetime.date(int(y), int(month), int(day))
            except ValueError:
                return None
    return None


def _writable(day: datetime.date) -> tuple[bool, bool, bool]:
    """What decides in which forms a date can be written: days or months of one digit, days that no month has as its number."""
    return day.month > 9, day.day > 9, day.day > 12


@lru_cache(1 << 14)
def _other_day(day: datetime.date, key: bytes, back: bool) -> datetime.date:
    """The date's pseudonym, one that can be written in the same forms: a permutation of such dates."""
    ordinal = day.toordinal() - 1
    while True:
        ordinal = feistel(ordinal, DAYS, key, "date", back)
        other = datetime.date.fromordinal(ordinal + 1)
        if _writable(other) == _writable(day):
            return other


def _date(text: str, key: bytes, back: bool) -> str:
    """The form stays; what it is filled with depends on the date alone, so one date's spellings stay linked."""
    form, sep, day = _date_parts(text)  # type: ignore[misc]
    day = _other_day(day, key, back)
    first, second = (day.day, day.month) if form.startswith("dmy") else (day.month, day.day)
    pair = [f"{v:0{w}}" for v, w in zip((first, second), (int(w) for w in form[3:] or "22"), strict=True)]
    return sep.join([f"{day.year:04}", *pair] if form.startswith("iso") else [*pair, f"{day.year:04}"])


def _luhn(text: str) -> bool:
    digits = re.sub(r"\D", "", text)
    return check_digit(digits[:-1]) == digits[-1]


def _cards(run: str) -> Iterator[tuple[int, int]]:
    """Valid numbers of 13 to 19 digits in a run of digits, which begin and end at the edges of its groups.

    They may overlap; the longest come first, to be taken where nothing else is found.
    """
    groups = [m.span() for m in re.finditer(r"\d+", run)]
    found = []
    for i, (a, _) in enumerate(groups):
        digits = 0
        for begin, b in groups[i:]:
            digits += b - begin
            if digits > 19:
                break
            if digits >= 13 and _luhn(run[a:b]):
                found.append((-digits, a, b))
    for _, a, b in sorted(found):
        yield a, b


KINDS: dict[str, tuple[str, Callable[[str], bool], Callable[[str, bytes, bool], str]]] = {
    "email": (r"(?<![\w.%+-])[\w.%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", lambda t: True, lambda t, k, b: permute(t.partition("@")[0], k, "email:" + t.partition("@")[2].lower(), back=b) + "@" + t.partition("@")[2]),
    "secret": (r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9])", lambda t: bool(re.search("[A-Fa-f]", t) and re.search("[0-9]", t)), lambda t, k, b: permute(t, k, "secret", (HEX[t.upper() == t],), b)),
    "ip": (r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)", _ip_valid, _ip),
    "date": (r"(?<!\d)(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?!\d)", lambda t: _date_parts(t) is not None, _date),
    "ssn": (r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", _ssn_valid, lambda t, k, b: _walk(t, k, "ssn", _ssn_valid, b)),
    "phone": (r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|(?<![\d+])\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\d+])\+\d(?:[ .()-]{0,2}\d){7,14}(?!\d)", lambda t: True, lambda t, k, b: _phone(t, k, b)),
    # A run of digits, in which ``_cards`` looks for numbers.
    "card": (r"(?<![\d-])\d(?:[ -]?\d){12,}(?![\d-])", _luhn, _card),
}


def _phone(text: str, key: bytes, back: bool) -> str:
    """Country code and punctuation stay, the digits of the national number are permuted: its spellings stay linked."""
    code = re.match(r"\+\d{1,3}[ .-]?(?=[(\d])", text)
    at = code.end() if code else 0
    fresh = iter(permute(re.sub(r"\D", "", text[at:]), key, "phone", back=back))
    return text[:at] + "".join(next(fresh) if c.isdigit() else c for c in text[at:])


#: A text without any of these holds nothing to find.
HINT = re.compile(r"\d.?\d|@|[0-9A-Fa-f]{32}")
FINDERS = {kind: re.compile(pattern) for kind, (pattern, _, _) in KINDS.items()}


@lru_cache(1 << 15)
def pseudonym(kind: str, value: str, key: bytes, back: bool = False) -> str:
    """The value's pseudonym, or with ``back`` the value of a pseudonym."""
    return KINDS[kind][2](value, key, back)


def spans(text: str) -> list[tuple[int, int, str]]:
    """Validated findings (begin, end, kind) in order; where two overlap the kind listed first wins."""
    if not HINT.search(text):
        return []
    found: list[tuple[int, int, str]] = []
    for kind, finder in FINDERS.items():
        if kind == "email" and "@" not in text:
            continue
        valid = KINDS[kind][1]
        for m in finder.finditer(text):
            if kind == "card":
                found += [(m.start() + a, m.start() + b, kind) for a, b in _cards(m[0])]
            elif valid(m[0]):
                found.append((m.start(), m.end(), kind))
    rank = {kind: i for i, kind in enumerate(KINDS)}
    kept: list[tuple[int, int, str]] = []
    taken: list[tuple[int, int]] = []
    for a, b, kind in sorted(found, key=lambda x: (rank[x[2]], 0 if x[2] == "card" else x[0])):
        if not _hit(taken, a, b):
            kept.append((a, b, kind))
            insort(taken, (a, b))
    return sorted(kept)


def _hit(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    i = bisect_left(taken, (b, b))
    return bool(i) and taken[i - 1][1] > a


def redact(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with pseudonyms in place of what was found, and the findings."""
    found = spans(text)
    out, at = [], 0
    for a, b, kind in found:
        out += [text[at:a], pseudonym(kind, text[a:b], key)]
        at = b
    return "".join([*out, text[at:]]), found


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``docs`` with the text redacted, plus n_found and ``kinds``, a map of counts."""
    rest = [c for c in docs.columns if c not in (text, "n_found", "kinds")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, text):
            texts, counts, kinds = [], [], []
            for value in piece.column(text).to_pylist():
                new, found = (None, []) if value is None else redact(value, key)
                tally: dict[str, int] = {}
                for _, _, kind in found:
                    tally[kind] = tally.get(kind, 0) + 1
                texts.append(new)
                counts.append(len(found))
                kinds.append(sorted(tally.items()))
            yield pa.RecordBatch.from_arrays(
                [*[piece.column(c) for c in rest], pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(kinds, pa.map_(pa.string(), pa.int32()))],
                [*rest, text, "n_found", "kinds"],
            )

    rows = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").cast("string").alias(text))
    return rows.mapInArrow(run, StructType(rows.schema.fields + StructType.fromDDL("n_found int, kinds map<string,int>").fields))
