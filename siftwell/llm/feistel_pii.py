"""Format-preserving pseudonyms for personal data.

Numbers and dates that validate (phone, payment card, US social security, IBAN, IP address, e-mail, keys
and secrets) are replaced by a keyed permutation of the set of values of their own format: a balanced
Feistel network over pairs of mixed-radix halves, cycle-walked back into the set. So equal values get equal
pseudonyms in every document, different values of one format stay different, and lengths, separators and
checks (Luhn, IBAN modulus, calendar) survive. Everything is a function of the key and the value: there is
no state, and a task that runs again gives the same text.

Values of up to ``PIECE`` characters are one number each. Longer ones (a key file, a data URL after ``token=``) go through a Feistel
network of their two halves whose round function is a keyed SHAKE-256 stream, added character by character within each character's own set.
A secret that is hexadecimal, or has digits only, stays so, and no other secret becomes one: the permutation is walked until the
result has the value's own kind. So no two values share a pseudonym. The domain of an e-mail address is kept.

Cards are found by sums: over a stretch of digits, single blanks and hyphens, prefix sums tell for all starts and lengths at once
which pass the Luhn test, so a long run of digits costs no more than its length.

Defined results for odd input: a null text stays null with 0 replacements, an empty one stays empty; texts and values of
any length are treated whole, in time that grows with them; repeated rows are treated alike; other columns are passed on by
``pseudonymise``; without a key nothing runs.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StructField, StructType

from siftwell.llm.textcodes import slices

ROUNDS = 10
KEY_SETTING = "siftwell.pii.key"  #: of the session: the secret key
PIECE = 128  #: characters up to which a value is permuted as one number

DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
HEX = "0123456789abcdef"


class Feistel:
    """Keyed permutations of range(size) by format name."""

    def __init__(self, key: bytes):
        self.key = key

    def permute(self, kind: str, size: int, value: int, inverse: bool = False) -> int:
        """Walks the permutation of the least a * b >= size until it is back inside range(size)."""
        if size < 2:
            return value
        a = math.isqrt(size)
        b = -(-size // a)
        step = self._backward if inverse else self._forward
        while True:
            value = step(kind, a, b, value)
            if value < size:
                return value

    def permute_characters(self, kind: str, digits: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The same for a long row of digits, each below its own size: halves are shifted by streams drawn from each other."""
        out, mid = digits.astype(np.int64), len(digits) // 2
        halves = (slice(0, mid), slice(mid, len(digits)))
        for r in range(ROUNDS):
            own, other = halves[r % 2], halves[1 - r % 2]
            seed = hashlib.blake2b(out[other].astype("<u1").tobytes(), key=self.key, person=f"{r}|{len(digits)}".encode()[:16], salt=kind.encode()[:16]).digest()
            stream = np.frombuffer(hashlib.shake_256(seed).digest(4 * (own.stop - own.start)), "<u4")
            out[own] = (out[own] + stream) % sizes[own]
        return out

    def _f(self, kind: str, r: int, half: int, modulus: int) -> int:
        seed = f"{kind}|{r}|{half}|{modulus}".encode()
        return int.from_bytes(hashlib.blake2b(seed, key=self.key, digest_size=16).digest(), "little") % modulus

    def _forward(self, kind: str, a: int, b: int, value: int) -> int:
        x, y = divmod(value, b)
        for r in range(ROUNDS):
            if r % 2:
                y = (y + self._f(kind, r, x, b)) % b
            else:
                x = (x + self._f(kind, r, y, a)) % a
        return x * b + y

    def _backward(self, kind: str, a: int, b: int, value: int) -> int:
        x, y = divmod(value, b)
        for r in reversed(range(ROUNDS)):
            if r % 2:
                y = (y - self._f(kind, r, x, b)) % b
            else:
                x = (x - self._f(kind, r, y, a)) % a
        return x * b + y


def luhn_digit(body: str) -> str:
    """The check digit that makes ``body`` + digit pass the Luhn test."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_valid(text: str) -> bool:
    body = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in body)) % 97 == 1


_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

_EMAIL = r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24})"
_IBAN = r"(?P<iban>\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b)"
_IP = r"(?P<ip>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))"
_ISO = r"(?P<iso>(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-]))"
_DATE = r"(?P<date>(?<![0-9/.-])[0-9]{1,2}(?P<s>[/.-])[0-9]{1,2}(?P=s)[0-9]{4}(?![0-9/-]))"
_SSN = r"(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"
_STRETCH = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,}(?![0-9])")  #: cards are parts of these
_PHONE = (
    r"(?P<phone>(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,10}(?:[ .-][0-9]{1,10}){0,5}(?![0-9])|\+[0-9]{8,15}(?![0-9])"
    r"|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])|[0-9]{3}(?P<g>[ .-])[0-9]{3}(?P=g)[0-9]{4}(?![0-9])))"
)
_AWS = r"(?P<aws>\b(?:AKIA|ASIA)[A-Z0-9]{16}\b)"
_SECRET = r"(?P<secret>(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key)\b\s*[=:]\s*\"?)(?P<value>[A-Za-z0-9+/_.-]{8,}))"

#: Tried in this order at each place of the text.
PATTERN = re.compile("|".join([_EMAIL, _AWS, _SECRET, _IBAN, _ISO, _DATE, _IP, _SSN, _PHONE]))
#: A text without any of these can hold nothing that PATTERN finds.
_HINT = re.compile(r"[0-9@]|(?i:password|passwd|pwd|token|secret|api)")


def _secret_kind(text: str) -> str:
    """``digits``, ``hex`` (a letter among them) or nothing special."""
    return "digits" if re.fullmatch("[0-9]+", text) else "hex" if re.fullmatch("[0-9a-f]+", text) else ""


def card_spans(text: str) -> tuple[list[int], list[int]]:
    """(starts, ends), ascending, of the longest valid card number at each place where a group of digits begins."""
    starts, ends = [], []
    for stretch in _STRETCH.finditer(text):
        at = np.flatnonzero(np.frombuffer(stretch[0].encode(), np.uint8) >= 48)
        d = np.frombuffer(stretch[0].encode(), np.uint8)[at].astype(np.int64) - 48
        twice = np.where(d > 4, 2 * d - 9, 2 * d)
        odd = np.arange(len(d)) % 2 == 1
        # a card that ends with digit e counts digit e, e - 2, ... as they are and the others twice
        plain = np.stack([np.concatenate([[0], np.cumsum(np.where(odd == p, d, twice))]) for p in (False, True)])
        first = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
        last = np.concatenate([np.diff(at) > 1, [True]])
        open_ = np.ones(len(first), bool)
        for length in range(19, 12, -1):
            end = first + length
            good = open_ & (end <= len(d))
            good[good] &= last[end[good] - 1]
            good[good] &= (plain[(end[good] - 1) % 2, end[good]] - plain[(end[good] - 1) % 2, first[good]]) % 10 == 0
            starts += (stretch.start() + at[first[good]]).tolist()
            ends += (stretch.start() + at[end[good] - 1] + 1).tolist()
            open_ &= ~good
    order = np.argsort(starts, kind="stable").tolist()
    return [starts[k] for k in order], [ends[k] for k in order]


class Pseudonyms:
    """Replaces the validated matches of PATTERN; ``replace`` returns None for a match that fails its check."""

    def __init__(self, key: bytes):
        self.feistel = Feistel(key)

    def characters(self, kind: str, text: str) -> str:
        """Permutes ``text`` within the set of texts of its shape: digits, lower and upper case letters stay what they are, place by place.

        A secret of hexadecimal digits only is one of a shape of its own; the others' results are walked until they are none.
        """
        own = _secret_kind(text) if kind == "secret" else ""
        sets = [HEX if own == "hex" else DIGITS if c in DIGITS else LOWER if c in LOWER else UPPER if c in UPPER else c for c in text]
        while True:
            text = self._permuted(kind, text, sets)
            if kind != "secret" or _secret_kind(text) == own:
                return text

    def _permuted(self, kind: str, text: str, sets: list[str]) -> str:
        shape = "".join("h" if s is HEX else "9" if s is DIGITS else "a" if s is LOWER else "A" if s is UPPER else s for s in sets)
        if len(text) > PIECE:
            digits = np.array([s.index(c) for c, s in zip(text, sets, strict=True)])
            named = hashlib.blake2b(shape.encode(), digest_size=6).hexdigest()
            found = self.feistel.permute_characters(f"{kind[:3]}:{named}", digits, np.array([len(s) for s in sets]))
            return "".join(s[k] for s, k in zip(sets, found.tolist(), strict=True))
        number, size = 0, 1
        for c, s in zip(text, sets, strict=True):
            number = number * len(s) + s.index(c)
            size *= len(s)
        number = self.feistel.permute(f"{kind}:{shape}", size, number)
        out = []
        for s in reversed(sets):
            number, k = divmod(number, len(s))
            out.append(s[k])
        return "".join(reversed(out))

    def digits(self, kind: str, text: str, keep: int = 0) -> str:
        """Permutes the digits of ``text`` after the first ``keep`` as one number; other characters stay."""
        own = [c for c in text if c in DIGITS]
        body = "".join(own[keep:])
        new = own[:keep] + list(str(self.feistel.permute(f"{kind}:{len(body)}", 10 ** len(body), int(body))).zfill(len(body)))
        it = iter(new)
        return "".join(next(it) if c in DIGITS else c for c in text)

    def email(self, m: re.Match) -> str | None:
        local, _, domain = m["email"].partition("@")
        return f"{self.characters('email', local)}@{domain}"

    def aws(self, m: re.Match) -> str | None:
        return m["aws"][:4] + self.characters("aws", m["aws"][4:])

    def secret(self, m: re.Match) -> str | None:
        head = m["secret"][: len(m["secret"]) - len(m["value"])]
        return head + self.characters("secret", m["value"])

    def iban(self, m: re.Match) -> str | None:
        plain = m["iban"].replace(" ", "")
        if not 15 <= len(plain) <= 34 or not iban_valid(plain):
            return None
        country, body = plain[:2], self.characters("iban", plain[4:])
        rest = int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97
        it = iter(f"{country}{98 - rest:02d}{body}")
        return "".join(c if c == " " else next(it) for c in m["iban"])

    def _day(self, y: int, mo: int, d: int) -> datetime.date | None:
        try:
            day = datetime.date(y, mo, d).toordinal()
        except ValueError:
            return None
        if not _FIRST <= day <= _LAST:
            return None
        return datetime.date.fromordinal(_FIRST + self.feistel.permute("date", _LAST - _FIRST + 1, day - _FIRST))

    def iso(self, m: re.Match) -> str | None:
        new = self._day(*map(int, m["iso"].split("-")))
        return new and new.isoformat()

    def date(self, m: re.Match) -> str | None:
        one, two, year = map(int, m["date"].split(m["s"]))
        # 31/12/1999 first; where the first part can't be a day of the second, 12/31/1999
        new = self._day(year, two, one)
        if new:
            return f"{new.day:02d}{m['s']}{new.month:02d}{m['s']}{new.year}"
        new = self._day(year, one, two)
        return new and f"{new.month:02d}{m['s']}{new.day:02d}{m['s']}{new.year}"

    def ip(self, m: re.Match) -> str | None:
        parts = m["ip"].split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        n = self.feistel.permute("ip", 1 << 32, int.from_bytes(bytes(map(int, parts)), "big"))
        return ".".join(str(b) for b in n.to_bytes(4, "big"))

    def ssn(self, m: re.Match) -> str | None:
        area, group, serial = m["ssn"].split("-")
        if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000":
            return None
        a = int(area) - 1 - (int(area) > 666)  # 898 areas: 001-899 without 666
        n = self.feistel.permute("ssn", 898 * 99 * 9999, (a * 99 + int(group) - 1) * 9999 + int(serial) - 1)
        n, serial_ = divmod(n, 9999)
        a, group_ = divmod(n, 99)
        a += 1 + (a >= 665)
        return f"{a:03d}-{group_ + 1:02d}-{serial_ + 1:04d}"

    def card(self, found: str) -> str:
        own = [c for c in found if c in DIGITS]
        head = "".join(own[:-1])
        head = head[:1] + str(self.feistel.permute(f"card:{len(head)}", 10 ** (len(head) - 1), int(head[1:]))).zfill(len(head) - 1)
        it = iter(head + luhn_digit(head))
        return "".join(next(it) if c in DIGITS else c for c in found)

    def phone(self, m: re.Match) -> str | None:
        text = m["phone"]
        n = sum(c in DIGITS for c in text)
        if not 8 <= n <= 15:
            return None
        keep = len(re.match(r"\+?([0-9]{1,3})(?=[^0-9])", text)[1]) if re.match(r"\+[0-9]{1,3}[^0-9]", text) else 0
        return self.digits("phone", text, keep)

    def replace(self, m: re.Match) -> str | None:
        return getattr(self, next(k for k in _KINDS if m.re.groupindex.get(k) and m[k] is not None))(m)

    def _shorter(self, m: re.Match) -> tuple[int, int, str] | None:
        """The longest valid prefix of a failed phone match that ends where a group of digits does."""
        found = m["phone"]
        for end in range(len(found) - 1, 0, -1):
            if not (found[end - 1].isdigit() and not found[end].isdigit()):
                continue
            o = _BY_KIND["phone"].fullmatch(m.string, m.start(), m.start() + end)
            if o and (new := self.replace(o)) is not None:
                return o.start(), o.end(), new
        return None

    def text(self, text: str) -> tuple[str, int]:
        """The text with all validated values replaced, and how many were: the leftmost first, cards before phones and after the others."""
        if not _HINT.search(text):
            return text, 0
        starts, ends = card_spans(text)
        out, last, n = [], 0, 0
        value, card = self._value(text, 0), 0
        while True:
            while card < len(starts) and starts[card] < last:
                card += 1
            if value and value[0] < last:
                value = self._value(text, last)
            if card < len(starts) and (not value or (starts[card], "card") < (value[0], "card" if value[3] != "phone" else "phone")):
                start, end = starts[card], ends[card]
                new = self.card(text[start:end])
            elif value:
                start, end, new, _ = value
            else:
                break
            out += [text[last:start], new]
            last = end
            n += 1
        return "".join([*out, text[last:]]) if n else text, n

    def _value(self, text: str, at: int) -> tuple[int, int, str, str] | None:
        """(start, end, pseudonym, kind) of the first valid value, but for cards, at or after ``at``."""
        while m := PATTERN.search(text, at):
            kind = next(k for k in _KINDS if m[k] is not None)
            if (new := self.replace(m)) is not None:
                return *m.span(), new, kind
            # a part of what failed may still be a valid value of another kind
            for kind, pattern in _BY_KIND.items():
                if o := pattern.match(text, m.start()):
                    if (new := self.replace(o)) is not None:
                        return o.start(), o.end(), new, kind
                    if kind == "phone" and (shorter := self._shorter(o)):
                        return *shorter, kind
            at = m.start() + 1
            while at < len(text) and text[at].isalnum() and text[at - 1].isalnum():
                at += 1
        return None


_KINDS = ("email", "aws", "secret", "iban", "iso", "date", "ip", "ssn", "phone")
_BY_KIND = {
    k: re.compile(p)
    for k, p in (("iban", _IBAN), ("iso", _ISO), ("date", _DATE), ("ip", _IP), ("ssn", _SSN), ("phone", _PHONE))
}


def session_key(spark: SparkSession, otherwise: bytes = b"") -> bytes:
    """The key in the session's ``KEY_SETTING``; where it has none, ``otherwise``, which refuses to run unless the caller names one."""
    own = spark.conf.get(KEY_SETTING, None)
    return own.encode() if own else otherwise


def pseudonymise(docs: DataFrame, key: bytes, count: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in ``text``; with ``count``, a column of that name holds the number of replacements.

    A column that is named like ``count`` already is replaced by it.
    """
    if not key:
        raise ValueError("pseudonyms need a secret key")
    docs = docs.drop(count) if count else docs
    fields = [f.name for f in docs.schema.fields]
    at = fields.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pseudonyms(key)
        for batch in batches:
            for part in slices(batch):
                done = [(None, 0) if t is None else own.text(t) for t in part.column(at).to_pylist()]
                columns = [pa.array([d[0] for d in done], pa.string()) if i == at else c for i, c in enumerate(part.columns)]
                names = list(fields)
                if count:
                    columns.append(pa.array([d[1] for d in done], pa.int64()))
                    names.append(count)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = StructType([*docs.schema.fields, *([StructField(count, LongType())] if count else [])])
    return docs.mapInArrow(run, schema)
