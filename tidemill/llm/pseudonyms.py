"""Format-preserving pseudonyms for personal data by a keyed Feistel permutation.

Validated numbers and dates are permuted among the values of their own kind, so a
card number stays a card number (Luhn), an IBAN keeps valid check digits, a date
stays a date between 1900 and 2099, and separators stay where they are. Equal
values get equal pseudonyms in every document, whatever their separators; different
values get different ones. Letters and digits of an e-mail address are permuted
within their classes, in blocks of ``BLOCK`` characters, each by a permutation that
the blocks before choose; the top-level domain stays. Days after the 12th stay
after the 12th, so that a date with the month first, which can be told only by
that, doesn't get the string of another with the day first. Numbers that fail
validation are left alone.

Null text stays null, empty text empty; whole texts are read. Repeated rows are
rows of their own, an empty table gives an empty result, other columns don't matter.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.shared import with_columns

BLOCK = 128  # characters of an address permuted together
KINDS = ("email", "ip", "date", "ssn", "iban", "card", "phone")
_PHONE_FORMS = r"""(?P<phone>(?:\+|00)[1-9][0-9]{0,2}(?:[\x20.-]?\([0-9]{1,5}\))?(?:[\x20.-]?[0-9]{1,8}){1,6}
    |(?:1[\x20.-]?)?\([2-9][0-9]{2}\)[\x20.-]?[2-9][0-9]{2}[\x20.-][0-9]{4}
    |(?:1[.-])?[2-9][0-9]{2}(?P<us>[.-])[2-9][0-9]{2}(?P=us)[0-9]{4})(?![A-Za-z0-9_])"""
_PHONE = re.compile(_PHONE_FORMS, re.VERBOSE)
_PATTERN = re.compile(
    r"""(?<![A-Za-z0-9._%+-])(?P<email>[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)
    |(?<![A-Za-z0-9_])(?:(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3})
    |(?P<date>[0-9]{4}([-/.])[0-9]{1,2}\4[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\5[0-9]{4})
    |(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})
    |(?P<iban>[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)
    |(?P<card>[0-9](?:[\x20-]?[0-9]){12,18})
    |"""
    + _PHONE_FORMS
    + r")(?![A-Za-z0-9_])",
    re.VERBOSE,
)
_GROUP = re.compile(r"[A-Za-z0-9+(]+")
_END = re.compile(r"(?<=[A-Za-z0-9])[\x20.-]")
_IBAN = {c: int(n) for n, cs in (("15", "NO"), ("16", "BE"), ("18", "DK FI FO GL NL"), ("19", "MK SI"), ("20", "AT BA EE KZ LT LU XK"), ("21", "CH HR LI LV"), ("22", "BG BH CR DE GB GE IE ME RS VA"), ("23", "AE GI IL IQ TL"), ("24", "AD CZ ES MD PK RO SA SE SK TN VG"), ("25", "LY PT ST"), ("26", "IS TR"), ("27", "FR GR IT MC MR SM"), ("28", "AL AZ BY CY DO GT HU LB PL SV"), ("29", "BR EG PS QA UA"), ("30", "JO KW MU"), ("31", "MT SC"), ("32", "LC")) for c in cs.split()}
#: Country codes of two digits; 1 and 7 are codes of one digit, and all others have three, of which the first two are listed.
_TWO = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_THREE = set("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split())
#: Digits after a country code, where all numbers of the country have as many.
_NATIONAL = {"1": 10, "7": 10, "31": 9, "33": 9, "34": 9, "41": 9, "44": 10, "45": 8, "47": 8, "48": 9, "61": 9, "86": 11, "91": 10}
_FIRST, _DAYS = dt.date(1900, 1, 1).toordinal(), dt.date(2100, 1, 1).toordinal() - dt.date(1900, 1, 1).toordinal()


class Feistel:
    """Permutations of 0..size-1, one for each (kind, size), by alternating rounds on the two halves and walking until in range.

    Sizes stay below 2^768, so that a half has 384 bits at most and a round's 512 cover it.
    """

    def __init__(self, key: bytes, rounds: int = 8) -> None:
        self.key, self.rounds = hashlib.blake2b(key, digest_size=32).digest(), rounds

    def _mix(self, kind: str, size: int, i: int, half: int, modulus: int) -> int:
        n = size.bit_length() // 8 + 1
        said = f"{kind}:{n}:{i}:".encode() + size.to_bytes(n, "big") + half.to_bytes(n, "big")
        out = hashlib.blake2b(said, key=self.key).digest()  # 128 bits more than the half of a block has
        return int.from_bytes(out, "big") % modulus

    def permute(self, x: int, size: int, kind: str, back: bool = False) -> int:
        low = isqrt(size - 1) + 1 if size > 1 else 1
        high = -(-size // low)
        while True:
            a, b = divmod(x, low)
            for i in reversed(range(self.rounds)) if back else range(self.rounds):
                sign = -1 if back else 1
                if i % 2:
                    b = (b + sign * self._mix(kind, size, i, a, low)) % low
                else:
                    a = (a + sign * self._mix(kind, size, i, b, high)) % high
            x = a * low + b
            if x < size:
                return x


def _refill(layout: str, digits: str) -> str:
    """The layout with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if "0" <= c <= "9" else c for c in layout)


def luhn(digits: str) -> int:
    """The check digit that belongs after these digits."""
    return -sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10


def _usual(digits: str) -> bool:
    """Has the length that cards of these first digits have."""
    n, two, four = len(digits), int(digits[:2]), int(digits[:4])
    if digits[0] == "4":
        return n in (13, 16, 19)
    if two in (34, 37):
        return n == 15
    if two in (30, 36, 38, 39):
        return n == 14
    return n == 16 and (51 <= two <= 55 or 2221 <= four <= 2720 or two in (35, 62, 64, 65) or four == 6011)


def _country(digits: str) -> str | None:
    """The country code that an international number begins with."""
    return digits[0] if digits[:1] in ("1", "7") else digits[:2] if digits[:2] in _TWO else digits[:3] if digits[:2] in _THREE and len(digits) > 3 else None


def _in_use(digits: str) -> bool:
    return digits[0] > "1" and digits[3] > "1"


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s)) % 97


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


class Pseudonyms:
    """Pseudonyms of single values, None for what isn't valid; ``back`` gives the value of a pseudonym."""

    def __init__(self, key: bytes) -> None:
        self.permute = Feistel(key).permute

    def email(self, s: str, back: bool = False) -> str | None:
        own, _, rest = s.rpartition(".")
        sizes = [26 if c.isalpha() else 10 if c.isdigit() else 1 for c in own]
        layout = "".join(c if n == 1 else "a" if n == 26 else "0" for c, n in zip(own, sizes, strict=True))
        tweak, out = hashlib.blake2b(layout.encode(), digest_size=16), []
        for i in range(0, len(own), BLOCK):
            part = self._letters(own[i : i + BLOCK], sizes[i : i + BLOCK], f"email:{tweak.hexdigest()}", back)
            out.append(part)
            tweak.update((own[i : i + BLOCK] if back else part).lower().encode())
        return "".join(out) + "." + rest

    def _letters(self, own: str, sizes: list[int], kind: str, back: bool) -> str:
        value, size = 0, 1
        for c, n in zip(own.lower(), sizes, strict=True):
            value, size = value * n + (ord(c) - (97 if n == 26 else 48) if n > 1 else 0), size * n
        value = self.permute(value, size, kind, back)
        out = []
        for c, n in zip(reversed(own), reversed(sizes), strict=True):
            value, x = divmod(value, n)
            new = c if n == 1 else chr(x + (97 if n == 26 else 48))
            out.append(new.upper() if c.isupper() else new)
        return "".join(reversed(out))

    def ip(self, s: str, back: bool = False) -> str | None:
        octets = [int(x) for x in s.split(".")]
        if max(octets) > 255:
            return None
        new = self.permute(int.from_bytes(bytes(octets), "big"), 2**32, "ip", back)
        return ".".join(map(str, new.to_bytes(4, "big")))

    def date(self, s: str, back: bool = False) -> str | None:
        a, b, c = parts = re.split(r"[-/.]", s)
        for order in ((0, 1, 2),) if len(a) == 4 else ((2, 1, 0), (2, 0, 1)):
            try:
                day = dt.date(*(int(parts[i]) for i in order))
            except ValueError:
                continue
            if not 0 <= day.toordinal() - _FIRST < _DAYS:
                return None
            new, late = day.toordinal() - _FIRST, day.day > 12
            while True:
                new = self.permute(new, _DAYS, "date", back)
                if (dt.date.fromordinal(_FIRST + new).day > 12) == late:
                    break
            new = dt.date.fromordinal(_FIRST + new)
            values = dict(zip(order, (f"{new.year:04}", f"{new.month:02}", f"{new.day:02}"), strict=True))
            return s[len(a)].join(values[i] for i in range(3))
        return None

    def ssn(self, s: str, back: bool = False) -> str | None:
        def valid(d: str) -> bool:
            return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

        new = _digits(s)
        if not valid(new):
            return None
        while True:
            new = f"{self.permute(int(new), 10**9, 'ssn', back):09}"
            if valid(new):
                return _refill(s, new)

    def iban(self, s: str, back: bool = False) -> str | None:
        plain = s.replace(" ", "")
        body = plain[4:]
        digits = _digits(body)
        if not digits or _mod97(body + plain[:4]) != 1:
            return None
        body = _refill(body, f"{self.permute(int(digits), 10 ** len(digits), 'iban:' + plain[:2] + _refill(body, '0' * len(digits)), back):0{len(digits)}}")
        new = plain[:2] + f"{98 - _mod97(body + plain[:2] + '00'):02}" + body
        chars = iter(new)
        return "".join(c if c == " " else next(chars) for c in s)

    def card(self, s: str, back: bool = False) -> str | None:
        d = _digits(s)
        if not _usual(d) or luhn(d[:-1]) != int(d[-1]):
            return None
        while True:  # until an issuer has such numbers, too
            d = f"{self.permute(int(d[:-1]), 10 ** (len(d) - 1), 'card', back):0{len(d) - 1}}"
            d += str(luhn(d))
            if _usual(d):
                return _refill(s, d)

    def phone(self, s: str, back: bool = False) -> str | None:
        d = _digits(s)
        if s.startswith(("+", "00")):
            d = d.removeprefix("00") if s[0] == "0" else d
            code = _country(d)
        else:  # a North American form
            code = "1" if len(d) > 10 else ""
        national = d[len(code) :] if code is not None else ""
        if code is None or not 8 <= len(code + national) <= 15 or len(national) != _NATIONAL.get(code or "1", len(national)):
            return None
        digits, american = national, code in ("", "1")
        while True:  # of American numbers those that can be in use stay so, and others don't become such
            digits = f"{self.permute(int(digits), 10 ** len(digits), 'phone' if american else f'phone:{code}', back):0{len(digits)}}"
            if not american or _in_use(digits) == _in_use(national):
                return _refill(s, _digits(s)[: -len(national)] + digits)

    def _found(self, kind: str, s: str) -> tuple[str, str, int] | None:
        """Kind, pseudonym and length of what a match begins with, if anything of it is valid.

        Digits or capitals that follow a number can look like its last groups, so shorter ends are tried: first those
        of the length that the number's first characters ask for, then the whole match.
        """
        if kind == "card" and s[0] not in "23456":  # no issuer's
            return None
        if kind in ("card", "iban", "phone"):
            for end in [len(s), *(m.start() for m in reversed(list(_END.finditer(s))))]:
                part = s[:end]
                if self._of_usual_length(kind, part) and (new := getattr(self, kind)(part)) is not None:
                    return kind, new, end
        new = getattr(self, kind)(s)
        return None if new is None else (kind, new, len(s))

    @staticmethod
    def _of_usual_length(kind: str, part: str) -> bool:
        d = _digits(part)
        if kind == "card":
            return len(d) > 12 and _usual(d)
        if kind == "iban":
            return len(part.replace(" ", "")) == _IBAN.get(part[:2])
        if not part.startswith(("+", "00")):
            return False
        d = d[2:] if part[0] == "0" else d
        return any(d.startswith(code) and len(d) == len(code) + n for code, n in _NATIONAL.items())

    def replace(self, text: str) -> tuple[str, list[int]]:
        """The text with pseudonyms, and how many of each kind."""
        counts = [0] * len(KINDS)
        if not re.search("[0-9@]", text):
            return text, counts
        out, done, at = [], 0, 0
        while match := _PATTERN.search(text, at):
            kind, start = match.lastgroup, match.start()
            found = self._found(kind, match[0])
            if found is None and kind == "card" and (phone := _PHONE.match(text, start)):
                found = self._found("phone", phone[0])
            if found is None:  # another may begin within it
                at = max(start + 1, _GROUP.match(text, start).end()) if kind in ("card", "iban", "phone") else match.end()
                continue
            kind, new, length = found
            counts[KINDS.index(kind)] += 1
            out += [text[done:start], new]
            done = at = start + length
        return "".join([*out, text[done:]]), counts


def pseudonymize(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the text with pseudonyms, and n_email, n_ip, n_date, n_ssn, n_iban, n_card, n_phone."""

    def make():
        own = Pseudonyms(key)

        def columns(batch: pa.RecordBatch, texts: list[str]) -> list[pa.Array]:
            done = [own.replace(t) for t in texts]
            return [pa.array([t for t, _ in done], pa.string()), *(pa.array([c[i] for _, c in done], pa.int64()) for i in range(len(KINDS)))]

        return columns

    fields = "new__ string, " + ", ".join(f"n_{k} long" for k in KINDS)
    rows = with_columns(docs, text_col, make, fields, [F.col(id_col).alias("doc_id"), F.col(text_col).isNull().alias("null__")])
    return rows.select("doc_id", F.when(~F.col("null__"), F.col("new__")).alias("text"), *(f"n_{k}" for k in KINDS))
