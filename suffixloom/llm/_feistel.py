"""Keyed format-preserving permutations and the formats they keep.  Plain Python for worker processes."""

from __future__ import annotations

import datetime
import hashlib
import re
import unicodedata

ROUNDS = 10
_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
#: Alphabets whose members may stand for each other in names of mail boxes.
_ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"]
_CLASS = {c: a for a in _ALPHABETS for c in a}


def alphabet(c: str) -> str | None:
    """The characters that may stand for a letter or digit: other scripts permute within blocks of 64 of one category."""
    if c not in _CLASS:
        if not c.isalnum():
            return None
        low, kind = ord(c) & ~63, unicodedata.category(c)
        same = "".join(x for x in map(chr, range(low, low + 64)) if unicodedata.category(x) == kind and x.isalnum())
        _CLASS.update((x, same) for x in same)
    return _CLASS[c]

PATTERN = re.compile(
    r"(?P<email>(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<phone>\+\d{1,3}[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w.-])\d{3}-\d{3}-\d{4}(?![\w-]))"
    r"|(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))"
    r"|(?P<iso>(?<![\w-])\d{4}-\d{2}-\d{2}(?=T\d{2}|(?![\w-])))"
    r"|(?P<date>(?<![\w./-])\d{1,2}(?P<sep>[./])\d{1,2}(?P=sep)\d{4}(?![\w/]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w])(?:\d{13,19}|\d{4}(?P<cs>[ -])\d{4}(?P=cs)\d{4}(?P=cs)\d{4}|\d{4}(?P<as>[ -])\d{6}(?P=as)\d{5})(?![\w]))"
)
KINDS = ("email", "iban", "phone", "ip", "date", "ssn", "card")


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size): a balanced Feistel network, walked along its cycle until it is in range."""
    if size < 2:
        return value
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask, n = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = value >> half, value & mask
        for i in range(ROUNDS):
            data = f"{tweak}/{size}/{i}/".encode() + right.to_bytes(n, "little")
            f = int.from_bytes(hashlib.blake2b(data, key=key, digest_size=max(n, 8)).digest(), "little") & mask
            left, right = right, left ^ f
        value = left << half | right
        if value < size:
            return value


def luhn_digit(digits: str) -> int:
    """The check digit that follows the digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _into(text: str, digits: str) -> str:
    """The digits, put in the places of the text's digits."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


class Pseudonyms:
    """Pseudonyms of validated values: equal values get equal pseudonyms, whatever their separators."""

    def __init__(self, key: bytes, cache: int = 100_000):
        self.key, self.limit, self.cache = key, cache, {}

    def _number(self, digits: str, tweak: str) -> str:
        return str(permute(int(digits), 10 ** len(digits), self.key, tweak)).zfill(len(digits))

    def card(self, text: str) -> str | None:
        digits = "".join(c for c in text if c.isdigit())
        if luhn_digit(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
            return None
        body = self._number(digits[:-1], "card")
        return _into(text, body + str(luhn_digit(body)))

    def phone(self, text: str) -> str | None:
        digits = "".join(c for c in text if c.isdigit())
        own = self._number(digits[-10:], "phone")
        return _into(text, digits[:-10] + own)

    def ip(self, text: str) -> str | None:
        parts = [int(p) for p in text.split(".")]
        if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in text.split(".")):
            return None
        n = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, self.key, "ip")
        return ".".join(map(str, n.to_bytes(4, "big")))

    def _day(self, y: int, m: int, d: int) -> datetime.date | None:
        try:
            day = datetime.date(y, m, d).toordinal()
        except ValueError:
            return None
        if not _FIRST <= day <= _LAST:
            return None
        return datetime.date.fromordinal(_FIRST + permute(day - _FIRST, _LAST - _FIRST + 1, self.key, "date"))

    def iso(self, text: str) -> str | None:
        day = self._day(*map(int, text.split("-")))
        return day and day.isoformat()

    def date(self, text: str) -> str | None:
        sep = "/" if "/" in text else "."
        a, b, year = text.split(sep)
        month_first = sep == "/" and int(a) <= 12
        m, d = (a, b) if month_first else (b, a)
        day = self._day(int(year), int(m), int(d))
        if day is None:
            return None
        width = 2 if "0" in (a[0], b[0]) or len(a) == len(b) == 2 else 1
        x, y = (day.month, day.day) if month_first else (day.day, day.month)
        return f"{x:0{width}d}{sep}{y:0{width}d}{sep}{day.year:04d}"

    def _ssn_ok(self, d: str) -> bool:
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

    def ssn(self, text: str) -> str | None:
        d = text.replace("-", "")
        if not self._ssn_ok(d):
            return None
        while True:  # walks the cycle to the next valid number
            d = self._number(d, "ssn")
            if self._ssn_ok(d):
                return _into(text, d)

    def iban(self, text: str) -> str | None:
        bare = text.replace(" ", "")
        if not 15 <= len(bare) <= 34 or _mod97(bare[4:] + bare[:4]) != 1:
            return None
        digits = "".join(c for c in bare[4:] if c.isdigit())
        if not digits:
            return None
        body = _into(bare[4:], self._number(digits, "iban"))
        check = 98 - _mod97(body + bare[:2] + "00")
        it = iter(bare[:2] + f"{check:02d}" + body)
        return "".join(c if c == " " else next(it) for c in text)

    def email(self, text: str) -> str | None:
        name, host = text.rsplit("@", 1)
        value, size = 0, 1
        for c in name:
            if a := alphabet(c):
                value, size = value * len(a) + a.index(c), size * len(a)
        if size == 1:
            return None
        value, out = permute(value, size, self.key, "email"), []
        for c in reversed(name):
            if a := alphabet(c):
                value, k = divmod(value, len(a))
                c = a[k]
            out.append(c)
        return "".join(reversed(out)) + "@" + host

    def of(self, kind: str, text: str) -> str | None:
        if (kind, text) not in self.cache:
            if len(self.cache) >= self.limit:
                self.cache.clear()
            self.cache[kind, text] = getattr(self, kind)(text)
        return self.cache[kind, text]

    def replace(self, text: str) -> tuple[str, list[str]]:
        """The text with pseudonyms, and the kinds of what was replaced."""
        out, kinds, at, start = [], [], 0, 0
        while m := PATTERN.search(text, start):
            kind = next(k for k in ("email", "iban", "phone", "ip", "iso", "date", "ssn", "card") if m[k] is not None)
            end, new = m.end(), self.of(kind, m[0])
            if new is None and kind == "iban":
                # the match may have taken words that follow: try what ends before each of its blanks, longest first
                for end in reversed([m.start() + i for i, c in enumerate(m[0]) if c == " "]):
                    if (new := self.of(kind, text[m.start() : end])) is not None:
                        break
            if new is None:
                # what the match took may hold another value
                start = m.start() + 1 if kind == "iban" else m.end()
                continue
            out += [text[at : m.start()], new]
            at = start = end
            kinds.append("date" if kind == "iso" else kind)
        return ("".join(out) + text[at:] if out else text), kinds
