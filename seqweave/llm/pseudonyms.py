"""Format-preserving pseudonyms for personal data by keyed Feistel permutations.

A value that passes its kind's check (Luhn digit, valid area, existing day, octets, mod 97) is numbered within
the set of all valid values of its format, the number is permuted by an alternating Feistel network over that
set, and the result is written in the same format. A permutation keeps equal values equal and different ones
different, so records stay linked across documents; only the holder of the key can go back.
"""

from __future__ import annotations

import hashlib
import re
import secrets
from datetime import date, timedelta
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks

ROUNDS = 10
#: Setting of the session that holds the key.
KEY = "spark.seqweave.pseudonyms.key"
_FIRST_DAY, _DAYS = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal() - date(1900, 1, 1).toordinal() + 1
_MONTHS = "January February March April May June July August September October November December".split()

_KINDS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}(?!-*[A-Za-z0-9])"),
    ("secret", r"(?<![A-Za-z0-9_])(?i:token|secret|password|api[_-]?key)\s*+[=:]\s*+[\"']?[0-9A-Fa-f]{16,}+(?![0-9A-Za-z])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("phone", r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\)[ .-]?[0-9]{3}[.-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])"),
    ("day", r"(?<![0-9A-Za-z-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9-])"),
    ("named", r"(?<![0-9A-Za-z])(?:[0-9]{1,2} (?:%(m)s) [0-9]{4}|(?:%(m)s) [0-9]{1,2}, [0-9]{4})(?![0-9])" % {"m": "|".join(_MONTHS)}),
    ("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("card", r"(?<![0-9A-Za-z])(?:[0-9][ -]?){12,18}[0-9](?![0-9A-Za-z])"),
)
PRIVATE = "|".join(f"(?P<{k}>{p})" for k, p in _KINDS)
_SINGLE = {k: re.compile(p) for k, p in _KINDS}
_GROUP = re.compile("[0-9]+")
#: How issuers write and begin card numbers; such ones are tried before others in a run of numbers.
_CARD_SHAPES = {(n,) for n in range(13, 20)} | {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3), (4, 4, 5)}
_ISSUER = re.compile("2[2-7]|3[04-9]|4|5[0-8]|6")
#: Lengths of IBANs by country, also tried first.
_IBAN = {c: int(n) for c, n in re.findall("([A-Z]{2})([0-9]{2})", "AD24AE23AL28AT20AZ28BA20BE16BG22BH22BR29CH21CR22CY28CZ24DE22DK18DO28EE20ES24FI18FO18FR27GB22GE22GI23GL18GR27GT28HR21HU28IE22IL23IS26IT27JO30KW30KZ20LB28LI21LT20LU20LV21MC27MD24ME22MK19MR27MT31MU30NL18NO15PK24PL28PS29PT25QA29RO24RS22SA24SE24SI19SK24SM27TN24TR26UA29VG24XK20")}
#: Most digits of a national number behind the country's code, a trunk zero in brackets apart; other countries have E.164's 15 in all.
_PHONE = {"1": 10, "7": 10, "20": 10, "27": 9, "30": 10, "31": 9, "32": 9, "33": 9, "34": 9, "36": 9, "39": 11, "40": 9, "41": 9, "44": 10, "45": 8, "46": 9, "47": 8, "48": 9, "49": 11, "52": 10, "55": 11, "60": 10, "61": 9, "64": 10, "65": 8, "81": 10, "82": 10, "86": 11, "90": 10, "91": 10, "351": 9, "352": 9, "353": 9, "358": 10, "420": 9, "421": 9}


class Feistel:
    """Keyed permutations of range(n) for any n; ``kind`` separates the formats."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, kind: str, i: int, n: int, half: int) -> int:
        size = (half.bit_length() + 7) // 8
        if n.bit_length() > 700:  # halves that 512 bits don't cover
            h = hashlib.shake_256(self.key + f"{kind}/{i}/{n.bit_length()}/".encode() + half.to_bytes(size, "big"))
            return int.from_bytes(h.digest(n.bit_length() // 16 + 32), "big")
        h = hashlib.blake2b(half.to_bytes(size, "big"), key=self.key, digest_size=64, person=f"{kind[:8]}{i:02d}".encode(), salt=(n % (1 << 128)).to_bytes(16, "big"))
        return int.from_bytes(h.digest(), "big")

    def permute(self, kind: str, n: int, x: int, back: bool = False) -> int:
        """x's image; values that leave range(n) are walked on until they come back, which keeps it a permutation."""
        if n < 2:
            return x
        a = isqrt(n - 1) + 1
        b = -(-n // a)
        while True:
            left, right = divmod(x, b)
            for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
                sign = -1 if back else 1
                if i % 2:
                    right = (right + sign * self._round(kind, i, n, left)) % b
                else:
                    left = (left + sign * self._round(kind, i, n, right)) % a
            x = left * b + right
            if x < n:
                return x


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        v = int(c) * (2 - i % 2)
        total += v - 9 * (v > 9)
    return str(-total % 10)


def iban_check(country: str, bban: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in bban + country + '00')) % 97:02d}"


def _refill(shape: str, wanted: str, alphabet: str) -> str:
    """``shape`` with its characters of ``alphabet`` replaced by those of ``wanted`` in turn."""
    it = iter(wanted)
    return "".join(next(it) if c in alphabet else c for c in shape)


def _mixed(f: Feistel, kind: str, value: str, back: bool) -> str:
    """Permute digits as digits and lower-case letters as letters, all as one number; other signs stay."""
    n, x = 1, 0
    for c in value:
        base = 10 if "0" <= c <= "9" else 26 if "a" <= c <= "z" else 1
        n *= base
        x = x * base + (int(c) if base == 10 else ord(c) - 97 if base == 26 else 0)
    x, out = f.permute(kind, n, x, back), []
    for c in reversed(value):
        base = 10 if "0" <= c <= "9" else 26 if "a" <= c <= "z" else 1
        x, d = divmod(x, base)
        out.append(str(d) if base == 10 else chr(97 + d) if base == 26 else c)
    return "".join(reversed(out))


def _day(y: int, m: int, d: int) -> int | None:
    try:
        n = date(y, m, d).toordinal() - _FIRST_DAY
    except ValueError:
        return None
    return n if 0 <= n < _DAYS else None


def pseudonym(f: Feistel, kind: str, text: str, back: bool = False) -> str | None:
    """The pseudonym of a value as written, or None where it fails its kind's check."""
    digits = "".join(c for c in text if "0" <= c <= "9")
    if kind == "email":
        cut = text.rindex(".")
        new = _mixed(f, kind, text[:cut].lower(), back)
        return "".join(n.upper() if o.isupper() else n for o, n in zip(text[:cut], new)) + text[cut:]
    if kind == "secret":
        hexes = re.search("[0-9A-Fa-f]+$", text).group()
        new = format(f.permute(kind, 16 ** len(hexes), int(hexes, 16), back), f"0{len(hexes)}x")
        return text[: -len(hexes)] + (new.upper() if hexes.upper() == hexes else new)
    if kind == "phone":
        head = text.index("(") if text[0] == "+" and "(" in text else re.match(r"\+[0-9]{1,3}(?=[ .-])|\+[0-9]|", text).end()
        body = "".join(c for c in text[head:] if "0" <= c <= "9")
        if not 7 <= len(body) <= 14:
            return None
        new = str(f.permute(kind, 10 ** len(body), int(body), back)).zfill(len(body))
        return text[:head] + _refill(text[head:], new, "0123456789")
    if kind == "ip":
        parts = [int(p) for p in text.split(".")]
        if max(parts) > 255:
            return None
        new = f.permute(kind, 1 << 32, int.from_bytes(bytes(parts), "big"), back)
        return ".".join(map(str, new.to_bytes(4, "big")))
    if kind == "ssn":
        area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        x = f.permute(kind, 898 * 99 * 9999, ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, back)
        x, serial = divmod(x, 9999)
        area, group = divmod(x, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"
    if kind == "card":
        if luhn_digit(digits[:-1]) != digits[-1]:
            return None
        body = str(f.permute(kind, 10 ** (len(digits) - 1), int(digits[:-1]), back)).zfill(len(digits) - 1)
        return _refill(text, body + luhn_digit(body), "0123456789")
    if kind == "iban":
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 != 1:
            return None
        bban = _mixed(f, kind, plain[4:].lower(), back).upper()
        new = plain[:2] + iban_check(plain[:2], bban) + bban
        it = iter(new)
        return "".join(c if c == " " else next(it) for c in text)
    # days: numbered from 1900 to 2099
    sort = None
    if kind == "named":
        a, b, year = re.split("[ ,]+", text)
        d, m = (b, a) if a in _MONTHS else (a, b)
        n = _day(int(year), _MONTHS.index(m) + 1, int(d))
    elif "-" in text:
        n = _day(*map(int, text.split("-")))
    else:
        a, b, y = map(int, re.split("[/.]", text))
        sort = "/" if "/" in text else "."
        n = _day(y, a, b) if sort == "/" else _day(y, b, a)  # 3/14/2020, 14.3.2020
        if n is None and sort == "/":  # 14/3/2020: stays among the days that can't be read the other way
            sort, n = "dm", _day(y, b, a)
    if n is None:
        return None
    while True:
        n = f.permute("day", _DAYS, n, back)
        day = date.fromordinal(_FIRST_DAY) + timedelta(n)
        if sort != "dm" or day.day > 12:
            break
    if kind == "named":
        number = f"{day.day:02d}" if d[0] == "0" else str(day.day)
        return f"{_MONTHS[day.month - 1]} {number}, {day.year}" if a in _MONTHS else f"{number} {_MONTHS[day.month - 1]} {day.year}"
    if sort is None:
        return day.isoformat()
    sign = "." if sort == "." else "/"
    two = [day.month, day.day] if sort == "/" else [day.day, day.month]
    wide = all(len(p) == 2 for p in re.split("[/.]", text)[:2])
    return sign.join([*(f"{v:02d}" if wide else str(v) for v in two), str(day.year)])


def _card_spans(text: str, start: int) -> list[tuple[int, int]]:
    """Where a card number may stand in the run of digit groups at ``start``: likely ones of the run first, then those at its start."""
    groups, at, total = [], start, 0
    while total <= 38 and (m := _GROUP.match(text, at)):
        groups.append(m.span())
        total += m.end() - at
        at = m.end() + 1
        if text[m.end() : at] not in (" ", "-"):
            break
    if groups and groups[-1][1] < len(text) and re.match("[0-9A-Za-z]", text[groups[-1][1]]):
        groups.pop()
    likely, other, before = [], [], 0
    for i, (a, b) in enumerate(groups):
        if before > 19:
            break
        before += b - a
        issued, sizes, digits = _ISSUER.match(text, a), (), 0
        for c, d in groups[i:] if issued or not i else ():
            digits += d - c
            sizes += (d - c,) if len(sizes) < 6 else ()
            if digits > 19 or i and len(sizes) > 5:
                break
            if digits >= 13 and issued and sizes in _CARD_SHAPES:
                likely.append((a, d))
            elif digits >= 13 and not i:
                other.append((a, d))
    return likely + other[::-1]


def _spans(kind: str, m: re.Match) -> list[tuple[int, int]]:
    """Parts of a match to try in turn: a number may have taken groups of another one behind it."""
    text, (start, end) = m.string, m.span()
    if kind == "card":
        return _card_spans(text, start)
    if kind == "iban":
        likely, other = [], []
        for a in (start, *(i + 1 for i in range(start, end) if text[i] == " ")):
            one = _SINGLE[kind].match(text, a) if a == start or text[a : a + 2] in _IBAN else None
            for b in (one.end(), *(i for i in range(one.end() - 1, a, -1) if text[i] == " ")) if one else ():
                if b - a - text.count(" ", a, b) == _IBAN.get(text[a : a + 2]):
                    likely.append((a, b))
                elif a == start:
                    other.append((a, b))
        return likely + other
    if kind == "phone" and text[start] == "+":
        ends = [end, *(i for i in range(end - 1, start, -1) if text[i] in " .-" and text[i - 1] in "0123456789)")]

        def fits(e: int) -> bool:
            digits = re.sub("[^0-9]", "", text[start:e].replace("(0)", ""))
            code = next((digits[:n] for n in (1, 2, 3) if digits[:n] in _PHONE), "")
            return len(digits) - len(code) <= _PHONE.get(code, 15)

        return [(start, e) for e in sorted(ends, key=lambda e: (not fits(e), -e))]
    return [(start, end)]


def replacer(key: bytes, back: bool = False):
    """A function from a text to its pseudonymised form and the number of values replaced."""
    f, pattern, known = Feistel(key), re.compile(PRIVATE), {}
    hint = re.compile("[0-9@=:]")  # every kind has one of these
    kinds = [k for k, _ in _KINDS]

    def found(m: re.Match) -> tuple[int, int, str] | None:
        """The first valid value that begins with the match, of its kind or a later one, or a likely number in it."""
        text, start = m.string, m.start()
        for kind in kinds[kinds.index(m.lastgroup) :]:
            one = m if kind == m.lastgroup else _SINGLE[kind].match(text, start)
            for a, b in _spans(kind, one) if one else ():
                value = text[a:b]
                if (kind, value) not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[kind, value] = pseudonym(f, kind, value, back)
                if known[kind, value] is not None:
                    return a, b, known[kind, value]
        return None

    def run(text: str) -> tuple[str, int]:
        if not hint.search(text):
            return text, 0
        out, done, at, n = [], 0, 0, 0
        while m := pattern.search(text, at):
            hit = found(m)
            if hit is None:
                at = m.start() + 1  # another value may begin within
                continue
            a, b, new = hit
            out += [text[done:a], new]
            done = at = b
            n += 1
        return "".join([*out, text[done:]]), n

    return run


def session_key(spark) -> bytes:
    """The key that the session's setting KEY holds, else a random one that nobody keeps: results then can't be
    reversed, nor linked with those of another call."""
    named = spark.conf.get(KEY, None)
    return named.encode() if named else secrets.token_bytes(32)


def pseudonymise(df: DataFrame, text: str = "text", n_chars: str = "n_chars", key: bytes | None = None, count: str | None = None) -> DataFrame:
    """``df`` with the personal data in ``text`` replaced, n_chars set anew, and with ``count`` the number of values.

    Card numbers (Luhn), phone numbers, IPv4 addresses, US social security numbers, IBANs, days from 1900 to
    2099, mail addresses and hexadecimal secrets after their names are permuted within their formats; numbers that
    fail their check stay. Without ``key`` that of the session is taken, see session_key.

    Where values could overlap the leftmost wins, of those that begin together the kind first in order. A day written
    as 14/3/2020 becomes one that can't be read the other way either, so it is linked with days written so, not with ISO ones.
    Null texts stay null with a count of 0, empty ones empty; very long texts are read whole, and so are addresses and
    secrets of any length; every row is kept in its columns, repeated ones too and with equal results; an empty table gives no
    rows; a column named like ``count`` is replaced, others pass unchanged. Rows are independent: no exchange.
    """
    kept = df.drop(count) if count else df
    key = session_key(df.sparkSession) if key is None else key

    def run(batches):
        change = replacer(key)
        for part in chunks(batches, text):
            i = part.schema.get_field_index(text)
            texts = part.column(i).to_pylist()
            both = [change(t) if t else (t, 0) for t in texts]
            cols = [pa.array([t for t, _ in both], pa.string()) if k == i else c for k, c in enumerate(part.columns)]
            names = list(part.schema.names)
            if count:
                cols.append(pa.array(np.array([n for _, n in both], np.int32)))
                names.append(count)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = T.StructType([*kept.schema.fields, *([T.StructField(count, T.IntegerType())] if count else [])])
    out = kept.mapInArrow(run, schema)
    if n_chars in df.columns:
        out = out.withColumn(n_chars, F.when(F.col(text).isNull(), F.col(n_chars)).otherwise(F.length(text)).cast(df.schema[n_chars].dataType))
    return out.select(*kept.columns, *([count] if count else []))
