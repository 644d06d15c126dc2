"""Format-preserving pseudonyms for personal data, by a keyed Feistel permutation.

Validated values (payment cards, phone numbers, internet addresses, calendar dates, tax-style and bank numbers, mail
addresses, credentials) are numbered within the set of all values of their format. A Feistel network over that
set, with cycle walking, permutes the numbers under a key; the image is written in the same format and is valid
again. The map is one-to-one and depends on key and format only, so equal values stay linked across documents
without any shared table, and the holder of the key can go back.

Defined cases: null texts stay null, empty ones empty; text outside validated values is untouched; a value that
only looks like one (a failed check digit, an octet over 255, a 30th of February) is left alone; where more groups
follow, cards, bank and international phone numbers are tried at each end of a group; rows that repeat
give repeated results; an empty table gives an empty one; other columns are kept as they are.
"""

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache, partial
from math import prod

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

ROUNDS = 8
#: dates are permuted among the days of these years
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)
#: digits of a bank number by country, as registered; numbers of other countries are tried at every length
BANK_LENGTHS = {country: int(n) for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for country in countries.split()}
TWO_DIGIT_CODES = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 "
                      "82 84 86 90 91 92 93 94 95 98".split())
#: least and most digits behind the calling code; others have 6 to 12
NATIONAL = {
    "7": (10, 10), "20": (8, 10), "27": (9, 9), "30": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9), "34": (9, 9),
    "36": (8, 9), "39": (6, 11), "40": (9, 9), "41": (9, 9), "43": (6, 13), "44": (9, 10), "45": (8, 8), "46": (7, 10),
    "47": (8, 8), "48": (9, 9), "49": (6, 11), "52": (10, 10), "54": (10, 11), "55": (10, 11), "56": (9, 9), "58": (10, 10),
    "61": (9, 9), "65": (8, 8), "66": (8, 9), "81": (9, 10), "82": (8, 10), "84": (9, 10), "86": (9, 11), "90": (10, 10),
    "91": (10, 10), "94": (9, 9), "98": (10, 10), "351": (9, 9), "353": (7, 9), "380": (9, 9), "420": (9, 9), "852": (8, 8),
    "971": (8, 9), "972": (8, 9)}
_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def permute(value: int, size: int, key: bytes, back: bool = False) -> int:
    """The image of `value` under the keyed permutation of range(size); `back` inverts it."""
    if size < 2:
        return value
    half = ((size - 1).bit_length() + 1) // 2
    mask, width = (1 << half) - 1, half // 8 + 9

    def turn(part: int, k: int) -> int:
        digest = hashlib.blake2b(part.to_bytes(width, "big") + bytes([k]) + size.to_bytes(2 * width, "big"), key=key,
                                 digest_size=min(64, width))
        while digest.digest_size * 8 < half:  # formats far beyond 2**1000 values
            return int.from_bytes(hashlib.shake_256(digest.digest()).digest(width), "big") & mask
        return int.from_bytes(digest.digest(), "big") & mask

    while True:
        left, right = value >> half, value & mask
        for k in (reversed(range(ROUNDS)) if back else range(ROUNDS)):
            if back:
                left, right = right ^ turn(left, k), left
            else:
                left, right = right, left ^ turn(right, k)
        value = left << half | right
        if value < size:
            return value


def shaped(text: str, key: bytes, back: bool = False) -> str:
    """Permute a text among all texts with digits, capitals and small letters at the same places."""
    sets = [next((s for s in (_DIGIT, _LOWER, _UPPER) if c in s), c) for c in text]
    number = 0
    for c, s in zip(text, sets):
        number = number * len(s) + s.index(c)
    number = permute(number, prod(map(len, sets)), key + text_shape(sets), back)
    out = []
    for s in reversed(sets):
        number, at = divmod(number, len(s))
        out.append(s[at])
    return "".join(reversed(out))


def text_shape(sets: list[str]) -> bytes:
    return hashlib.blake2b("".join(s if len(s) == 1 else f"\0{len(s)}{s[0]}" for s in sets).encode(),
                           digest_size=16).digest()


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _shorter_cards(digits: str) -> list[bool]:
    return [luhn_digit(digits[:n - 1]) == digits[n - 1] and len(set(digits[:n])) > 1 for n in range(13, len(digits))]


def card(text: str, key: bytes, back: bool = False) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    size = 9 * 10 ** (len(digits) - 2)  # no leading zero
    if digits[0] == "0":
        return None
    image, like = digits, _shorter_cards(digits)
    while True:  # an image has valid shorter readings where its value has them, so it's read at the same length
        body = permute(int(image[:-1]) - size // 9, size, key + b"card", back) + size // 9
        image = f"{body}{luhn_digit(str(body))}"
        if len(set(image)) > 1 and _shorter_cards(image) == like:
            break
    places = iter(image)
    return re.sub(r"\d", lambda _: next(places), text)


def phone(text: str, key: bytes, back: bool = False) -> str | None:
    """North American numbers: area and exchange don't begin with 0 or 1."""
    digits = re.sub(r"\D", "", text)
    national = digits[-10:]
    if len(digits) not in (10, 11) or (len(digits) == 11 and digits[0] != "1") or national[0] in "01" or national[3] in "01":
        return None
    number = ((int(national[0]) - 2) * 100 + int(national[1:3])) * 800 + (int(national[3]) - 2) * 100 + int(national[4:6])
    number = permute(number * 10_000 + int(national[6:]), 800 * 800 * 10_000, key + b"phone", back)
    codes, line = divmod(number, 10_000)
    area, exchange = divmod(codes, 800)
    places = iter(f"{digits[:-10]}{area + 200:03d}{exchange + 200:03d}{line:04d}")
    return re.sub(r"\d", lambda _: next(places), text)


def international(text: str, key: bytes, back: bool = False) -> str | None:
    """Numbers with a plus sign: calling code, length and a leading zero stay; North American ones are as `phone` has them."""
    digits = re.sub(r"\D", "", text)
    code = calling_code(digits)
    if code == "1":
        return phone(text, key, back)
    least, most = NATIONAL.get(code, (6, 12))
    national = digits[len(code):]
    if not least <= len(national) <= most or len(digits) > 15:
        return None
    kept = "0" if national[0] == "0" else ""
    n = len(national) - len(kept)
    lowest = 0 if kept else 10 ** (n - 1)
    number = permute(int(national) - lowest, 10**n - lowest, key + b"phone" + code.encode(), back) + lowest
    places = iter(f"{code}{kept}{number:0{n}d}")
    return re.sub(r"\d", lambda _: next(places), text)


def calling_code(digits: str) -> str:
    return digits[:1] if digits[0] in "17" else digits[:2] if digits[:2] in TWO_DIGIT_CODES else digits[:3]


def address(text: str, key: bytes, back: bool = False) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    number = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key + b"ip4", back)
    return ".".join(map(str, number.to_bytes(4, "big")))


_DAYS = (LAST_DAY - FIRST_DAY).days + 1


def _moved(day: date, key: bytes, back: bool) -> date | None:
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    return date.fromordinal(permute((day - FIRST_DAY).days, _DAYS, key + b"date", back) + FIRST_DAY.toordinal())


def calendar_date(text: str, key: bytes, back: bool = False) -> str | None:
    """Year first, or day first with dots, or month first with slashes; day first where no such month exists."""
    a, sign, b, c = re.fullmatch(r"(\d+)([-/.])(\d+)[-/.](\d+)", text).groups()
    orders = ["ymd"] if len(a) == 4 else ["dmy"] if sign != "/" else ["mdy", "dmy"]
    for order in orders:
        try:
            found = dict(zip(order, map(int, (a, b, c))))
            day = _moved(date(found["y"], found["m"], found["d"]), key, back)
        except ValueError:
            continue
        if day is None:
            return None
        if order == "dmy" and sign == "/":  # stays readable in this order only: days 13 to 31 of the image's month
            first = date(found["y"], found["m"], found["d"])
            return _late_day(first, key, back)
        values = {"y": f"{day.year:04d}", "m": f"{day.month:02d}", "d": f"{day.day:02d}"}
        return sign.join(values[k] for k in order)
    return None


@lru_cache(1)
def _late_days() -> list[int]:
    return [n for n in range(FIRST_DAY.toordinal(), LAST_DAY.toordinal() + 1) if date.fromordinal(n).day > 12]


def _late_day(day: date, key: bytes, back: bool) -> str | None:
    """Dates that can only be read day first are permuted among themselves."""
    from bisect import bisect_left

    days = _late_days()
    at = bisect_left(days, day.toordinal())
    image = date.fromordinal(days[permute(at, len(days), key + b"late", back)])
    return f"{image.day:02d}/{image.month:02d}/{image.year:04d}"


def social(text: str, key: bytes, back: bool = False) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if area in (0, 666) or area >= 900 or group == 0 or serial == 0:
        return None
    areas = [n for n in range(1, 900) if n != 666]
    number = (areas.index(area) * 99 + group - 1) * 9999 + serial - 1
    number = permute(number, len(areas) * 99 * 9999, key + b"social", back)
    rest, serial = divmod(number, 9999)
    area, group = divmod(rest, 99)
    return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"


def bank(text: str, key: bytes, back: bool = False) -> str | None:
    """International bank numbers with a valid remainder; country and length stay."""
    plain = text.replace(" ", "")
    country, check, body = plain[:2], plain[2:4], plain[4:]
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 11 <= len(body) <= 30 or number(body + country + check) % 97 != 1:
        return None
    shorter = [n for n in _borders(text, " ") if n < len(text)]
    while True:
        body = shaped(body, key + b"bank", back)
        places = iter(f"{country}{98 - number(body + country + '00') % 97:02d}{body}")
        image = re.sub(r"\S", lambda _: next(places), text)
        # a shorter reading comes first where the length isn't the country's own
        if len(plain) == BANK_LENGTHS.get(country) or not any(_valid_bank(image[:n]) for n in shorter):
            return image


def _valid_bank(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def mail(text: str, key: bytes, back: bool = False) -> str | None:
    """Local part and the labels below the last two; shared domains stay readable."""
    local, _, domain = text.rpartition("@")
    labels = domain.split(".")
    if any(not x or x[0] == "-" or x[-1] == "-" for x in labels):
        return None
    inner = ".".join(labels[:-2])
    moved = shaped(f"{local}@{inner}", key + b"mail", back)
    local, _, inner = moved.rpartition("@")
    return f"{local}@{'.'.join([x for x in (inner, *labels[-2:]) if x])}"


def access_key(text: str, key: bytes, back: bool = False) -> str | None:
    """Four fixed letters, then 16 capitals and digits."""
    sixteen = [*_UPPER, *_DIGIT]
    number = 0
    for c in text[4:]:
        number = number * 36 + sixteen.index(c)
    number = permute(number, 36**16, key + b"access", back)
    out = []
    for _ in range(16):
        number, at = divmod(number, 36)
        out.append(sixteen[at])
    return text[:4] + "".join(reversed(out))


def secret(text: str, key: bytes, back: bool = False) -> str | None:
    """The value behind a credential's name."""
    head, value = re.fullmatch(r"""(\w+\s?[=:]\s?["']?)(.*)""", text, re.S).groups()
    if re.fullmatch(r"[0-9a-f]+", value):  # hexadecimal stays so
        return head + f"{permute(int(value, 16), 16 ** len(value), key + b'hex%d' % len(value), back):0{len(value)}x}"
    return head + shaped(value, key + b"secret", back)


#: kind, pattern, map; where two fit at a place the first stands
KINDS: list[tuple[str, str, Callable]] = [
    ("mail", r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", mail),
    ("access", r"(?<![A-Za-z0-9])A(?:KI|SI)A[A-Z0-9]{16}(?![A-Za-z0-9])", access_key),
    ("secret", r"(?<!\w)(?:password|passwd|pwd|token|secret|api_key|apikey)(?:\s?[=:]\s?)[\"']?[A-Za-z0-9_\-]{8,}", secret),
    ("bank", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", bank),
    ("address", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)", address),
    ("date", r"(?<![\d./-])(?:\d{4}-\d\d-\d\d|\d\d[/.]\d\d[/.]\d{4})(?![./-]?\d)", calendar_date),
    ("social", r"(?<![\d-])\d{3}-\d\d-\d{4}(?![\d-])", social),
    ("international", r"(?<![\w.+-])\+[1-9](?:[ .-]?\(?\d\)?){6,}", international),
    ("phone", r"(?<![\w.-])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-]|\.\d)", phone),
    ("card", r"(?<![\w.-])\d(?:[ -]?\d){12,19}", card),
]
_ALL = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern, _ in KINDS))
_MAPS = {kind: f for kind, _, f in KINDS}
_HINT = re.compile(r"[0-9@]|AKIA|ASIA|password|passwd|pwd|token|secret|api_?key")


#: what may not follow a value of these kinds; a sign and a digit begin another group
_GOES_ON = {"bank": re.compile(r"[A-Za-z0-9]"), "international": re.compile(r"\w|[.-](?!\d)(?=\w)"),
            "card": re.compile(r"\w|-(?!\d)|\.\d")}
_SIGNS = {"bank": " ", "international": " .-", "card": " -"}


def _borders(text: str, signs: str) -> list[int]:
    """Where the groups of a text end, the last one included."""
    return [k for k in range(1, len(text)) if text[k] in signs] + [len(text)]


def _readings(kind: str, text: str, start: int, end: int) -> list[int]:
    """Where a value that begins at `start` may end, the preferred end first."""
    if kind not in _SIGNS:
        return [end]
    ends = [start + k for k in _borders(text[start:end], _SIGNS[kind])]
    ends = [k for k in ends if not _GOES_ON[kind].match(text, k)]
    if kind == "international":
        return ends[::-1]
    if kind == "bank":
        own = BANK_LENGTHS.get(text[start:start + 2])
        ends.sort(key=lambda k: k - start - text.count(" ", start, k) != own)
    return ends


def pseudonymise(text: str, key: bytes, back: bool = False) -> tuple[str, int]:
    """The text with every validated value mapped, and how many there were."""
    if not _HINT.search(text):
        return text, 0
    out, at, n, start = [], 0, 0, 0
    while m := _ALL.search(text, start):
        for end in _readings(m.lastgroup, text, m.start(), m.end()):
            image = _MAPS[m.lastgroup](text[m.start():end], key, back)
            if image is not None:
                break
        else:  # not valid: look for another kind a little further on
            start = m.start() + 1
            continue
        out += [text[at:m.start()], image]
        at = start = end
        n += 1
    return "".join([*out, text[at:]]), n


def _mapped(batches: Iterator[pa.RecordBatch], key: bytes, back: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [(None, 0) if t is None else pseudonymise(t, key, back) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([t for t, _ in pairs], pa.string()), pa.array([n for _, n in pairs], pa.int64()),
             *batch.columns[1:]], names=["text", "n", *batch.schema.names[1:]])


def pseudonyms(docs: DataFrame, key: str, text: str = "text", count: str | None = None,
               back: bool = False) -> DataFrame:
    """The rows with every validated value of `text` mapped; `count` names a column for how many there were.

    Whoever knows the key can go back (`back`), so there is none by default.
    """
    others = [c for c in docs.columns if c != text]
    rows = docs.select(F.col(f"`{text}`").cast("string"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    schema = StructType([StructField("text", StringType()), StructField("n", LongType()), *rows.schema.fields[1:]])
    done = rows.mapInArrow(partial(_mapped, key=key.encode(), back=back), schema)
    at = {c: F.col(f"c{i}") for i, c in enumerate(others)} | {text: F.col("text")}
    return done.select(*[at[c].alias(c) for c in docs.columns], *([F.col("n").alias(count)] if count else []))
