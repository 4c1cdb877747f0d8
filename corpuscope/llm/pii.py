"""Personal data (operator 4): format-preserving Feistel pseudonyms, DataFrame functions only.

One regular expression finds all kinds in one scan. What it finds is validated - Luhn for card numbers, mod 97 for
IBANs, number ranges for national numbers and for addresses (each part keeping its length), the calendar for dates - and only a valid value is replaced, by
its image under a keyed Feistel permutation of the valid values of its format: equal values get equal pseudonyms in all
documents, different values different ones, and length and layout stay. A number keeps its pseudonym in any layout. Check
digits are computed anew, so a pseudonym is as valid as its original. Formats are small enough to be tried out by whoever
has the key, so the key has no default and belongs to the caller.
"""

from __future__ import annotations

from secrets import token_hex

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 6
#: Where the queries and the pipeline look for their key.
KEY_CONF = "corpuscope.pii.key"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Ranges of letters beyond ASCII that shift among themselves: Latin, Greek, Cyrillic, Hebrew, Arabic, Devanagari, Thai, kana,
#: Han and Hangul (fixed values).
RANGES = (
    (0xC0, 0xD6), (0xD8, 0xDE), (0xDF, 0xF6), (0xF8, 0xFF), (0x100, 0x17F), (0x391, 0x3A1), (0x3A3, 0x3A9), (0x3B1, 0x3C9), (0x400, 0x42F), (0x430, 0x45F),
    (0x5D0, 0x5EA), (0x621, 0x63A), (0x641, 0x64A), (0x905, 0x939), (0xE01, 0xE30), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3),
)
_LETTERS = "A-Za-z0-9" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in RANGES)
#: Calling codes of one and two digits; all others have three (fixed values).
CALLING_CODE = "^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
_B, _E = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: Length of an IBAN by country (registry).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """The country's own length first, so that a word behind a spaced number isn't taken with it; then any length."""

    def spaced(n: int) -> str:
        return rf"(?: [A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf" [A-Z0-9]{{{n % 4}}}" if n % 4 else "")

    own = [f"(?:{'|'.join(names.split())})[0-9]{{2}}(?:[A-Z0-9]{{{n - 4}}}|{spaced(n)}){_E}" for n, names in IBAN_LENGTHS.items()]
    anything = r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)" + _E
    return _B + f"(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(own)}|{anything})"


#: Kind -> pattern, in order of precedence at one place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[" + _LETTERS + r"._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": _iban_pattern(),
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "date": _B + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})" + _E,
    "ssn": _B + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _E,
    "phone": r"(?<![\p{L}\p{N}+(])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}" + _E + r"|(?<![\p{L}\p{N}+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}" + _E + "|" + _B + r"(?:[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4})" + _E,
    "card": _B + r"(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})" + _E,
}
KINDS = tuple(PATTERNS)
#: Days of 1900-01-01 to 2099-12-31: 17 x 4297.
FIRST_DAY, DAY_LEFT, DAY_RIGHT = "1900-01-01", 17, 4297
#: Most repetitions until a day is above 12; one more would be needed once in 10**25.
WALK = 64


def _all_pattern() -> str:
    parts, groups = [], 0
    for kind in KINDS:
        parts.append(f"(?<{kind}>{PATTERNS[kind].replace(chr(92) + '1', chr(92) + 'k<sep>').replace('([ -])', '(?<sep>[ -])')})")
        groups += 1
    return "|".join(parts)


ALL = _all_pattern()


def _number(*parts: Column | str) -> Column:
    """A number below 2**56 that the key and the parts decide."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 14), 16, 10).cast("long")


def permuted_number(x: Column, left: int | Column, right: int | Column, key: str, kind: str) -> Column:
    """Permutes the numbers 0 .. left * right - 1: by turns each half is shifted by a keyed function of the other."""
    left, right = (F.lit(n) if isinstance(n, int) else n for n in (left, right))
    start = F.struct(F.floor(x / right).cast("long").alias("l"), F.pmod(x, right).cast("long").alias("r"))

    def turn(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(
            F.when(odd, F.pmod(s["l"] + _number(key, kind, i, s["r"]), left)).otherwise(s["l"]).alias("l"),
            F.when(odd, s["r"]).otherwise(F.pmod(s["r"] + _number(key, kind, i, s["l"]), right)).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: s["l"] * right + s["r"])


def _shifted(text: Column, digest: Column, wide: bool = False) -> Column:
    """Shifts each digit, small and capital letter within its own alphabet by a byte of the digest; wide: the letters of
    RANGES as well, by two bytes."""

    def one(c: Column, i: Column) -> Column:
        by = F.conv(F.substring(digest, F.pmod(i, F.lit(32)).cast("int") * 2 + 1, F.lit(2)), 16, 10).cast("int")
        out = c
        for alphabet in (UPPER, LOWER, DIGITS):
            at = F.instr(F.lit(alphabet), c)
            out = F.when(at > 0, F.substring(F.lit(alphabet), F.pmod(at - 1 + by, F.lit(len(alphabet))) + 1, F.lit(1))).otherwise(out)
        if wide:
            code, far = F.ascii(c), F.conv(F.substring(digest, F.pmod(i, F.lit(16)).cast("int") * 4 + 1, F.lit(4)), 16, 10).cast("int")
            moved = F.lit(None).cast("int")
            for a, b in reversed(RANGES):
                moved = F.when(code.between(a, b), a + F.pmod(code - a + far, F.lit(b - a + 1))).otherwise(moved)
            letter = F.decode(F.unhex(F.lpad(F.hex(moved), 4, "0")), "UTF-16BE")
            out = F.when(code < 128, out).otherwise(F.coalesce(letter, c))
        return out

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")


def permuted_text(text: Column, key: str, kind: str, wide: bool = False) -> Column:
    """Permutes the strings of one layout (digits stay digits, small letters small, capitals capital, the rest itself)."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("a"), F.substring(text, half + 1, n - half).alias("b"))

    def turn(s: Column, i: Column) -> Column:
        return F.struct(s["b"].alias("a"), _shifted(s["a"], F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), n.cast("string"), s["b"]), 256), wide).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["a"], s["b"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _laid_out(layout: Column, digits: Column) -> Column:
    """layout with its digits replaced one after the other."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(F.concat(s["out"], F.when(is_digit, F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + F.when(is_digit, 1).otherwise(0)).alias("at"))

    return F.aggregate(F.filter(F.split(layout, ""), lambda c: c != ""), start, step, lambda s: s["out"])


def luhn_sum(digits: Column) -> Column:
    """Sum of a number with its check digit, mod 10: 0 if it is valid."""
    reverse = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    values = F.transform(reverse, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10


def _card(m: Column, key: str) -> Column:
    digits = _digits(m)
    n = F.length(digits)
    payload = permuted_text(F.substring(digits, F.lit(1), n - 1), key, "card")
    check = F.pmod(-luhn_sum(F.concat(payload, F.lit("0"))), F.lit(10)).cast("string")
    return F.when(luhn_sum(digits) == 0, _laid_out(m, F.concat(payload, check)))


def _mod97(text: Column) -> Column:
    """An IBAN's letters and digits, already moved, mod 97."""

    def step(a: Column, c: Column) -> Column:
        letter = F.instr(F.lit(UPPER), c)
        return F.when(letter > 0, (a * 100 + letter + 9) % 97).otherwise((a * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97)

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)


def _iban(m: Column, key: str) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    n = F.length(plain)
    country, own = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), n - 4)
    valid = n.between(15, 34) & (_mod97(F.concat(own, F.substring(plain, 1, 4))) == 1)
    image = permuted_text(own, key, "iban")
    check = F.lpad((98 - _mod97(F.concat(image, country, F.lit("00")))).cast("string"), 2, "0")
    out = F.concat(country, check, image)
    spaced = F.rtrim(F.regexp_replace(out, "(.{4})", "$1 "))
    return F.when(valid, F.when(F.contains(m, F.lit(" ")), spaced).otherwise(out))


def _ip(m: Column, key: str) -> Column:
    """Each part keeps its number of digits: 0 to 9, 10 to 99 or 100 to 255."""
    text = [F.element_at(F.split(m, r"\."), i) for i in range(1, 5)]
    part = [t.cast("long") for t in text]
    by_length = lambda t, one, two, three: F.when(F.length(t) == 1, one).when(F.length(t) == 2, two).otherwise(three).cast("long")
    least, kinds = [by_length(t, 0, 10, 100) for t in text], [by_length(t, 10, 90, 156) for t in text]
    index = [p - low for p, low in zip(part, least)]
    left, right = kinds[0] * kinds[1], kinds[2] * kinds[3]
    image = permuted_number((index[0] * kinds[1] + index[1]) * right + index[2] * kinds[3] + index[3], left, right, key, "ip")
    high, low = F.floor(image / right).cast("long"), F.pmod(image, right)
    out = (F.floor(high / kinds[1]).cast("long"), F.pmod(high, kinds[1]), F.floor(low / kinds[3]).cast("long"), F.pmod(low, kinds[3]))
    valid = (F.greatest(*part) <= 255) & (F.least(*index) >= 0)
    return F.when(valid, F.concat_ws(".", *[(x + n).cast("string") for x, n in zip(out, least)]))


def _date(m: Column, key: str) -> Column:
    """ISO, else day before month, else month before day; the layout and the order stay. What can only have the month first
    goes to another such date: the permutation is repeated until the day is above 12 (four in ten days aren't)."""
    iso = F.substring(m, 5, 1) == "-"
    sep = F.substring(m, 3, 1)
    a, b, year = F.substring(m, 1, 2), F.substring(m, 4, 2), F.substring(m, 7, 4)
    dated = lambda y, mo, d: F.try_to_date(F.concat_ws("-", y, mo, d), "yyyy-MM-dd")
    day_first, month_first = dated(year, b, a), dated(year, a, b)
    value = F.when(iso, F.try_to_date(m, "yyyy-MM-dd")).otherwise(F.coalesce(day_first, month_first))
    days = F.datediff(value, F.lit(FIRST_DAY).cast("date"))
    first = F.lit(FIRST_DAY).cast("date")
    turn = lambda x: permuted_number(x, DAY_LEFT, DAY_RIGHT, key, "date")
    month_only = ~iso & day_first.isNull()
    high = lambda x: F.dayofmonth(F.date_add(first, x.cast("int"))) > 12
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), turn(days), lambda x, _: F.when(high(x), x).otherwise(turn(x)))
    image = F.date_add(first, F.when(month_only, walked).otherwise(turn(days)).cast("int"))
    day, month, years = F.date_format(image, "dd"), F.date_format(image, "MM"), F.date_format(image, "yyyy")
    local = F.when(day_first.isNotNull(), F.concat_ws("", day, sep, month, sep, years)).otherwise(F.concat_ws("", month, sep, day, sep, years))
    same_sep = iso | (sep == F.substring(m, 6, 1))
    return F.when(same_sep & days.between(0, DAY_LEFT * DAY_RIGHT - 1), F.when(iso, F.concat_ws("-", years, month, day)).otherwise(local))


def _ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    index = ((area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1) * 9999 + serial - 1
    image = permuted_number(index, 898, 99 * 9999, key, "ssn")
    place = F.floor(image / (99 * 9999)) + 1
    out = (place + F.when(place >= 666, 1).otherwise(0), F.pmod(F.floor(image / 9999), F.lit(99)) + 1, F.pmod(image, F.lit(9999)) + 1)
    return F.when(valid, F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in zip(out, (3, 2, 4))]))


def _phone(m: Column, key: str) -> Column:
    """The calling code behind a plus sign stays; the other digits are permuted, whatever their layout."""
    digits = _digits(m)
    code = F.when(F.startswith(m, F.lit("+")), F.regexp_extract(digits, CALLING_CODE, 1)).otherwise("")
    rest = F.substring(digits, F.length(code) + 1, F.length(digits))
    return F.when(F.length(digits).between(8, 15), _laid_out(m, F.concat(code, permuted_text(rest, key, "phone"))))


def _email(m: Column, key: str) -> Column:
    """The part before the sign is permuted, the domain stays."""
    at = F.instr(m, "@")
    return F.concat(permuted_text(F.substring(m, F.lit(1), at - 1), key, "email", wide=True), F.substring(m, at, F.length(m)))


IMAGES = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}
#: How a match of ALL tells its kind: the first of these that fits all of it.
WHOLE = {
    "email": "@",
    "iban": "^[A-Z]{2}",
    "ip": r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$",
    "date": r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})$",
    "ssn": "^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
    "phone": r"^[+(]|^[0-9]{3}([-.])[0-9]{3}\1[0-9]{4}$",
    "card": "^[0-9]",
}


def _kind(m: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        out = F.when(m.rlike(WHOLE[kind]), F.lit(kind)).otherwise(out)
    return out


def _image(m: Column, key: str) -> Column:
    """The pseudonym of a match; null if it isn't valid."""
    kind, out = _kind(m), F.lit(None).cast("string")
    for k in reversed(KINDS):
        out = F.when(kind == k, IMAGES[k](m, key)).otherwise(out)
    return out


#: Keys of sessions that name none, held by the driver alone.
_made: dict[str, str] = {}


def session_key(docs: DataFrame) -> str:
    """The key that the session names. Where it names none, one is drawn for the application: values are linked within all that
    it writes, and nobody can turn them back afterwards. Name a key to link the results of several runs."""
    spark = docs.sparkSession
    return spark.conf.get(KEY_CONF, None) or _made.setdefault(spark.sparkContext.applicationId, token_hex(32))


def pseudonymise(docs: DataFrame, key: str, text: str = "text", counts: bool = True) -> DataFrame:
    """docs with the valid personal data of each whole text replaced; with counts also n_<kind> and n_pii, what was
    replaced.

    Null stays null, with counts 0; a text without such data stays as it is; values that look alike but aren't valid stay.
    Rows are independent: repeated rows give repeated rows, an empty table an empty one. Columns named like the counts
    are replaced.
    """
    names = [f"n_{k}" for k in KINDS] + ["n_pii"]
    columns = [c for c in docs.columns if not (counts and c in names)]
    found = docs.select(*columns, F.when(F.col(text).isNotNull(), F.regexp_extract_all(F.col(text), F.lit(ALL), F.lit(0))).alias("__found"))
    # A row without a match skips everything below.
    some = F.coalesce(F.size("__found") > 0, F.lit(False))
    imaged = found.withColumn("__images", F.when(some, F.transform("__found", lambda m: F.struct(m.alias("m"), _kind(m).alias("kind"), _image(m, key).alias("image")))))
    gaps = F.split(F.col(text), ALL, -1)
    pieces = F.zip_with(gaps, "__images", lambda g, x: F.concat(g, F.coalesce(x["image"], x["m"], F.lit(""))))
    out = imaged.withColumn("__text", F.when(some, F.array_join(pieces, "")).otherwise(F.col(text)))
    number = lambda k: F.coalesce(F.size(F.filter("__images", lambda x: x["image"].isNotNull() & ((x["kind"] == k) if k else F.lit(True)))), F.lit(0))
    counted = [F.when(some, number(k)).otherwise(0).cast("long").alias(n) for k, n in zip([*KINDS, None], names)] if counts else []
    return out.select(*[F.col("__text").alias(text) if c == text else F.col(c) for c in columns], *counted)
