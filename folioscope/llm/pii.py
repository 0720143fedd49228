"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Every found value is replaced by its image under a keyed permutation of its own format, a Feistel
network whose round function is SHA-512 of key, format, round and the other half. A permutation
never maps two values to one, and equal values stay equal in every document, so records remain
linked. Validated formats stay valid: card numbers keep a right Luhn digit, IBANs right check
digits, dates are real dates, US social security numbers and IPv4 addresses keep their ranges.

| kind | found | permuted |
| --- | --- | --- |
| email | local@domain | letters (kept in case) and digits before the @ |
| phone | +cc ..., (ddd) ddd-dddd, ddd-ddd-dddd, 1-ddd-ddd-dddd | digits after the country code |
| card | 13 to 19 digits, plain, in fours or 4-6-5, right Luhn digit | all but the last, which is set anew |
| iban | country, right check digits | digits and letters of the account, check digits anew |
| ssn | ddd-dd-dddd in the ranges in use | within those ranges |
| ipv4 | four numbers up to 255 | all 32 bits |
| date | yyyy-mm-dd, dd.mm.yyyy, mm/dd/yyyy or else dd/mm/yyyy; real, 1900 to 2099 | day number; that of dd/mm/yyyy among days after the 12th |
| secret | 32 to 128 hex digits with a digit and a letter | hex digits, in their case |

Numbers that fail validation are not personal data and stay. The job is one projection: no shuffle,
no group, and texts without digit or @ are passed through at once.

Edge cases: a null text stays null, an empty one empty. A value longer than its limit is not of its
kind. All other columns, whatever their names, are kept; repeated rows give repeated results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROUNDS = 8

#: Characters of an IBAN by country, so that one in groups of four ends where it should, whatever word follows.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}


def spaced_iban(length: int, countries: str) -> str:
    rest = f" [A-Z0-9]{{{length % 4}}}" if length % 4 else ""
    return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{length // 4 - 1}}}{rest}"


SPACED_IBANS = "|".join(spaced_iban(n, c) for n, c in IBAN_LENGTHS.items())

#: In the order in which they are tried at a position.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![0-9A-Za-z])(?=[0-9a-f]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,128}(?![0-9A-Za-z])|(?<![0-9A-Za-z])(?=[0-9A-F]*[A-F])(?=[A-F]*[0-9])[0-9A-F]{32,128}(?![0-9A-Za-z])",
    "iban": rf"(?<![0-9A-Za-z])(?=[A-Z]{{2}}[0-9]{{2}})(?:{SPACED_IBANS}|[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}|(?: [A-Z0-9]{{4}}){{2,7}}(?: [A-Z0-9]{{1,3}})?))(?![0-9A-Za-z])",
    "date": r"(?<![0-9A-Za-z./-])(?:(?:19|20)[0-9]{2}-[0-9]{1,2}-[0-9]{1,2}(?=T[0-9])|(?:(?:19|20)[0-9]{2}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}\.[0-9]{1,2}\.(?:19|20)[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/(?:19|20)[0-9]{2})(?![0-9A-Za-z/-]))",
    "ipv4": r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9A-Za-z]|\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,5}){2,5}(?![0-9A-Za-z])|(?<![0-9A-Za-z.-])(?:1[.-])?[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5}|[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{1,7})(?![0-9A-Za-z])",
}
KINDS = tuple(PATTERNS)
PII = "|".join(PATTERNS.values())


@dataclass(frozen=True)
class PiiParams:
    key: str = "change-me"  # a secret of the deployment; it decides the permutation


def chars(x: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.substring(x, i, F.lit(1)))


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def number(x: Column) -> Column:
    """A string of up to 15 hex digits as a long."""
    return F.conv(x, 16, 10).cast("long")


def keyed(params: PiiParams, kind: str, round_: Column, half: Column, part: str = "") -> Column:
    return F.sha2(F.concat_ws("|", F.lit(params.key), F.lit(kind + part), round_.cast("string"), half), 512)


def permuted_symbols(x: Column, alphabet: str, kind: str, params: PiiParams) -> Column:
    """Feistel over a string of up to 128 symbols: halves are added symbol by symbol, modulo the alphabet."""
    n = F.length(x)
    left = F.floor(n / 2).cast("int")

    def added(half: Column, stream: Column) -> Column:
        moved = F.transform(
            F.sequence(F.lit(1), F.length(half)),
            lambda j: F.substring(
                F.lit(alphabet),
                (F.pmod(F.instr(F.lit(alphabet), F.substring(half, j, F.lit(1))) - 1 + number(F.substring(stream, 4 * j - 3, F.lit(4))), F.lit(len(alphabet))) + 1).cast("int"),
                F.lit(1),
            ),
        )
        return F.when(F.length(half) == 0, F.lit("")).otherwise(F.array_join(moved, ""))

    def step(halves: Column, i: Column) -> Column:
        a, b = halves["a"], halves["b"]
        even = i % 2 == 0
        other = F.concat_ws("|", F.when(even, b).otherwise(a), n.cast("string"))
        stream = F.concat(keyed(params, kind, i, other), keyed(params, kind, i, other, "+"))
        return F.struct(F.when(even, added(a, stream)).otherwise(a).alias("a"), F.when(even, b).otherwise(added(b, stream)).alias("b"))

    start = F.struct(F.substring(x, F.lit(1), left).alias("a"), F.substring(x, left + 1, n - left).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda h: F.concat(h["a"], h["b"]))


def permuted_pair(a: Column, b: Column, size_a: int, size_b: int, kind: str, params: PiiParams) -> Column:
    """Feistel over two numbers below size_a and size_b, as a struct (a, b)."""

    def step(halves: Column, i: Column) -> Column:
        a, b = halves["a"], halves["b"]
        even = i % 2 == 0
        add = number(F.substring(keyed(params, kind, i, F.when(even, b).otherwise(a).cast("string")), 1, 12))
        return F.struct(F.when(even, F.pmod(a + add, F.lit(size_a))).otherwise(a).alias("a"), F.when(even, b).otherwise(F.pmod(b + add, F.lit(size_b))).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def refilled(x: Column, symbols: Column, pattern: str) -> Column:
    """x with the characters that match ``pattern`` replaced, in order, by those of ``symbols``."""
    place = lambda i: F.length(F.regexp_replace(F.substring(x, F.lit(1), i), f"[^{pattern}]", ""))
    put = lambda i: F.when(F.substring(x, i, F.lit(1)).rlike(f"[{pattern}]"), F.substring(symbols, place(i), F.lit(1))).otherwise(F.substring(x, i, F.lit(1)))
    return F.when(F.length(x) == 0, x).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(x)), put), ""))


def permuted_class(x: Column, pattern: str, alphabet: str, kind: str, params: PiiParams) -> Column:
    """x with its characters of one class permuted among themselves' formats."""
    own = F.regexp_replace(x, f"[^{pattern}]", "")
    return F.when(F.length(own) == 0, x).otherwise(refilled(x, permuted_symbols(own, alphabet, kind + pattern, params), pattern))


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string whose last digit counts once."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((n - i) % 2 == 0, d).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def with_luhn_digit(x: Column) -> Column:
    """x with its last digit set so that the Luhn sum is right."""
    body = F.substring(digits_of(x), F.lit(1), F.length(digits_of(x)) - 1)
    check = F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string")
    return F.regexp_replace(x, r"[0-9]$", check)


def permuted_but_last(x: Column, params: PiiParams) -> Column:
    body = F.substring(x, F.lit(1), F.length(x) - 1)
    return F.concat(permuted_class(body, "0-9", DIGITS, "card", params), F.substring(x, -1, 1))


def mod_97(x: Column) -> Column:
    """Remainder of an IBAN string with letters as 10 to 35."""

    def add(rest: Column, c: Column) -> Column:
        value = F.when(c.rlike("[0-9]"), c.cast("string")).otherwise((F.ascii(c) - 55).cast("string"))
        return ((rest * F.when(F.length(value) == 1, 10).otherwise(100) + value.cast("int")) % 97).cast("int")

    return F.aggregate(chars(x), F.lit(0), add)


def iban_plain(x: Column) -> Column:
    return F.regexp_replace(x, " ", "")


def iban_valid(x: Column) -> Column:
    plain = iban_plain(x)
    return mod_97(F.concat(F.substring(plain, F.lit(5), F.length(plain) - 4), F.substring(plain, 1, 4))) == 1


def account_permuted(pattern: str, alphabet: str):
    def permuted(x: Column, params: PiiParams) -> Column:
        return F.concat(F.substring(x, 1, 4), permuted_class(F.substring(x, F.lit(5), F.length(x) - 4), pattern, alphabet, "iban", params))

    return permuted


def with_iban_digits(x: Column, params: PiiParams) -> Column:
    plain = iban_plain(x)
    country = F.substring(plain, 1, 2)
    account = F.substring(plain, F.lit(5), F.length(plain) - 4)
    check = F.lpad((98 - mod_97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    return F.concat(country, check, F.substring(x, F.lit(5), F.length(x) - 4))


def permuted_phone(x: Column, params: PiiParams) -> Column:
    code = F.regexp_extract(x, r"^(\+[0-9]{1,3}(?=[ .(-])|\+[0-9]{2}|1[.-])", 1)
    rest = F.substring(x, F.length(code) + 1, F.length(x))
    return F.concat(code, permuted_class(rest, "0-9", DIGITS, "phone", params))


def permuted_ssn(x: Column, params: PiiParams) -> Column:
    part = lambda at, n: F.substring(x, at, n).cast("int")
    area = part(1, 3) - F.when(part(1, 3) > 666, 2).otherwise(1)
    moved = permuted_pair(area, (part(5, 2) - 1) * 9999 + part(8, 4) - 1, 898, 99 * 9999, "ssn", params)
    area = moved["a"] + F.when(moved["a"] >= 665, 2).otherwise(1)
    pad = lambda v, n: F.lpad(v.cast("string"), n, "0")
    return F.concat_ws("-", pad(area, 3), pad(F.floor(moved["b"] / 9999) + 1, 2), pad(moved["b"] % 9999 + 1, 4))


def permuted_ipv4(x: Column, params: PiiParams) -> Column:
    o = F.transform(F.split(x, r"\."), lambda s: s.cast("long"))
    moved = permuted_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ipv4", params)
    return F.concat_ws(".", *((F.floor(moved[h] / 256) if high else moved[h] % 256).cast("long").cast("string") for h in "ab" for high in (True, False)))


def permuted_below(x: Column, size: int, size_a: int, size_b: int, kind: str, params: PiiParams) -> Column:
    """A permutation of the numbers below ``size``, which is at most size_a * size_b.

    A Feistel image at or over ``size`` is permuted again until it is below: as no number comes up twice on the
    way, as many times as there are numbers over ``size`` are always enough.
    """

    def once(at: Column) -> Column:
        moved = permuted_pair(F.floor(at / size_b), at % size_b, size_a, size_b, kind, params)
        return moved["a"] * size_b + moved["b"]

    walk = F.sequence(F.lit(1), F.lit(size_a * size_b - size))
    return F.aggregate(walk, once(x.cast("long")), lambda at, _: F.when(at >= size, once(at)).otherwise(at))


FIRST_DAY = "1900-01-01"
DAYS = 73_049, 271, 270  # days of 1900 to 2099, and two factors of a little more
LATE_DAYS = 44_249, 211, 210  # of these the ones after the 12th of their month, which only day/month/year can name


def read_date(x: Column) -> Column:
    """The day a date string names, null if none; month first between slashes where that is a day."""
    iso = F.try_to_date(x, "yyyy-M-d")
    dotted = F.try_to_date(x, "d.M.yyyy")
    return F.when(x.contains("-"), iso).when(x.contains("."), dotted).otherwise(F.coalesce(F.try_to_date(x, "M/d/yyyy"), F.try_to_date(x, "d/M/yyyy")))


def month_start(month: Column) -> Column:
    """The number of the first day of a month, both counted from FIRST_DAY."""
    first = F.lit(FIRST_DAY).cast("date")
    return F.datediff(F.add_months(first, month), first)


def permuted_late_day(day: Column, params: PiiParams) -> Column:
    """A day number after the 12th of its month as another such day, through its rank among them."""
    date = F.date_add(F.lit(FIRST_DAY).cast("date"), day)
    months = (F.year(date) - 1900) * 12 + F.month(date) - 1
    rank = permuted_below(day - 12 * months - 12, *LATE_DAYS, "date/", params)

    def placed(at: Column) -> Column:
        near = F.floor(at / (LATE_DAYS[0] / 2400)).cast("int")  # the month is at most a few from here
        in_range = F.filter(F.sequence(near - 4, near + 4), lambda m: (m >= 0) & (m < 2400) & (month_start(m) - 12 * m <= at))
        return F.transform(F.array(F.array_max(in_range)), lambda m: (month_start(m) + at - (month_start(m) - 12 * m) + 12).cast("int"))[0]

    return F.transform(F.array(rank), placed)[0]


def permuted_date(x: Column, params: PiiParams) -> Column:
    """Dates in one form are permuted among the dates of 1900 to 2099; day/month/year ones, which no month/day/year
    reading fits, among those like them. Equal dates stay equal across the other forms."""
    month_first = F.try_to_date(x, "M/d/yyyy").isNotNull()
    late = x.contains("/") & ~month_first
    day = F.datediff(read_date(x), F.lit(FIRST_DAY).cast("date"))
    moved = F.when(late, permuted_late_day(day, params)).otherwise(permuted_below(day, *DAYS, "date", params))
    to = F.date_add(F.lit(FIRST_DAY).cast("date"), moved.cast("int"))
    wide = x.rlike("(^|[^0-9])0[0-9]|[0-9]{2}[./-][0-9]{2}")
    shape = lambda two, one: F.when(wide, F.date_format(to, two)).otherwise(F.date_format(to, one))
    return (
        F.when(x.contains("-"), shape("yyyy-MM-dd", "yyyy-M-d"))
        .when(x.contains("."), shape("dd.MM.yyyy", "d.M.yyyy"))
        .when(month_first, shape("MM/dd/yyyy", "M/d/yyyy"))
        .otherwise(shape("dd/MM/yyyy", "d/M/yyyy"))
    )


def local_permuted(pattern: str, alphabet: str):
    def permuted(x: Column, params: PiiParams) -> Column:
        local, domain = F.substring_index(x, "@", 1), F.substring_index(x, "@", -1)
        return F.concat(permuted_class(local, pattern, alphabet, "email", params), F.lit("@"), domain)

    return permuted


def permuted_secret(x: Column, params: PiiParams) -> Column:
    lower = permuted_symbols(F.lower(x), DIGITS + "abcdef", "secret", params)
    return F.when(x == F.lower(x), lower).otherwise(F.upper(lower))


def form_of(x: Column) -> Column:
    """The kind of a matched string by its form."""
    found = F.when(x.contains("@"), F.lit("email"))
    for kind in KINDS[1:]:
        found = found.when(x.rlike(f"^(?:{PATTERNS[kind].replace(chr(92) + '2', chr(92) + '1')})$"), F.lit(kind))
    return found


VALID = {"iban": iban_valid, "card": lambda x: luhn_sum(digits_of(x)) % 10 == 0, "date": lambda x: read_date(x).isNotNull()}
#: One step a column expression: each is small, and none holds a copy of the one before.
STEPS = (
    ("email", local_permuted("a-z", LOWER)),
    ("email", local_permuted("A-Z", UPPER)),
    ("email", local_permuted("0-9", DIGITS)),
    ("secret", permuted_secret),
    ("iban", account_permuted("0-9", DIGITS)),
    ("iban", account_permuted("A-Z", UPPER)),
    ("iban", with_iban_digits),
    ("date", permuted_date),
    ("ipv4", permuted_ipv4),
    ("ssn", permuted_ssn),
    ("phone", permuted_phone),
    ("card", permuted_but_last),
    ("card", lambda x, _: with_luhn_digit(x)),
)


def checked(kind: str, valid):
    return lambda f: F.struct(F.when((f["kind"] != kind) | valid(f["value"]), f["kind"]).alias("kind"), f["value"].alias("value"))


def moved(kind: str, permuted, params: PiiParams):
    return lambda f: F.struct(f["kind"].alias("kind"), F.when(f["kind"] == kind, permuted(f["value"], params)).otherwise(f["value"]).alias("value"))


def unused(name: str, df: DataFrame) -> str:
    """``name``, with as many underscores behind it as no column of ``df`` has."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def pseudonymise(docs: DataFrame, params: PiiParams = PiiParams(), text_col: str = "text", counts_col: str | None = "pii_counts") -> DataFrame:
    """``docs`` with pseudonyms in its text and, if asked for, a map of kind to number of values in ``counts_col``,
    behind whose name underscores are set where ``docs`` has such a column."""
    text = F.col(text_col).cast("string")
    some = text.rlike("[0-9@]")
    matches = F.when(some, F.regexp_extract_all(text, F.lit(PII), F.lit(0))).otherwise(F.array().cast("array<string>"))
    found, between = unused("__pii_found", docs), unused("__pii_between", docs)
    counts_col = counts_col and unused(counts_col, docs)
    first = F.transform(matches, lambda m: F.struct(form_of(m).alias("kind"), m.alias("value")))
    rows = docs.withColumn(found, first).withColumn(between, F.when(F.size(found) > 0, F.split(text, PII, -1)))
    for kind, valid in VALID.items():
        rows = rows.withColumn(found, F.transform(found, checked(kind, valid)))
    for kind, permuted in STEPS:
        rows = rows.withColumn(found, F.transform(found, moved(kind, permuted, params)))
    pieces = F.transform(found, lambda f, i: F.concat(f["value"], F.element_at(between, i + 2)))
    whole = F.when(F.size(found) > 0, F.concat(F.element_at(between, 1), F.array_join(pieces, ""))).otherwise(text)
    rows = rows.withColumn(text_col, whole)
    if counts_col:
        counts = F.map_from_entries(F.transform(F.array(*map(F.lit, KINDS)), lambda k: F.struct(k, F.size(F.filter(found, lambda f: f["kind"] == k)).cast("long"))))
        rows = rows.withColumn(counts_col, F.map_filter(counts, lambda _, n: n > 0))
    return rows.drop(found, between)
