"""PII: format-preserving pseudonyms by a keyed Feistel permutation, in DataFrame functions only.

What is found is first validated (cards by Luhn's rule, addresses by their octets, dates by the calendar).
Its variable characters become digits in their own radix (10 for digits, 26 for letters, 16 for hex, 256 for
octets); the two halves of that sequence are shifted in turn, digit by digit, by a keyed hash of the other
half. Every round can be undone, so each kind of value is permuted within its format: equal values get
equal pseudonyms in every document, different ones stay different."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import renamed, table

ROUNDS = 8
#: Days that dates are permuted among: 1900-01-01 to 2099-12-31.
FIRST_DAY, DAYS = "1900-01-01", 73049
#: Other dates of four-digit years are permuted among themselves: days from 0001-01-01 to 9999-12-31.
EARLIEST_DAY, ALL_DAYS = "0001-01-01", 3652059
#: Hex digits that are permuted at once; longer secrets are cut into pieces.
PIECE = 128

# A host name has at most 127 labels; the bound also keeps the matcher's recursion shallow.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,125}\.[A-Za-z]{2,}"
SECRET = r"(?<![A-Za-z0-9])[0-9a-f]{32,}+(?![A-Za-z0-9])"
ADDRESS = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"
DATE = r"(?<!\d)\d{4}-\d{2}-\d{2}(?!\d)"
SOCIAL = r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)"
PHONE = r"(?<!\d)(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?!\d)"
ANY = "|".join([EMAIL, SECRET, ADDRESS, DATE, SOCIAL, PHONE, CARD])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def feistel(digits: Column, radices: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the arrays of ints whose j-th element is below the j-th radix."""
    n = F.size(digits)
    half = F.floor(n / 2).cast("int")

    def mixed(own: Column, radix: Column, other: Column, i: Column) -> Column:
        seed = F.concat_ws("|", F.lit(key), F.lit(kind), F.size(own).cast("string"), i.cast("string"), F.array_join(other.cast("array<string>"), ","))

        def shifted(x: Column, j: Column) -> Column:
            word = F.conv(F.substring(F.sha2(F.concat_ws("|", seed, j.cast("string")), 256), 1, 8), 16, 10).cast("bigint")
            return F.pmod(x + word, F.get(radix, j)).cast("int")

        return F.transform(own, shifted)

    a, b = F.slice(radices, F.lit(1), half), F.slice(radices, half + 1, n - half)
    start = F.struct(F.slice(digits, F.lit(1), half).alias("a"), F.slice(digits, half + 1, n - half).alias("b"))

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, mixed(s["a"], a, s["b"], i)).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(mixed(s["b"], b, s["a"], i)).alias("b"))

    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), start, step, lambda s: F.concat(s["a"], s["b"]))


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _permuted(text: Column, key: str, kind: str, alphabet: str | None = None) -> Column:
    """The text with its letters and digits (or those of ``alphabet``) permuted, each within its class."""

    def radix(c: Column) -> Column:
        if alphabet:
            return F.when(F.instr(F.lit(alphabet), c) > 0, len(alphabet)).otherwise(1)
        return F.when(c.rlike("[0-9]"), 10).when(c.rlike("[A-Za-z]"), 26).otherwise(1)

    def value(c: Column) -> Column:
        if alphabet:
            return F.greatest(F.instr(F.lit(alphabet), c) - 1, F.lit(0))
        return F.when(c.rlike("[0-9]"), F.ascii(c) - 48).when(c.rlike("[a-z]"), F.ascii(c) - 97).when(c.rlike("[A-Z]"), F.ascii(c) - 65).otherwise(0)

    def back(c: Column, v: Column) -> Column:
        if alphabet:
            return F.when(F.instr(F.lit(alphabet), c) > 0, F.substring(F.lit(alphabet), v + 1, F.lit(1))).otherwise(c)
        return F.when(c.rlike("[0-9]"), F.char(v + 48)).when(c.rlike("[a-z]"), F.char(v + 97)).when(c.rlike("[A-Z]"), F.char(v + 65)).otherwise(c)

    return let(_characters(text), lambda cs: F.array_join(F.zip_with(cs, feistel(F.transform(cs, value), F.transform(cs, radix), key, kind), back), ""))


def _numbers(text: Column) -> Column:
    return F.transform(_characters(F.regexp_replace(text, "[^0-9]", "")), lambda c: c.cast("int"))


def _luhn(digits: Column, from_right: int) -> Column:
    """Luhn's sum; ``from_right`` is the place of the last digit (0 for the check digit)."""

    def weight(d: Column, i: Column) -> Column:
        twice = (F.size(digits) - 1 - i + from_right) % 2 == 1
        return F.when(twice, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(digits, weight), F.lit(0), lambda a, x: a + x)


def _refilled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in order."""
    parts = F.split(shape, "[0-9]", -1)
    return F.array_join(F.zip_with(parts, digits, lambda p, d: F.concat(p, F.coalesce(d.cast("string"), F.lit("")))), "")


def _tens(digits: Column) -> Column:
    return F.transform(digits, lambda _: F.lit(10))


def _card(m: Column, key: str) -> Column:
    def valid(ds: Column) -> Column:
        body = F.slice(ds, F.lit(1), F.size(ds) - 1)
        new = let(feistel(body, _tens(body), key, "card"), lambda p: F.concat(p, F.array(F.pmod(-_luhn(p, 1), F.lit(10)))))
        return F.when(_luhn(ds, 0) % 10 == 0, _refilled(m, new))

    return let(_numbers(m), valid)


def _address(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, "\\."), lambda x: x.cast("int"))
    return let(octets, lambda o: F.when(F.array_max(o) < 256, F.array_join(feistel(o, F.transform(o, lambda _: F.lit(256)), key, "address").cast("array<string>"), ".")))


def _secret(m: Column, key: str) -> Column:
    at = F.sequence(F.lit(0), F.floor((F.length(m) - 1) / PIECE).cast("int"))
    return F.array_join(F.transform(at, lambda i: _permuted(F.substring(m, i * PIECE + 1, F.lit(PIECE)), key, "secret", "0123456789abcdef")), "")


def _walked(start_day: Column, places: int, within: Callable[[Column], Column], first: str, key: str, kind: str) -> Column:
    """The date that walking the permutation of ``places`` digits from a day after ``first`` meets first ``within`` the range."""

    def step(day: Column) -> Column:
        digits = F.transform(F.array(*[F.lit(10**k) for k in reversed(range(places))]), lambda p: (F.floor(day / p) % 10).cast("int"))
        return F.aggregate(let(digits, lambda d: feistel(d, _tens(d), key, kind)), F.lit(0), lambda a, d: a * 10 + d)

    start = F.struct(start_day.alias("day"), F.lit(False).alias("done"))

    def walk(s: Column, _: Column) -> Column:
        return F.when(s["done"], s).otherwise(let(step(s["day"]), lambda d: F.struct(d.alias("day"), within(d).alias("done"))))

    found = F.aggregate(F.array_repeat(F.lit(0), 64), start, walk, lambda s: F.when(s["done"], s["day"]))
    return F.date_format(F.date_add(F.lit(first).cast("date"), found.cast("int")), "yyyy-MM-dd")


def _date(m: Column, key: str) -> Column:
    """Dates walk the permutation of five digits (seven, outside 1900-2099) until they meet a day of their range again."""
    date = F.try_to_timestamp(m, F.lit("yyyy-MM-dd")).cast("date")
    day = F.datediff(date, F.lit(FIRST_DAY).cast("date"))
    far = F.datediff(date, F.lit(EARLIEST_DAY).cast("date"))
    skip = 693595  # days from EARLIEST_DAY to FIRST_DAY
    other = lambda d: (d < ALL_DAYS) & ~((d >= skip) & (d < skip + DAYS))
    return F.when((day >= 0) & (day < DAYS), _walked(day, 5, lambda d: d < DAYS, FIRST_DAY, key, "date")).when(other(far), _walked(far, 7, other, EARLIEST_DAY, key, "far date"))


def _social(m: Column, key: str) -> Column:
    """Numbers of areas, groups and series that are issued walk the permutation until they meet such a number again."""

    def valid(d: Column) -> Column:
        digit = lambda k: F.get(d, F.lit(k))
        area = digit(0) * 100 + digit(1) * 10 + digit(2)
        return ~area.isin(0, 666) & (area < 900) & (digit(3) + digit(4) > 0) & (digit(5) + digit(6) + digit(7) + digit(8) > 0)

    def step(s: Column, _: Column) -> Column:
        return F.when(s["done"], s).otherwise(let(feistel(s["d"], _tens(s["d"]), key, "social"), lambda d: F.struct(d.alias("d"), valid(d).alias("done"))))

    start = lambda d: F.struct(d.alias("d"), F.lit(False).alias("done"))
    walk = lambda d: F.aggregate(F.array_repeat(F.lit(0), 64), start(d), step, lambda s: F.when(s["done"], _refilled(m, s["d"])))
    return let(_numbers(m), lambda d: F.when(valid(d), walk(d)))


def _email(m: Column, key: str) -> Column:
    name = F.regexp_extract(m, r"^(.*)(\.[A-Za-z]+)$", 1)
    return F.concat(_permuted(name, key, "email"), F.regexp_extract(m, r"(\.[A-Za-z]+)$", 1))


def _phone(m: Column, key: str) -> Column:
    country = F.regexp_extract(m, r"^(\+\d{1,3}[ .-]?)?", 0)
    rest = F.substring(m, F.length(country) + 1, F.length(m))
    return F.concat(country, let(_numbers(rest), lambda d: _refilled(rest, feistel(d, _tens(d), key, "phone"))))


def pseudonym(found: Column, key: str) -> Column:
    """The pseudonym of one match of ``ANY``; what isn't valid stays."""
    new = (
        F.when(found.contains("@"), _email(found, key))
        .when(found.rlike("^[0-9a-f]{32,}$"), _secret(found, key))
        .when(found.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), _address(found, key))
        .when(found.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), _date(found, key))
        .when(found.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), _social(found, key))
        .when(found.rlike("^[0-9]{13,19}$|^[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -]|^[0-9]{4}[ -][0-9]{6}[ -]"), _card(found, key))
        .otherwise(_phone(found, key))
    )
    return F.coalesce(new, found)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with the personal data in its text replaced; all other columns stay.

    Covers e-mail addresses, phone and social security numbers, cards, IPv4 addresses, ISO dates and hex secrets; of
    these, all but mail, phones and secrets that aren't valid stay. Null texts stay null; a text without a match, an empty one among them, stays as it is; very long texts are taken whole;
    repeated rows are treated alike and stay; an empty table gives no rows; other columns may have any names.
    ``count_col`` names a column for the number of values that were replaced. Keep ``key`` secret: who has it can undo
    the permutation. It is a literal of the plan: where plans are logged, set ``spark.sql.redaction.string.regex``.
    """
    names, (wide, at) = docs.columns, renamed(docs)
    column = at[text_col]
    text = F.col(column).cast("string")
    some = text.rlike("[0-9@]")
    wide = wide.withColumn("found", F.when(some, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    wide = wide.withColumn("new", F.transform("found", lambda m: pseudonym(m, key)))
    parts = F.split(text, ANY, -1)
    joined = F.array_join(F.zip_with(parts, F.col("new"), lambda p, n: F.concat(p, F.coalesce(n, F.lit("")))), "")
    n = F.coalesce(F.aggregate(F.zip_with("found", "new", lambda a, b: (a != b).cast("int")), F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    new = F.when(F.size("found") > 0, joined).otherwise(text)
    out = wide.select(*[new if at[c] == column else F.col(at[c]) for c in names], *([n] if count_col else []))
    return out.toDF(*names, *([count_col] if count_col else []))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), "public example key", count_col="n_replaced")
