r"""Personal data replaced by format-preserving pseudonyms.

Found and validated: payment cards (13 to 19 digits with a right check digit, in one run or in groups), North American
and international telephone numbers, IPv4 addresses, social security numbers, calendar dates of 1900 to 2099, and
e-mail addresses. What fails validation stays as it is, and so do IBANs, IPv6 addresses and other kinds of number. A local
part is taken whole, however long; a host name has at most ``LABELS`` labels before its top level, as names have 253
characters. Every repetition of a group in the patterns is bounded and no other one goes back, so that no text is too long for them.

A number is split in two parts over Z_m x Z_n and goes through a Feistel network: in turn each part is shifted by a
keyed hash of the other, modulo its own size. Every round can be undone, so this is a permutation of exactly the valid
values: a card keeps its length, first digit and separators and gets its check digit anew; a telephone number keeps
country code and shape; a date keeps its century and layout, and where a day over 12 shows that it comes first
(17/02/1980 beside 02/17/1980) the permutation is applied until it gives such a day again, so that no other date meets it; a social security number moves among all valid ones, area
included. Permutations depend on the key and the kind of number only, so equal values stay equal across documents and
different numbers and dates different. E-mail addresses, whose alphabet has no fixed size, get letters and digits from
a keyed hash in the same shape; their domain stays. Equal ones stay equal, but two short ones may meet.

The main path is built-in column functions: matches are cut out, replaced and put back between the pieces around them.
Nothing is shuffled.

Defined cases: null texts stay null, texts without a match are returned as they are; very long texts are one row;
repeated rows are treated alike; an empty table gives no rows; other columns stay, those named ``pii_<kind>`` are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import unused

ROUNDS = 8
KINDS = ("email", "card", "phone", "ip", "ssn", "date")
#: Days of the two centuries as products of two factors, for an exact two-part domain.
CENTURIES = {"19": (92, 397), "20": (75, 487)}
#: Labels of a host name that are read before its top level, at most.
LABELS = 126
#: A walk over dates that stays outside its set of three in five for so many steps has a chance below 1e-20; it ends the job.
STEPS = 64
#: A label begins and ends with a letter or digit; each is taken whole or not at all.
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?:(?!-)[A-Za-z0-9\-]{1,63}+(?<!-)\.){1," + str(LABELS) + r"}[A-Za-z]{2,24}"
CARD = r"(?<![\d.])(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{4}|\d{4}([ \-])\d{6}\2\d{5})(?!\d)"
#: Java's look behind takes no repeated group.
_DIGIT = r"[ .\-/()]{0,3}\d"
#: The look behind holds a number to 15 digits, so that one with another number after it still matches.
PHONE = r"(?<![\d+])(?:(?:\+?1[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[ .\-])[2-9]\d{2}[ .\-]\d{4}|\+1\d{3}[2-9]\d{6}|\+[2-9]\d{0,2}(?:[ .\-/]?\(?\d{2,4}\)?){2,4}" + f"(?<!\\+{_DIGIT * 16}{f'(?:{_DIGIT})?' * 3})" + r")(?!\d)"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)"
SSN = r"(?<![\d\-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d\-])"
DATE = r"(?<![\d./\-])(?:(?:19|20)\d{2}-\d{2}-\d{2}|\d{2}\.\d{2}\.(?:19|20)\d{2}|\d{2}/\d{2}/(?:19|20)\d{2})(?![\d/\-]|\.\d)"
#: Group references count from the whole pattern's start: cards come second and hold the only groups.
ANY = "|".join(f"(?:{p})" for p in (EMAIL, CARD, PHONE, IP, SSN, DATE))


def _keyed(key: str, kind: str, *parts: Column) -> Column:
    """48 bits of a keyed hash."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), *parts), 256), 1, 12), 16, 10).cast("long")


def feistel(a: Column, b: Column, m: int, n: int, key: str, kind: str, rounds: int = ROUNDS) -> Column:
    """Struct ``a, b``: the image of (a, b) in Z_m x Z_n under a keyed permutation."""

    def step(s: Column, i: Column) -> Column:
        first = i % 2 == 0
        x = F.when(first, (s["a"] + _keyed(key, kind, i.cast("string"), s["b"].cast("string")) % m) % m).otherwise(s["a"])
        y = F.when(first, s["b"]).otherwise((s["b"] + _keyed(key, kind, i.cast("string"), s["a"].cast("string")) % n) % n)
        return F.struct(x.cast("long").alias("a"), y.cast("long").alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def _check_sum(digits: Column) -> Column:
    """Sum of a digit string by the rule for payment cards; a right number gives a multiple of 10."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int") * (i % 2 + 1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in turn by ``digits``."""
    step = lambda s, c: F.when(c.rlike(r"\A\d\z"), F.struct(F.concat(s["out"], F.substr(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))
    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step, lambda s: s["out"])


def _pad(x: Column, n: int) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def _by_length(digits: Column, key: str, kind: str, lengths: range) -> Column:
    """Permute a digit string among all of its length."""

    def of(n: int) -> Column:
        i = n // 2
        moved = feistel(F.substring(digits, 1, i), F.substring(digits, i + 1, n - i), 10**i, 10 ** (n - i), key, f"{kind}{n}")
        return _let(moved, lambda s: F.concat(_pad(s["a"], i), _pad(s["b"], n - i)))

    out = F.lit(None).cast("string")
    for n in lengths:
        out = F.when(F.length(digits) == n, of(n)).otherwise(out)
    return out


def _card(x: Column, key: str) -> Column:
    def change(d: Column) -> Column:
        kept = F.substring(d, 1, 1)
        inner = F.concat(kept, _by_length(F.substr(d, F.lit(2), F.length(d) - 2), key, "card", range(11, 18)))
        return _let(inner, lambda y: F.concat(y, ((10 - _check_sum(F.concat(y, F.lit("0"))) % 10) % 10).cast("string")))

    return _let(_digits(x), lambda d: F.when(_check_sum(d) % 10 == 0, _refill(x, change(d))))


def _phone(x: Column, key: str) -> Column:
    def change(d: Column) -> Column:
        n = F.right(d, F.lit(10))
        local = _let(feistel(F.substring(n, 1, 3).cast("long"), (F.substring(n, 4, 3).cast("long") - 200) * 10_000 + F.substring(n, 7, 4).cast("long"), 1000, 8_000_000, key, "phone"), lambda s: F.concat(_pad(s["a"], 3), (F.floor(s["b"] / 10_000) + 200).cast("string"), _pad(s["b"] % 10_000, 4)))
        ours = ~x.rlike(r"\A\+[2-9]") & (F.length(d) <= 11)
        abroad = F.when(F.length(d).between(8, 15), F.concat(F.substring(d, 1, 3), _by_length(F.substr(d, F.lit(4), F.length(d) - 3), key, "abroad", range(5, 13))))
        return F.when(ours, F.concat(F.substr(d, F.lit(1), F.length(d) - 10), local)).otherwise(abroad)

    return _let(_digits(x), lambda d: _refill(x, change(d)))


def _ip(x: Column, key: str) -> Column:
    def change(p: Column) -> Column:
        s = feistel(F.get(p, 0).cast("long") * 256 + F.get(p, 1).cast("long"), F.get(p, 2).cast("long") * 256 + F.get(p, 3).cast("long"), 65536, 65536, key, "ip")
        return _let(s, lambda s: F.concat_ws(".", F.floor(s["a"] / 256).cast("string"), (s["a"] % 256).cast("string"), F.floor(s["b"] / 256).cast("string"), (s["b"] % 256).cast("string")))

    return _let(F.split(x, r"\."), change)


def _ssn(x: Column, key: str) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    area = F.substring(x, 1, 3).cast("long")
    place = area - F.when(area > 666, 2).otherwise(1)
    s = feistel(place * 99 + F.substring(x, 5, 2).cast("long") - 1, F.substring(x, 8, 4).cast("long") - 1, 898 * 99, 9999, key, "ssn")

    def shown(s: Column) -> Column:
        at = F.floor(s["a"] / 99)
        return F.concat(_pad(at + F.when(at >= 665, 2).otherwise(1), 3), F.lit("-"), _pad(s["a"] % 99 + 1, 2), F.lit("-"), _pad(s["b"] + 1, 4))

    return _let(s, shown)


def _date(x: Column, key: str) -> Column:
    """Year first, or day.month.year, or month/day/year (day/month/year where the month would exceed 12)."""
    year_first, dotted = F.substring(x, 5, 1) == "-", F.substring(x, 3, 1) == "."
    a, b, y = F.substring(x, 1, 2), F.substring(x, 4, 2), F.substring(x, 7, 4)
    day_first = dotted | (a > "12")
    iso = F.when(year_first, x).when(day_first, F.concat_ws("-", y, b, a)).otherwise(F.concat_ws("-", y, a, b))

    def within(day: Column, century: str, m: int, n: int) -> Column:
        begin = F.to_date(F.lit(f"{century}00-01-01"))
        k = F.date_diff(day, begin).cast("long")
        at = lambda s: F.date_add(begin, (s["a"] * n + s["b"]).cast("int"))
        once = lambda s: feistel(s["a"], s["b"], m, n, key, f"date{century}")
        late = lambda s: F.dayofmonth(at(s)) > 12
        walk = lambda s: F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), s, lambda s, _: F.when(late(s), s).otherwise(once(s)), lambda s: F.when(late(s), s).otherwise(F.raise_error(F.lit("a walk over dates did not end"))))
        first = feistel(F.floor(k / n), k % n, m, n, key, f"date{century}")
        moved = _let(F.when(day_first & ~dotted & ~year_first, _let(first, walk)).otherwise(first), at)
        return _let(moved, lambda d: F.when(year_first, F.date_format(d, "yyyy-MM-dd")).when(dotted, F.date_format(d, "dd.MM.yyyy")).when(day_first, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy")))

    def change(day: Column) -> Column:
        out = F.lit(None).cast("string")
        for century, (m, n) in CENTURIES.items():
            out = F.when(F.year(day).between(int(century) * 100, int(century) * 100 + 99), within(day, century, m, n)).otherwise(out)
        return out

    return _let(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"), change)


def _email(x: Column, key: str) -> Column:
    def change(local: Column) -> Column:
        def char(c: Column, i: Column) -> Column:
            h = _keyed(key, "email", F.lower(x), i.cast("string"))
            pick = lambda letters: F.substr(F.lit(letters), (h % len(letters) + 1).cast("int"), F.lit(1))
            return F.when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(c.rlike("[0-9]"), pick("0123456789")).otherwise(c)

        return F.array_join(F.transform(F.split(local, ""), char), "")

    return F.concat(_let(F.substring_index(x, "@", 1), change), F.lit("@"), F.substring_index(x, "@", -1))


def pseudonym(x: Column, key: str) -> Column:
    """Struct ``kind, value`` of a match: its kind and pseudonym, or a null kind and the match itself."""
    whole = lambda p: x.rlike(r"\A(?:" + p + r")\z")
    named = lambda kind, value: _let(value, lambda v: F.when(v.isNotNull(), F.struct(F.lit(kind).alias("kind"), v.alias("value"))))
    none = F.struct(F.lit(None).cast("string").alias("kind"), x.alias("value"))
    tried = F.when(whole(EMAIL), named("email", _email(x, key))).when(whole(SSN), named("ssn", _ssn(x, key))).when(whole(DATE), named("date", _date(x, key))).when(whole(IP), named("ip", _ip(x, key))).when(whole(CARD), named("card", _card(x, key))).when(whole(PHONE), named("phone", _phone(x, key)))
    return F.coalesce(tried, none)


def pseudonymise(df: DataFrame, key: str, *, text: str = "text") -> DataFrame:
    """``df`` with pseudonyms in ``text``, and ``pii_<kind> int``: how many values of each kind were replaced."""
    names = [f"pii_{k}" for k in KINDS]
    new = unused(df, "new")
    found = F.when(F.col(text).rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    out = df.drop(*names).withColumn(new, F.transform(found, lambda x: pseudonym(x, key)))
    around = F.split(F.col(text), ANY, -1)
    joined = F.array_join(F.zip_with(around, F.concat(F.transform(new, lambda s: s["value"]), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    out = out.withColumn(text, F.when(F.size(new) > 0, joined).otherwise(F.col(text)))
    for k, n in zip(KINDS, names, strict=True):
        out = out.withColumn(n, F.when(F.size(new) > 0, F.size(F.array_remove(F.transform(new, lambda s: F.coalesce(s["kind"] == F.lit(k), F.lit(False))), False))).otherwise(0))
    return out.drop(new)
