"""Format-preserving pseudonyms for personal data, in SQL functions only.

Found and validated values are permuted within their own format by keyed Feistel rounds, so equal values get equal pseudonyms in all documents and
different values different ones:

* payment card numbers (13 to 19 digits, Luhn sum right): all digits but the last are permuted, the last is the new check digit;
* phone numbers: the digits after the country code; social security numbers (issued ranges only): number within those ranges;
* IPv4 addresses (parts up to 255): the 32 bits;
* dates (real calendar days): day number within the 400-year cycle from 1800 on; other years are left;
* mail addresses: the letters and digits before the @ by a keyed digest of the address, of the same length, and a reserved domain;
* secrets given as a quoted value of a key, token, password or secret: a keyed digest in hexadecimal, of the same length up to 64.

Spaces, dashes, brackets and points of a value stay where they are. Numbers that fail validation are left alone.

A text without a digit and without an @ is passed through unread. The rest is cut at the matches of one pattern, and matches are replaced one by one; nothing is
shuffled, so a hot key can't matter. A null text stays null and an empty one empty; repeated rows give repeated results; other columns are not touched.

The key is a secret of the caller; the default serves tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "example key"
ROUNDS = 8
# Days of the 400-year calendar cycle: 146097 = 189 * 773.
CYCLE_START = "1800-01-01"
CYCLE = (189, 773)
# Social security numbers: 898 areas (001-899 without 666), 99 groups, 9999 serials.
SSN = (898, 99 * 9999)

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9])"
SECRET = r"(?i:(?:api[_-]?key|token|password|passwd|secret)\s{0,3}[=:]\s{0,3}\"[^\"\s]{8,256}\")"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
PHONE = r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9+])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9+-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])"
SSN_SHAPE = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9]|[./-][0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
ANY = "|".join(f"(?:{p})" for p in (EMAIL, SECRET, IP, DATE, SSN_SHAPE, PHONE, CARD))

KINDS = ["mail", "secret", "ip", "date", "ssn", "phone", "card"]


def _mix(key: str, kind: str, step: Column, value: Column, size) -> Column:
    """Keyed number below ``size``: 60 bits of a digest of round, kind and value."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), value.cast("string"))
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long"), size)


def feistel(value: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """Permute 0 .. a * b - 1: alternating rounds add a keyed number of one half to the other."""
    a, b = a.cast("long"), b.cast("long")
    start = F.struct(F.floor(value / b).cast("long").alias("x"), F.pmod(value, b).alias("y"))

    def turn(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(F.when(odd, F.pmod(s["x"] + _mix(key, kind, i, s["y"], a), a)).otherwise(s["x"]).alias("x"),
                        F.when(odd, s["y"]).otherwise(F.pmod(s["y"] + _mix(key, kind, i, s["x"], b), b)).alias("y"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: s["x"] * b + s["y"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _power(n: Column) -> Column:
    """10 ** n as a long."""
    return F.rpad(F.lit("1"), (n + 1).cast("int"), "0").cast("long")


def permute_digits(d: Column, key: str, kind: str) -> Column:
    """Another string of as many digits: the two halves are the halves of the Feistel rounds, so up to 36 digits are longs."""
    half = F.floor(F.length(d) / 2).cast("int")
    rest = F.length(d) - half
    a, b = _power(half), _power(rest)
    start = F.struct(F.coalesce(F.substring(d, F.lit(1), half).try_cast("long"), F.lit(0)).alias("x"), F.substring(d, half + 1, rest).cast("long").alias("y"))

    def turn(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(F.when(odd, F.pmod(s["x"] + _mix(key, kind, i, s["y"], a), a)).otherwise(s["x"]).alias("x"),
                        F.when(odd, s["y"]).otherwise(F.pmod(s["y"] + _mix(key, kind, i, s["x"], b), b)).alias("y"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn,
                       lambda s: F.concat(F.when(half > 0, F.lpad(s["x"].cast("string"), half, "0")).otherwise(""), F.lpad(s["y"].cast("string"), rest, "0")))


def _digit_sum(d: Column) -> Column:
    """Luhn sum of a digit string, the last digit not doubled."""
    n = F.length(d)

    def add(total: Column, i: Column) -> Column:
        v = F.substring(d, i, F.lit(1)).cast("int")
        twice = (n - i) % 2 == 1
        return total + F.when(twice, v * 2 - F.when(v > 4, 9).otherwise(0)).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _put_back(shape: Column, d: Column, skip: Column | int = 0) -> Column:
    """Digits ``d`` in the places of the digits of ``shape`` after the first ``skip`` characters, which stay."""
    skip = F.lit(skip) if isinstance(skip, int) else skip
    lead, tail = F.substring(shape, F.lit(1), skip), F.substring(shape, skip + 1, F.length(shape))

    def place(s: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.struct(F.concat(s["t"], F.when(digit, F.substring(d, s["k"], F.lit(1))).otherwise(c)).alias("t"), (s["k"] + digit.cast("int")).alias("k"))

    return F.concat(lead, F.aggregate(F.filter(F.split(tail, ""), lambda c: c != ""), F.struct(F.lit("").alias("t"), F.lit(1).alias("k")), place, lambda s: s["t"]))


def _card(m: Column, key: str) -> Column:
    d = _digits(m)
    body = F.transform(F.array(d), lambda x: permute_digits(F.substring(x, F.lit(1), F.length(x) - 1), key, "card"))[0]
    closed = F.transform(F.array(body), lambda x: F.concat(x, F.pmod(-_digit_sum(F.concat(x, F.lit("0"))), F.lit(10)).cast("string")))[0]
    return F.transform(F.array(closed), lambda x: _put_back(m, x))[0]


def _phone(m: Column, key: str) -> Column:
    lead = F.length(F.regexp_extract(m, r"^\+[0-9]{1,3}[ .-]", 0))
    new = permute_digits(_digits(F.substring(m, lead + 1, F.length(m))), key, "phone")
    return F.transform(F.array(new), lambda x: _put_back(m, x, lead))[0]


def _ip(m: Column, key: str) -> Column:
    p = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    number = ((p[0] * 256 + p[1]) * 256 + p[2]) * 256 + p[3]
    new = feistel(number, F.lit(65536), F.lit(65536), key, "ip")
    return F.transform(F.array(new), lambda v: F.concat_ws(".", *(F.shiftright(v, s).bitwiseAND(F.lit(255).cast("long")).cast("string") for s in (24, 16, 8, 0))))[0]


def _day(m: Column) -> Column:
    """The calendar day of a date in one of the three shapes, null if there is none; day before month."""
    iso = F.when(m.like("____-__-__"), m).otherwise(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2)))
    return F.coalesce(iso.try_cast("date"), F.when(m.contains("/"), F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2)).try_cast("date")))


def _in_cycle(day: Column) -> Column:
    n = F.datediff(day, F.lit(CYCLE_START).cast("date"))
    return (n >= 0) & (n < CYCLE[0] * CYCLE[1])


def _date(m: Column, key: str) -> Column:
    """Permuted day in the value's own shape; a month-first value stays month-first."""
    start = F.lit(CYCLE_START).cast("date")
    new = F.date_add(start, feistel(F.datediff(_day(m), start).cast("long"), F.lit(CYCLE[0]), F.lit(CYCLE[1]), key, "date").cast("int"))
    month_first = m.contains("/") & F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2)).try_cast("date").isNull()

    def shaped(v: Column) -> Column:
        y, mo, d = (F.date_format(v, f) for f in ("yyyy", "MM", "dd"))
        sign = F.when(m.contains("/"), "/").otherwise(".")
        return F.when(m.like("____-__-__"), F.concat_ws("-", y, mo, d)).when(month_first, F.concat_ws("/", mo, d, y)).otherwise(F.concat(d, sign, mo, sign, y))

    return F.transform(F.array(new), shaped)[0]


def _ssn_ok(m: Column) -> Column:
    area = F.substring(m, 1, 3)
    return (area > "000") & (area < "900") & (area != "666") & (F.substring(m, 5, 2) != "00") & (F.substring(m, 8, 4) != "0000")


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = F.substring(m, 1, 3).cast("long"), F.substring(m, 5, 2).cast("long"), F.substring(m, 8, 4).cast("long")
    number = (area - F.when(area > 666, 2).otherwise(1)) * SSN[1] + (group - 1) * 9999 + serial - 1
    new = feistel(number, F.lit(SSN[0]), F.lit(SSN[1]), key, "ssn")

    def shaped(v: Column) -> Column:
        low = F.pmod(v, F.lit(SSN[1]))
        a = (v - low) / SSN[1] + 1
        g = F.floor(low / 9999)
        return F.concat_ws("-", F.lpad((a + F.when(a >= 666, 1).otherwise(0)).cast("long").cast("string"), 3, "0"), F.lpad((g + 1).cast("string"), 2, "0"),
                           F.lpad((F.pmod(low, F.lit(9999)) + 1).cast("string"), 4, "0"))

    return F.transform(F.array(new), shaped)[0]


def _mail(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(F.lit("u"), F.rpad(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("mail"), F.lower(m)), 256), F.lit(1), F.greatest(F.length(local) - 1, F.lit(11))), F.greatest(F.length(local) - 1, F.lit(11)), "0"),
                    F.lit("@mail.invalid"))


def _secret(m: Column, key: str) -> Column:
    value = F.regexp_extract(m, "\"([^\"]*)\"", 1)
    return F.concat(F.substring_index(m, "\"", 1), F.lit("\""), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), value), 256), F.lit(1), F.length(value)), F.lit("\""))


def kind_of(m: Column) -> Column:
    """Kind of a match, null if its value fails validation."""
    d = _digits(m)
    return (F.when(m.contains("\""), "secret").when(m.contains("@"), "mail")
            .when(m.rlike(rf"^{IP}$"), F.when(F.forall(F.split(m, r"\."), lambda x: x.cast("int") < 256), "ip"))
            .when(m.rlike(rf"^{DATE}$"), F.when(_in_cycle(_day(m)), "date"))
            .when(m.rlike(rf"^{SSN_SHAPE}$"), F.when(_ssn_ok(m), "ssn"))
            .when(m.rlike(rf"^(?:{PHONE})$"), "phone")
            .when(_digit_sum(d) % 10 == 0, F.when(d.rlike("[1-9]"), "card")))


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    by = {"secret": _secret, "mail": _mail, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}
    out = F.when(kind.isNull(), m)
    for k, f in by.items():
        out = out.when(kind == k, f(m, key))
    return out


def pseudonymised(docs: DataFrame, key: str = KEY) -> DataFrame:
    """(row: the columns of ``docs``, text: with pseudonyms, found: kinds of the replaced values in order)."""
    text = F.col("text")
    suspect = text.rlike("[0-9@\"]")
    cut = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text.cast("string").alias("text"))
    cut = cut.select("row", "text", F.when(suspect, F.regexp_extract_all("text", F.lit(f"({ANY})"), F.lit(1))).otherwise(F.array().cast("array<string>")).alias("hits"))
    told = cut.select("row", "text", F.transform("hits", lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind"))).alias("hits"))
    new = F.transform("hits", lambda h: pseudonym(h["m"], h["kind"], key))
    gaps = F.split("text", ANY, -1)
    whole = F.array_join(F.zip_with(gaps, new, lambda g, n: F.concat(F.coalesce(g, F.lit("")), F.coalesce(n, F.lit("")))), "")
    return told.select("row", F.when(F.size("hits") > 0, whole).otherwise(F.col("text")).alias("text"),
                       F.filter(F.transform("hits", lambda h: h["kind"]), lambda k: k.isNotNull()).alias("found"))


def _number(kind: str) -> Column:
    return F.size(F.filter("found", lambda k: k == kind)).cast("long").alias(f"n_{kind}")


def counted(found: DataFrame) -> DataFrame:
    """doc_id, text, number of replaced values of each kind."""
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), "text", *(_number(k) for k in KINDS))
