"""Pseudonyms for personal data that keep its format, by keyed Feistel permutations; DataFrame functions only.

Numbers and dates that pass their own check are permuted within the valid values of their kind: payment cards (Luhn), IBANs (modulo 97),
North American telephone numbers and other separated ones, social security numbers, IPv4 addresses and calendar dates. The
permutation depends on the key and the kind alone, so equal values get equal pseudonyms in all documents and different values different ones. Dates keep their
28 years (from 1904 to 2099) or their year (elsewhere), a day-first date with slashes stays one that can be read no other way. E-mail addresses, access keys and passwords have no such number; they get keyed digests of the same form. A password or secret is one by its place, whatever its form, and is
replaced as a whole.

Each kind's domain is Z_a x Z_b; a round adds a keyed digest of one half to the other half modulo its size. Null texts stay null,
texts without a match are returned as they are, repeated rows give equal results, and other columns pass through: pseudonymised() puts n_replaced in the place of
a column of that name, with_pseudonyms() has no column of its own.
"""

from __future__ import annotations

import calendar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import documents

#: The demonstration key. A deployment gives its own and keeps it: whoever has it can undo the permutations.
KEY = "demonstration-key"
FEISTEL_ROUNDS = 10

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Kinds in the order in which a match is tried, with their patterns. Quantifiers are bounded or possessive: no text makes them slow.
PATTERNS = {
    "password": r"(?<=password=|passwd=|pwd=)[^\s\"']{4,}+",
    "secret": r"(?<=[=:] \"|[=:]\")[0-9a-fA-F]{32,}+(?=\")",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "access_key": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "iso_date": r"(?<![\d-])(?:1[5-9]|2\d)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\d-])",
    "slash_date": r"(?<![\d/])\d{2}/\d{2}/(?:1[5-9]|2\d)\d\d(?![\d/])",
    "dot_date": r"(?<![\d.])\d{2}\.\d{2}\.(?:1[5-9]|2\d)\d\d(?!\d)",
    "ipv4": rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
}
ANY = "|".join(PATTERNS.values())
#: The kinds that their place shows, and a pattern whose second group is a match of theirs.
HIDDEN = "|".join(PATTERNS[kind] for kind in ("password", "secret"))
ANY_HIDDEN = f"(({HIDDEN})|{'|'.join(p for kind, p in PATTERNS.items() if kind not in ('password', 'secret'))})"


def _digest(key: str, *parts: Column) -> Column:
    """Hexadecimal digits that depend on the key and the parts."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *(x.cast("string") for x in parts)), 256)


def _number(hexadecimal: Column) -> Column:
    """The first 60 bits as a number."""
    return F.conv(F.substring(hexadecimal, 1, 15), 16, 10).cast("long")


def permuted(key: str, kind: str, left: Column, right: Column, a: Column, b: Column) -> Column:
    """struct(l, r): a keyed permutation of Z_a x Z_b."""

    def step(s: Column, i: Column) -> Column:
        l, r = s.getField("l"), s.getField("r")
        even = i % 2 == 0
        add = _number(_digest(key, F.lit(kind), a, b, i, F.when(even, r).otherwise(l)))
        return F.struct(F.when(even, (l + add) % a).otherwise(l).alias("l"), F.when(even, r).otherwise((r + add) % b).alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(FEISTEL_ROUNDS - 1)), start, step)


def _with(value: Column, f) -> Column:
    """f of a value that is computed once: a lambda's parameter stands for it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _power(n: Column) -> Column:
    return F.concat(F.lit("1"), F.repeat(F.lit("0"), n)).cast("long")


def permuted_digits(key: str, kind: str, digits: Column) -> Column:
    """As many digits, permuted; up to 36 of them."""

    def halves(d: Column) -> Column:
        u = F.floor(F.length(d) / 2).cast("int")
        v = F.length(d) - u
        done = permuted(key, kind, F.concat(F.lit("0"), F.substr(d, F.lit(1), u)).cast("long"), F.substr(d, u + 1, v).cast("long"), _power(u), _power(v))
        return _with(done, lambda s: F.concat(F.when(u > 0, F.lpad(s.getField("l").cast("string"), u, F.lit("0"))).otherwise(F.lit("")), F.lpad(s.getField("r").cast("string"), v, F.lit("0"))))

    return _with(digits, halves)


def refilled(form: Column, digits: Column) -> Column:
    """form with its digits replaced, in their order, by those of digits."""
    place = lambda i: F.length(_digits(F.substr(form, F.lit(1), i)))
    put = lambda i: F.when(F.substr(form, i, F.lit(1)).between("0", "9"), F.substr(digits, place(i), F.lit(1))).otherwise(F.substr(form, i, F.lit(1)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), put), "")


def luhn(digits: Column) -> Column:
    """The Luhn sum: 0 modulo 10 for valid numbers."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def mod97(characters: Column) -> Column:
    """The remainder of an IBAN's number, letters counting 10 to 35."""

    def add(total: Column, i: Column) -> Column:
        c = F.substr(characters, i, F.lit(1))
        code = F.ascii(c)
        return F.when(code < 58, (total * 10 + code - 48) % 97).otherwise((total * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(characters)), F.lit(0), add)


def _card(key: str, m: Column) -> Column:
    """The first digit stays; the rest is permuted, and the check digit follows."""

    def of(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 1), permuted_digits(key, "card", F.substr(d, F.lit(2), F.length(d) - 2)))
        whole = _with(body, lambda x: F.concat(x, ((10 - luhn(F.concat(x, F.lit("0"))) % 10) % 10).cast("string")))
        return F.when(luhn(d) % 10 == 0, _with(whole, lambda x: refilled(m, x))).otherwise(m)

    return _with(_digits(m), of)


def _phone(key: str, m: Column) -> Column:
    """The last ten digits are permuted: numbers whose area and exchange begin with 2 to 9 among themselves, all others among themselves."""

    def of(d: Column) -> Column:
        n = F.length(d)
        part = lambda at, size: F.substr(d, n - at, F.lit(size)).cast("long")
        area, exchange, line = part(9, 3), part(6, 3), part(3, 4)
        ten = lambda a, e, x: F.concat(*(F.lpad(v.cast("long").cast("string"), k, "0") for v, k in ((a, 3), (e, 3), (x, 4))))
        whole = lambda s: ten(F.floor(s.getField("l") / 800) + 200, s.getField("l") % 800 + 200, s.getField("r"))
        valid = _with(permuted(key, "phone", (area - 200) * 800 + exchange - 200, line, F.lit(640_000).cast("long"), F.lit(10_000).cast("long")), whole)
        # the others: 200 areas with 1,000 exchanges each, then 800 areas with 200
        low = lambda s: s.getField("l") < 200_000
        rest = F.when(area < 200, area * 1000 + exchange).otherwise(200_000 + (area - 200) * 200 + exchange)
        other = _with(
            permuted(key, "digits", rest, line, F.lit(360_000).cast("long"), F.lit(10_000).cast("long")),
            lambda s: F.when(low(s), ten(F.floor(s.getField("l") / 1000), s.getField("l") % 1000, s.getField("r"))).otherwise(ten(F.floor((s.getField("l") - 200_000) / 200) + 200, (s.getField("l") - 200_000) % 200, s.getField("r"))),
        )
        new = F.when((area >= 200) & (exchange >= 200), valid).otherwise(other)
        return _with(F.concat(F.substr(d, F.lit(1), n - 10), new), lambda x: refilled(m, x))

    return _with(_digits(m), of)


def _ipv4(key: str, m: Column) -> Column:
    def of(p: Column) -> Column:
        octet = lambda i: F.get(p, F.lit(i)).cast("long")
        done = permuted(key, "ipv4", octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), F.lit(65536).cast("long"), F.lit(65536).cast("long"))
        whole = lambda x: x.cast("long").cast("string")
        return _with(done, lambda s: F.concat_ws(".", whole(F.floor(s.getField("l") / 256)), whole(s.getField("l") % 256), whole(F.floor(s.getField("r") / 256)), whole(s.getField("r") % 256)))

    return _with(F.split(m, r"\."), of)


def _ssn(key: str, m: Column) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = F.substring(m, 1, 3).cast("long"), F.substring(m, 5, 2).cast("long"), F.substring(m, 8, 4).cast("long")
    index = area - F.when(area > 666, 2).otherwise(1)
    done = permuted(key, "ssn", index * 99 + group - 1, serial - 1, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"))

    def back(s: Column) -> Column:
        i = F.floor(s.getField("l") / 99)
        pad = lambda x, n: F.lpad(x.cast("long").cast("string"), n, "0")
        return F.concat_ws("-", pad(i + F.when(i > 664, 2).otherwise(1), 3), pad(s.getField("l") % 99 + 1, 2), pad(s.getField("r") + 1, 4))

    return _with(done, back)


def _months(first_day: int) -> list[list[int]]:
    """For 28 years from a leap year on, a leap year, and another year: how many days from first_day of each month on lie before each month."""
    out = []
    for years in (range(1904, 1932), range(1904, 1905), range(1905, 1906)):
        sizes = [calendar.monthrange(y, k)[1] - first_day + 1 for y in years for k in range(1, 13)]
        out.append([sum(sizes[:k]) for k in range(len(sizes) + 1)])
    return out


def _date(key: str, day: Column, form: str, m: Column, first_day: int = 1) -> Column:
    """Days are permuted within 28 years from 1904 to 2099, elsewhere within their year, among those from first_day of each month on.

    The number of days is split into two factors: 10,227 = 21 x 487, 366 = 6 x 61 and 365 = 5 x 73 days, or 6,195 = 105 x 59, 222 = 6 x 37 and 221 = 13 x 17.
    """
    factors = {1: ((21, 487), (6, 61), (5, 73)), 13: ((105, 59), (6, 37), (13, 17))}[first_day]
    before = _months(first_day)

    def of(d: Column) -> Column:
        year = F.year(d)
        near = year.between(1904, 2099)
        start = F.when(near, year - F.pmod(year - 1904, F.lit(28))).otherwise(year)
        leap = F.dayofyear(F.make_date(year, F.lit(12), F.lit(31))) == 366
        pick = lambda xs: F.when(near, xs[0]).when(leap, xs[1]).otherwise(xs[2])
        a, b = (pick([F.lit(f[k]) for f in factors]).cast("long") for k in (0, 1))
        starts = pick([F.lit(x) for x in before])
        at = (F.get(starts, (year - start) * 12 + F.month(d) - 1) + F.dayofmonth(d) - first_day).cast("long")
        done = _with(permuted(key, f"date {first_day}", F.floor(at / b), at % b, a, b), lambda s: s.getField("l") * b + s.getField("r"))

        def back(n: Column) -> Column:
            month = F.size(F.filter(starts, lambda x: x <= n)) - 1
            return _with(month, lambda k: F.date_format(F.make_date(start + F.floor(k / 12).cast("int"), k % 12 + 1, (n - F.get(starts, k)).cast("int") + first_day), form))

        return _with(done, back)

    return F.when(day.isNull(), m).otherwise(_with(day, of))


def _iban(key: str, m: Column) -> Column:
    """The country stays, the account's digits are permuted, and the check digits follow."""

    def of(c: Column) -> Column:
        turned = F.concat(F.substr(c, F.lit(5), F.length(c) - 4), F.substring(c, 1, 2))
        account = F.substr(c, F.lit(5), F.length(c) - 4)
        new = refilled(account, permuted_digits(key, "iban", _digits(account)))
        made = _with(new, lambda x: F.concat(F.substring(c, 1, 2), F.lpad((98 - mod97(F.concat(x, F.substring(c, 1, 2), F.lit("00")))).cast("string"), 2, "0"), x))
        spaced = lambda x: F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: F.when(F.substr(m, i, F.lit(1)) == " ", F.lit(" ")).otherwise(F.substr(x, F.length(F.replace(F.substr(m, F.lit(1), i), F.lit(" "), F.lit(""))), F.lit(1)))), "")
        valid = (mod97(F.concat(turned, F.substring(c, 3, 2))) == 1) & (F.length(_digits(account)) >= 4)
        return F.when(valid, _with(made, spaced)).otherwise(m)

    return _with(F.replace(m, F.lit(" "), F.lit("")), of)


def _secret(key: str, m: Column) -> Column:
    """As many hexadecimal digits of keyed digests as the match has characters."""
    block = lambda d: F.transform(F.sequence(F.lit(0), F.floor((F.length(m) - 1) / 64).cast("int")), lambda k: _digest(key, F.lit("block"), d, k))
    return _with(_digest(key, F.lit("secret"), m), lambda d: F.substr(F.array_join(block(d), ""), F.lit(1), F.length(m)))


def pseudonym(key: str, m: Column, hidden: Column) -> Column:
    """The pseudonym of one match; the match itself where it fails its check. hidden: whether its place shows a password or secret."""
    is_ = lambda kind: m.rlike(rf"\A(?:{PATTERNS[kind]})\z")
    email = F.concat(F.lit("u"), F.substring(_digest(key, F.lit("local"), F.lower(m)), 1, 12), F.lit("@"), F.substring(_digest(key, F.lit("host"), F.lower(F.substring_index(m, "@", -1))), 1, 8), F.lit("."), F.substring_index(m, ".", -1))
    slash = F.coalesce(F.try_to_date(m, "MM/dd/yyyy"), F.try_to_date(m, "dd/MM/yyyy"))
    american = F.try_to_date(m, "MM/dd/yyyy").isNotNull()
    return (
        F.when(hidden, _secret(key, m))
        .when(F.contains(m, F.lit("@")) & is_("email"), email)
        .when(is_("access_key"), F.concat(F.lit("AKIA"), F.upper(F.substring(_digest(key, F.lit("access"), m), 1, 16))))
        .when(is_("iso_date"), _date(key, F.try_to_date(m, "yyyy-MM-dd"), "yyyy-MM-dd", m))
        .when(is_("slash_date"), F.when(american, _date(key, slash, "MM/dd/yyyy", m)).otherwise(_date(key, slash, "dd/MM/yyyy", m, 13)))  # a day above 12 shows which comes first
        .when(is_("dot_date"), _date(key, F.try_to_date(m, "dd.MM.yyyy"), "dd.MM.yyyy", m))
        .when(is_("ipv4"), _ipv4(key, m))
        .when(is_("ssn"), _ssn(key, m))
        .when(is_("phone"), _phone(key, m))
        .when(is_("card"), _card(key, m))
        .when(is_("iban"), _iban(key, m))
        .otherwise(_secret(key, m))
    )


def pseudonymised(docs: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """docs with personal data in the text replaced, and n_replaced."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "n_replaced")]
    value = F.col(f"`{text}`")
    found = F.when(value.rlike("[0-9@=]"), F.regexp_extract_all(value, F.lit(f"({ANY})"), 1)).otherwise(F.array().cast("array<string>"))
    step = docs.select(F.struct(*others).alias("_row"), value.alias("_t"), found.alias("_m"))
    hidden = F.when((F.size("_m") > 0) & F.col("_t").rlike(HIDDEN), F.regexp_extract_all("_t", F.lit(ANY_HIDDEN), 2)).otherwise(F.array().cast("array<string>"))
    # zipped: an expression inside a lambda that looks at the text again would be computed once for each match
    of = lambda m, h: pseudonym(key, m, F.coalesce(h != "", F.lit(False)))
    step = step.select("_row", "_t", "_m", F.when(F.size("_m") > 0, F.zip_with("_m", hidden, of)).alias("_p"))
    pieces = F.zip_with(F.split("_t", ANY), F.array_append("_p", F.lit("")), lambda a, b: F.concat(a, b))
    changed = F.aggregate(F.arrays_zip("_m", "_p"), F.lit(0), lambda n, x: n + F.when(x.getField("_m") == x.getField("_p"), 0).otherwise(1))
    out = step.select("_row", F.when(F.size("_m") > 0, F.array_join(pieces, "")).otherwise(F.col("_t")).alias("_t"), F.when(F.size("_m") > 0, changed).otherwise(F.lit(0)).cast("long").alias("n_replaced"))
    return out.select(*(F.col("_t").alias(text) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns if c != "n_replaced"), "n_replaced")


def with_pseudonyms(docs: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """docs with personal data in the text replaced; every other column as it came, whatever its name."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.col(f"`{text}`").alias("text"))
    return pseudonymised(rows, key).select(*(F.col("text").alias(c) if c == text else F.col("_doc").getField(c).alias(c) for c in docs.columns))


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with pseudonyms, and how many."""
    return pseudonymised(documents(spark, sf_dir, "doc_id", "text"))
