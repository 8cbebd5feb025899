"""Format-preserving pseudonyms for personal data, in SQL functions alone.

Every finding is checked (cards by Luhn, IBANs by mod 97, addresses by their octets, dates by the calendar, social
security and North American telephone numbers by the ranges that are given out) and then permuted by a keyed Feistel
network inside its own format: a digit stays a digit, a letter a letter, a card keeps a right check digit, a date
stays a date, a number stays in its ranges.  The permutation depends on the key and the kind alone, so equal values
get equal pseudonyms in all documents and different values different ones.
"""

from __future__ import annotations

import os
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, let

ROUNDS = 8
#: Where the key comes from: this setting of the session, or this variable of the driver's environment.
KEY_SETTING, KEY_VARIABLE = "spark.drawspark.pseudonym.key", "DRAWSPARK_PSEUDONYM_KEY"


def key_of(spark: SparkSession) -> str:
    """The configured key.  Where none is configured, a random one is made and kept in the session's settings, so
    pseudonyms agree within the session and nobody can undo them."""
    key = spark.conf.get(KEY_SETTING, None) or os.environ.get(KEY_VARIABLE)
    if not key:
        key = secrets.token_hex(16)
        spark.conf.set(KEY_SETTING, key)
    return key


PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "secret": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}[A-Za-z0-9]{11,30}(?![A-Za-z0-9])",
    "iban_groups": r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}(?: [A-Za-z0-9]{4}){2,7}(?: [A-Za-z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "day": "(?<![0-9./-])(?:" + "|".join(f"[0-9]{{4}}{s}[0-9]{{1,2}}{s}[0-9]{{1,2}}|[0-9]{{1,2}}{s}[0-9]{{1,2}}{s}[0-9]{{4}}" for s in ("-", "/", r"\.")) + ")(?![0-9]|[./-][0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    # a whole run of groups; one that starts an address, a dotted or slashed number or an email stays out
    "card": r"(?<![0-9-])(?=[0-9](?:[ -]?[0-9]){12})[0-9]++(?:[ -](?![0-9]{1,3}\.[0-9]{1,3}\.[0-9]|[0-9]{1,2}/[0-9]|[0-9]{4}/[0-9]{1,2}/[0-9]|[A-Za-z0-9._%+-]++@)[0-9]++)*+",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}(?:-(?!00)[0-9]{2}-| (?!00)[0-9]{2} )(?!0000)[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-]?[0-9]{4}(?![0-9])",
    "abroad": r"(?<![0-9A-Za-z+])\+[2-9][0-9](?:[ .()-]{0,2}[0-9]){6,13}(?![0-9])",
}
ANY = "|".join(PATTERNS.values())
#: What may stand beside a card in a run of digits, or behind an IBAN in groups.
BESIDE = "|".join(PATTERNS[k] for k in ("date", "day", "ssn", "phone", "abroad"))
#: Sizes of the groups that cards are printed in.
GROUPINGS = ["4,4,4,4", "4,6,5", "4,6,4", "4,4,4,4,3", "4,4,5", "4,4,4,1"]


TOKEN = "struct<t:string,k:string>"


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _digest(key: str, kind: Column, turn: Column, of: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(key), kind, turn.cast("string"), of), 256)


def _shift(text: Column, digest: Column) -> Column:
    """Each ASCII letter and digit moved within its own class by a figure of the digest, by position."""

    def one(c: Column, i: Column, d: Column) -> Column:
        code = F.ascii(c)
        by = F.conv(F.substring(d, (i * 3) % 60 + 1, F.lit(3)), 16, 10).cast("int") + i
        first = F.when(code.between(48, 57), 48).when(code.between(97, 122), 97).when(code.between(65, 90), 65)
        size = F.when(first == 48, 10).otherwise(26)
        return F.coalesce(F.char((code - first + by) % size + first), c)

    return let(digest, lambda d: F.array_join(F.transform(_chars(text), lambda c, i: one(c, i, d)), ""))


def permute_text(text: Column, key: str, kind: Column) -> Column:
    """Feistel network over the two halves of a string; the class of every character stays."""

    def run(s: Column) -> Column:
        half = F.floor(F.length(s) / 2).cast("int")
        start = F.struct(F.substring(s, F.lit(1), half).alias("l"), F.substring(s, half + 1, F.length(s)).alias("r"))
        turn = lambda a, k: F.struct(a["r"].alias("l"), _shift(a["l"], _digest(key, kind, k, a["r"])).alias("r"))
        return F.aggregate(F.array(*[F.lit(k) for k in range(ROUNDS)]), start, turn, lambda a: F.concat(a["l"], a["r"]))

    return let(text, run)


def permute_number(value: Column, left: Column, right: Column, key: str, kind: Column) -> Column:
    """Feistel network over 0 .. left * right - 1, as the pair (value div right, value mod right)."""

    def turn(a: Column, k: Column) -> Column:
        # the half that stays gives the digest, the other moves within its own size
        moves, stays = F.when(k % 2 == 1, a["r"]).otherwise(a["l"]), F.when(k % 2 == 1, a["l"]).otherwise(a["r"])
        size = F.when(k % 2 == 1, right).otherwise(left)
        by = F.conv(F.substring(_digest(key, kind, k, stays.cast("string")), 1, 12), 16, 10).cast("long")
        return let((moves + by) % size, lambda x: F.when(k % 2 == 1, F.struct(a["l"].alias("l"), x.alias("r"))).otherwise(F.struct(x.alias("l"), a["r"].alias("r"))))

    start = F.struct(F.floor(value / right).cast("long").alias("l"), (value % right).cast("long").alias("r"))
    return F.aggregate(F.array(*[F.lit(k) for k in range(ROUNDS)]), start, turn, lambda a: a["l"] * right + a["r"])


def _luhn(digits: Column, first_doubled: int) -> Column:
    """The Luhn sum; every second digit from the right is doubled, from the last if first_doubled."""

    def worth(c: Column, i: Column) -> Column:
        return F.when((i + first_doubled) % 2 == 1, F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int"))).otherwise(c.cast("int"))

    return F.aggregate(F.transform(_chars(F.reverse(digits)), worth), F.lit(0), lambda acc, d: acc + d)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _mod97(text: Column) -> Column:
    """Of the number that a string of digits and letters (A is 10, in any case) stands for."""

    def add(acc: Column, c: Column) -> Column:
        code = F.ascii(F.upper(c))
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(_chars(text), F.lit(0), add)


def _refill(shape: Column, symbols: Column) -> Column:
    """``shape`` with its letters and digits replaced, in order, by those of ``symbols``."""

    def put(acc: Column, c: Column) -> Column:
        own = c.rlike("^[0-9A-Za-z]$")
        return F.struct(F.concat(acc["out"], F.when(own, F.substring(symbols, acc["at"], F.lit(1))).otherwise(c)).alias("out"), (acc["at"] + own.cast("int")).alias("at"))

    return F.aggregate(_chars(shape), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), put, lambda a: a["out"])


def _token(t: Column, kind) -> Column:
    return F.struct(t.alias("t"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("k"))


def _tokens(text: Column, pattern: str) -> Column:
    """The text in pieces, as an array of (t, k): k is the kind of a finding, empty for what lies between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.flatten(F.zip_with(F.split(text, pattern, -1), found, lambda part, m: F.array(_token(part, ""), _token(F.coalesce(m, F.lit("")), F.coalesce(_kind(m), F.lit(""))))))


def _kind(m: Column) -> Column:
    """Which pattern a finding comes from; the ones a shorter one could also match come first."""
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike("^AKIA[A-Z0-9]{16}$"), "secret")
        .when(m.rlike("^[A-Za-z]"), "iban")
        .when(m.rlike(r"^\+[2-9]"), "abroad")
        .when(m.rlike("^(?:[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4})$"), "date")
        .when(m.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"), "ip")
        .when(m.rlike("^[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}$"), "ssn")
        .when(m.rlike("^(?:[^0-9]*[0-9]){13}"), "card")
        .when(m.isNotNull(), "phone")
    )


def _cards(m: Column) -> Column:
    """A run of digit groups as tokens: its cards, and what stands beside them.

    Candidates are stretches of whole groups with 13 to 19 digits and a right Luhn sum; a group of 13 or more digits
    stands alone.  Printed groupings go first, then the leftmost; those that overlap a chosen one are left.
    """

    def candidates(groups: Column) -> Column:
        def ends(i: Column) -> Column:
            def made(j: Column) -> Column:
                part = F.slice(groups, i + 1, j - i + 1)
                sizes = F.array_join(F.transform(part, lambda g: F.length(g).cast("string")), ",")
                usual = (i == j) | sizes.isin(GROUPINGS)
                alone = (i == j) | F.forall(part, lambda g: F.length(g) < 13)
                return F.struct((~usual).cast("int").alias("rank"), i.alias("i"), j.alias("j"), F.array_join(part, "").alias("d"), alone.alias("alone"))

            return F.transform(F.sequence(i, F.least(i + 18, F.size(groups) - 1)), made)

        every = F.flatten(F.transform(F.sequence(F.lit(0), F.size(groups) - 1), ends))
        fit = F.filter(every, lambda c: c["alone"] & F.length(c["d"]).between(13, 19))
        return F.sort_array(F.filter(fit, lambda c: _luhn(c["d"], 0) % 10 == 0))

    def chosen(cands: Column) -> Column:
        none = F.filter(cands, lambda c: F.lit(False))
        return F.aggregate(cands, none, lambda acc, c: F.when(F.exists(acc, lambda o: (o["i"] <= c["j"]) & (c["i"] <= o["j"])), acc).otherwise(F.concat(acc, F.array(c))))

    def split(groups: Column) -> Column:
        def at(k: Column) -> Column:  # separators are single characters
            return F.aggregate(F.slice(groups, F.lit(1), k), F.lit(1), lambda a, g: a + F.length(g) + 1)

        def put(acc: Column, c: Column) -> Column:
            start, end = at(c["i"]), at(c["j"] + 1) - 1
            both = F.array(_token(F.substring(m, acc["at"], start - acc["at"]), "beside"), _token(F.substring(m, start, end - start), "card"))
            return F.struct(F.concat(acc["out"], both).alias("out"), end.alias("at"))

        cards = F.sort_array(F.transform(chosen(candidates(groups)), lambda c: F.struct(c["i"].alias("i"), c["j"].alias("j"))))
        begin = F.struct(F.array().cast(f"array<{TOKEN}>").alias("out"), F.lit(1).alias("at"))
        return F.aggregate(cards, begin, put, lambda a: F.concat(a["out"], F.array(_token(F.substring(m, a["at"], F.length(m)), "beside"))))

    return let(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)), split)


def _ibans(m: Column) -> Column:
    """An IBAN in one piece or in groups of four as tokens; of groups the longest valid stretch from the first one on counts."""

    def valid(x: Column) -> Column:
        return F.length(x).between(15, 34) & (_mod97(F.concat(F.substring(x, F.lit(5), F.lit(30)), F.substring(x, 1, 4))) == 1)

    def split(groups: Column) -> Column:
        ok = F.filter(F.sequence(F.size(groups), F.lit(1)), lambda k: valid(F.array_join(F.slice(groups, F.lit(1), k), "")))
        size = lambda k: F.length(F.array_join(F.slice(groups, F.lit(1), k), " "))
        parts = lambda n: F.array(_token(F.substring(m, F.lit(1), n), "iban"), _token(F.substring(m, n + 1, F.length(m)), "beside"))
        return let(F.get(ok, F.lit(0)), lambda k: F.when(k.isNull(), F.array(_token(m, ""))).otherwise(let(size(k), parts)))

    return let(F.split(m, " "), split)


def _emails(m: Column) -> Column:
    """Name and host apart, the top-level domain as it is."""
    at = F.instr(m, "@")
    last = F.length(m) - F.instr(F.reverse(m), ".") + 1
    return F.array(_token(F.substring(m, F.lit(1), at - 1), "name"), _token(F.lit("@"), ""), _token(F.substring(m, at + 1, last - at - 1), "host"), _token(F.substring(m, last, F.length(m)), ""))


def _finer(tokens: Column) -> Column:
    """Findings of several values taken apart."""

    def parts(x: Column) -> Column:
        t, k = x["t"], x["k"]
        secret = F.array(_token(F.lit("AKIA"), ""), _token(F.substring(t, F.lit(5), F.length(t)), "secret"))
        return F.when(k == "card", _cards(t)).when(k == "iban", _ibans(t)).when(k == "email", _emails(t)).when(k == "secret", secret).otherwise(F.array(x))

    apart = F.flatten(F.transform(tokens, parts))
    return F.flatten(F.transform(apart, lambda x: F.when(x["k"] == "beside", _tokens(x["t"], BESIDE)).otherwise(F.array(x))))


def _read_date(t: Column) -> Column:
    """(day, order): days since 0001-01-01 of the first reading that is a date, and how it is written."""
    two = lambda x: F.lpad(x, 2, "0")
    read = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, two(m), two(d)), "yyyy-MM-dd")

    def readings(p: Column) -> Column:
        first = F.length(p[0]) == 4
        days = F.array(F.when(first, read(p[0], p[1], p[2])), F.when(~first, read(p[2], p[1], p[0])), F.when(~first, read(p[2], p[0], p[1])))
        orders = F.array(F.lit("yyyy-MM-dd"), F.lit("dd-MM-yyyy"), F.lit("MM-dd-yyyy"))
        made = F.zip_with(days, orders, lambda d, o: F.struct(F.datediff(d, F.lit("0001-01-01").cast("date")).cast("long").alias("day"), o.alias("order")))
        return F.get(F.filter(made, lambda x: x["day"] >= 0), F.lit(0))

    return let(F.split(t, "[-/.]"), readings)


#: Kinds whose values are permuted as numbers; the others as strings.
NUMBERS = ("date", "ssn", "phone", "ip")


def _number_of(t: Column, k: Column) -> Column:
    """(value, left, right, base, order) of a finding that is a number below left * right; null where it is not valid."""
    d = F.right(_digits(t), F.lit(10))
    part = lambda at, n: F.substring(d, at, n).cast("long")
    made = lambda value, left, right, base=F.lit(0), order=F.lit(""): F.struct(
        value.cast("long").alias("value"), F.lit(left).cast("long").alias("left"), F.lit(right).cast("long").alias("right"), base.cast("long").alias("base"), order.alias("order")
    )
    # areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999
    ssn = ((part(1, 3) - F.when(part(1, 3) > 666, 2).otherwise(1)) * 99 + part(4, 2) - 1) * 9999 + part(6, 4) - 1
    # area and office from 200 to 999
    phone = ((part(1, 3) - 200) * 800 + part(4, 3) - 200) * 10000 + part(7, 4)
    octets = F.transform(F.split(t, r"\."), lambda x: x.cast("long"))
    ip = F.aggregate(octets, F.lit(0).cast("long"), lambda a, o: a * 256 + o)

    def date(x: Column) -> Column:
        # cycles of 400 years from the year 1 on, 146,097 = 189 * 773 days; the last, from 9601, has 145,731 = 93 * 1567
        cycle = F.floor(x["day"] / 146097)
        return F.when(cycle < 24, made(x["day"] % 146097, 189, 773, cycle * 146097, x["order"])).when(cycle == 24, made(x["day"] % 146097, 93, 1567, cycle * 146097, x["order"]))

    return (
        F.when(k == "date", let(_read_date(t), date)).when(k == "ssn", made(ssn, 898 * 99, 9999)).when(k == "phone", made(phone, 640000, 10000))
        .when((k == "ip") & F.forall(octets, lambda o: o < 256), made(ip, 65536, 65536))
    )


def _written(t: Column, k: Column, v: Column, x: Column) -> Column:
    """The number ``v`` in the form of the finding ``t``."""
    pad = lambda c, n: F.lpad(c.cast("long").cast("string"), n, "0")
    area = F.floor(v / (9999 * 99))
    ssn = F.concat(pad(area + F.when(area >= 665, 2).otherwise(1), 3), pad(F.floor(v / 9999) % 99 + 1, 2), pad(v % 9999 + 1, 4))
    phone = F.concat(F.when(F.length(_digits(t)) == 11, "1").otherwise(""), pad(F.floor(v / 8000000) + 200, 3), pad(F.floor(v / 10000) % 800 + 200, 3), pad(v % 10000, 4))
    ip = F.concat_ws(".", *[(F.shiftright(v, s) % 256).cast("string") for s in (24, 16, 8, 0)])
    day = F.date_add(F.lit("0001-01-01").cast("date"), (x["base"] + v).cast("int"))
    date = F.replace(F.call_function("date_format", day, x["order"]), F.lit("-"), F.regexp_extract(t, "[-/.]", 0))
    return F.when(k == "date", date).when(k == "ip", ip).otherwise(_refill(t, F.when(k == "ssn", ssn).otherwise(phone)))


def _new_text(t: Column, k: Column, key: str) -> Column:
    """Strings: names, hosts and secrets whole, cards but for the check digit, IBANs but for country and check digits,
    numbers abroad but for the first two digits; check digits are worked out anew."""
    plain = F.regexp_replace(t, "[^0-9A-Za-z]", "")

    def made(x: Column) -> Column:
        body = F.when(k == "card", F.substring(x, F.lit(1), F.length(x) - 1)).when(k == "iban", F.substring(x, F.lit(5), F.length(x))).when(k == "abroad", F.substring(x, F.lit(3), F.length(x))).otherwise(t)

        def written(b: Column) -> Column:
            country = F.substring(x, 1, 2)
            card = F.concat(b, ((10 - _luhn(b, 1) % 10) % 10).cast("string"))
            iban = F.concat(country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b)
            return F.when(k.isin("name", "host", "secret"), b).otherwise(_refill(t, F.when(k == "card", card).when(k == "iban", iban).otherwise(F.concat(country, b))))

        return let(permute_text(body, key, k), written)

    return let(plain, made)


def pseudonym(t: Column, k: Column, key: str) -> Column:
    number = let(_number_of(t, k), lambda x: F.when(x.isNull(), t).otherwise(let(permute_number(x["value"], x["left"], x["right"], key, k), lambda v: _written(t, k, v, x))))
    return F.when(k == "", t).when(k.isin(*NUMBERS), number).otherwise(_new_text(t, k, key))


def pseudonymise(documents: DataFrame, text_col: str = "text", key: str | None = None, found_col: str | None = "n_pseudonyms") -> DataFrame:
    """Every column as before, the text with its personal data replaced.

    ``key``: ``key_of`` the session if not given.  ``found_col`` (renamed by underscores if the table has such a column; None: left out) counts the values
    that changed.  Values that fail their check stay.  Null texts stay null, empty ones empty, with no
    findings; the length of a text never changes but for an IPv4 address, whose octets may gain or lose
    digits, and a date with a day or month of one digit, which gets two.  Day-first and month-first dates share
    the permutation of days, so two texts of different order may meet.  Dates with month names are not found.  Texts of
    any length are searched whole.  Rows are taken alone: repeated rows and an empty table need no rule of their own.
    """
    key = key or key_of(documents.sparkSession)
    text = F.col(f"`{text_col}`")
    names = documents.columns
    both, found = free_name(documents, "found_pair"), found_col and free_name(documents, found_col)

    def swapped(tokens: Column) -> Column:
        new = F.transform(tokens, lambda x: let(pseudonym(x["t"], x["k"], key), lambda p: F.struct(p.alias("p"), ((p != x["t"]) & (x["k"] != "host")).cast("int").alias("n"))))
        return let(new, lambda s: F.struct(F.array_join(F.transform(s, lambda x: x["p"]), "").alias("t"), F.aggregate(s, F.lit(0), lambda acc, x: acc + x["n"]).alias("n")))

    plain = F.struct(text.alias("t"), F.lit(0).alias("n"))
    may = text.rlike(r"@|[0-9]{3}|[0-9]\.[0-9]|AKIA|[A-Za-z]{2}[0-9]{2}|[0-9]/[0-9]")
    made = F.when(may, let(_tokens(text, ANY), lambda found: F.when(F.size(found) > 2, let(_finer(found), swapped)).otherwise(plain))).otherwise(plain)
    out = documents.select("*", F.array(made).alias(both)).select(*[F.col(f"`{c}`") for c in names], F.explode(both).alias(both))
    kept = [F.col(both)["t"].alias(c) if c == text_col else F.col(f"`{c}`") for c in names]
    return out.select(*kept, *([F.col(both)["n"].alias(found)] if found else []))
