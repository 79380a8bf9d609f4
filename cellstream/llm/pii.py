"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Card numbers (Luhn), phone numbers, IPv4 addresses, social security numbers and dates are validated, then permuted within
their own format by a keyed Feistel network: same digits count, same separators, still valid. Equal values get equal
pseudonyms everywhere, so documents stay linked. The local part of an e-mail address is permuted letter by letter class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# What is looked for, tried in this order at each place of a text.
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,6}[A-Za-z]{2,24}"
DATE = r"(?<![0-9])(?:19|20)[0-9]{2}([-/.])(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])(?![0-9])"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
# What begins after a separator inside a run of digits but goes on beyond it.
BEYOND = "|".join(
    (
        EMAIL,
        IPV4,
        r"(?:19|20)[0-9]{2}[/.](?:0[1-9]|1[0-2])[/.](?:0[1-9]|[12][0-9]|3[01])(?![0-9])",
        r"[0-9]{3}(?:\.[0-9]{3}[ .-]|[ -][0-9]{3}\.)[0-9]{4}(?![0-9])",
    )
)
# Digits over blanks and hyphens, at least as many as a card has; `_marked` tells the values in it apart.
RUN = rf"(?<![0-9])(?=[0-9](?:[ -]?[0-9]){{12}})[0-9](?:[0-9]|[ -](?!{BEYOND})[0-9])*+"
ANY = "|".join((EMAIL, DATE, IPV4, SSN, PHONE, RUN))
# The groupings of cards, tried in this order at each group of a run.
LAYOUTS = (
    r"^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}\1[0-9]{3}(?![0-9])",
    r"^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    r"^[0-9]{8}[ -][0-9]{8}(?![0-9])",
    r"^[0-9]{4}([ -])[0-9]{6}\1[0-9]{4,5}(?![0-9])",
    r"^[0-9]{4}([ -])[0-9]{3}\1[0-9]{3}\1[0-9]{3}(?![0-9])",
    r"^[0-9]{13,19}(?![0-9])",
)
MARKED = f"<[^>]*>|{CARD}"


def _round(key: str, tweak: str | Column, i: Column, other: Column) -> Column:
    """Round function: the first 60 bits of a keyed SHA-256."""
    told = F.concat_ws(":", F.lit(key), F.lit(tweak), i.cast("string"), other.cast("string"))
    return F.conv(F.substring(F.sha2(told, 256), 1, 15), 16, 10).cast("bigint")


def feistel(key: str, tweak: str | Column, a: Column, b: Column, of_a: Column, of_b: Column) -> Column:
    """A keyed permutation of pairs (a, b) with a < of_a and b < of_b, by alternating additions: struct(a, b)."""

    def turn(s: Column, i: Column) -> Column:
        return F.struct(
            F.when(i % 2 == 0, F.pmod(s["a"] + F.pmod(_round(key, tweak, i, s["b"]), of_a), of_a)).otherwise(s["a"]).alias("a"),
            F.when(i % 2 == 1, F.pmod(s["b"] + F.pmod(_round(key, tweak, i, s["a"]), of_b), of_b)).otherwise(s["b"]).alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")), turn)


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("bigint")


def _with(value: Column, function) -> Column:
    """`function` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), function), 1)


def permuted_digits(key: str, tweak: str, digits: Column) -> Column:
    """A keyed permutation of the strings of as many digits (2 to 36)."""

    def of(d: Column) -> Column:
        left = F.floor(F.length(d) / 2).cast("int")
        right = F.length(d) - left
        pair = feistel(key, tweak, F.substr(d, F.lit(1), left).cast("bigint"), F.substr(d, left + 1, right).cast("bigint"), _power(left), _power(right))
        return _with(pair, lambda p: F.concat(F.lpad(p["a"].cast("string"), left, "0"), F.lpad(p["b"].cast("string"), right, "0")))

    return _with(digits, of)


def luhn_sum(digits: Column) -> Column:
    """Sum of Luhn's rule over a string of digits, the last one not doubled."""

    def value(c: Column, k: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(k % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def _refill(shape: Column, digits: Column) -> Column:
    """`shape` with its digits replaced by `digits` in turn."""
    return F.aggregate(
        F.split(shape, ""),
        F.struct(F.lit("").alias("out"), digits.alias("left")),
        lambda s, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.substring(s["left"], 1, 1)).alias("out"), F.substr(s["left"], F.lit(2)).alias("left"))).otherwise(
            F.struct(F.concat(s["out"], c).alias("out"), s["left"].alias("left"))
        ),
        lambda s: s["out"],
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _card(key: str, value: Column) -> Column:
    def made(d: Column) -> Column:
        body = permuted_digits(key, "card", F.substr(d, F.lit(1), F.length(d) - 1))
        return _with(body, lambda b: F.concat(b, F.pmod(-luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))

    return F.when(luhn_sum(_digits(value)) % 10 == 0, _refill(value, _with(_digits(value), made)))


def _phone(key: str, value: Column) -> Column:
    """Area and exchange that begin with 2 to 9, or with 0 or 1, do so before and after: four domains; a country code stays."""

    def made(d: Column) -> Column:
        n = F.substring(d, -10, 10)
        area, exchange = F.substring(n, 1, 3).cast("bigint"), F.substring(n, 4, 3).cast("bigint")
        low, low_exchange = (F.when(code < 200, 0).otherwise(200) for code in (area, exchange))
        tweak = F.when((low == 200) & (low_exchange == 200), "phone").otherwise(F.concat_ws("-", F.lit("phone"), low, low_exchange))
        of_area, of_exchange = (F.when(least == 0, 200).otherwise(800) for least in (low, low_exchange))
        pair = feistel(key, tweak, area - low, (exchange - low_exchange) * 10000 + F.substring(n, 7, 4).cast("bigint"), of_area, of_exchange * 10000)
        return _with(
            pair,
            lambda p: F.concat(
                F.substr(d, F.lit(1), F.length(d) - 10),
                F.lpad((p["a"] + low).cast("string"), 3, "0"),
                F.lpad((F.floor(p["b"] / 10000) + low_exchange).cast("string"), 3, "0"),
                F.lpad((p["b"] % 10000).cast("string"), 4, "0"),
            ),
        )

    return _refill(value, _with(_digits(value), made))


def _ipv4(key: str, value: Column) -> Column:
    def made(o: Column) -> Column:
        pair = feistel(key, "ipv4", o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536))
        return F.when(
            F.forall(o, lambda x: x < 256),
            _with(pair, lambda p: F.concat_ws(".", F.floor(p["a"] / 256).cast("string"), (p["a"] % 256).cast("string"), F.floor(p["b"] / 256).cast("string"), (p["b"] % 256).cast("string"))),
        )

    return _with(F.transform(F.split(value, r"\."), lambda x: x.cast("bigint")), made)


def _ssn(key: str, value: Column) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""

    def made(d: Column) -> Column:
        area, group, serial = (F.substring(d, at, n).cast("bigint") for at, n in ((1, 3), (4, 2), (6, 4)))
        pair = feistel(key, "ssn", area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999))
        out = _with(
            pair,
            lambda p: F.concat_ws(
                "-",
                F.lpad((p["a"] + F.when(p["a"] >= 665, 2).otherwise(1)).cast("string"), 3, "0"),
                F.lpad((F.floor(p["b"] / 9999) + 1).cast("string"), 2, "0"),
                F.lpad((p["b"] % 9999 + 1).cast("string"), 4, "0"),
            ),
        )
        return F.when((area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0), out)

    return _with(_digits(value), made)


def _date(key: str, value: Column) -> Column:
    """Days from 1900-01-01 to 2099-12-31: 73049 of them, which is 229 times 319."""
    mark = F.substring(value, 5, 1)
    day = F.try_to_timestamp(F.concat_ws("-", F.substring(value, 1, 4), F.substring(value, 6, 2), F.substring(value, 9, 2)), F.lit("yyyy-MM-dd")).cast("date")

    def made(n: Column) -> Column:
        pair = feistel(key, "date", F.floor(n / 319), n % 319, F.lit(229), F.lit(319))
        return _with(pair, lambda p: F.date_add(F.lit("1900-01-01").cast("date"), (p["a"] * 319 + p["b"]).cast("int")))

    moved = _with(F.datediff(day, F.lit("1900-01-01").cast("date")), made)
    return F.when(day.isNotNull(), F.regexp_replace(moved.cast("string"), "-", mark))


def _email(key: str, value: Column) -> Column:
    """Both halves of the local part in turn shifted, character by character within its class, by the other half."""
    classes = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")

    def shifted(part: Column, other: Column, i: Column) -> Column:
        stream = F.sha2(F.concat_ws(":", F.lit(key), F.lit("email"), i.cast("string"), other), 256)

        def char(c: Column, k: Column) -> Column:
            by = F.conv(F.substr(stream, F.pmod(k * 2, F.lit(64)) + 1, F.lit(2)), 16, 10).cast("int")
            out = c
            for letters in classes:
                at = F.instr(F.lit(letters), c)
                out = F.when((F.length(c) == 1) & (at > 0), F.substr(F.lit(letters), F.pmod(at - 1 + by, F.lit(len(letters))) + 1, F.lit(1))).otherwise(out)
            return out

        return F.array_join(F.transform(F.split(part, ""), char), "")

    def turn(s: Column, i: Column) -> Column:
        return F.struct(
            F.when(i % 2 == 0, shifted(s["a"], s["b"], i)).otherwise(s["a"]).alias("a"),
            F.when(i % 2 == 1, shifted(s["b"], s["a"], i)).otherwise(s["b"]).alias("b"),
        )

    local = F.substring_index(value, "@", 1)
    half = F.floor(F.length(local) / 2).cast("int")
    start = F.struct(F.substr(local, F.lit(1), half).alias("a"), F.substr(local, half + 1).alias("b"))
    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["a"], s["b"]))
    return F.concat(done, F.lit("@"), F.substring_index(value, "@", -1))


def _cards_marked(run: Column) -> Column:
    """`run` with its Luhn-valid numbers of a card's grouping in angle brackets, from left to right."""

    def window(r: Column, k: Column) -> Column:
        ahead = F.concat(*(F.coalesce(F.get(r[name], k + i), F.lit("")) for i in range(5) for name in ("groups", "marks")))
        valid = _with(ahead, lambda a: F.filter(F.array(*(F.regexp_extract(a, p, 0) for p in LAYOUTS)), lambda c: (c != "") & (luhn_sum(_digits(c)) % 10 == 0)))
        return F.coalesce(F.get(valid, F.lit(0)), F.lit(""))

    def turn(r: Column, found: Column):
        def of(s: Column, k: Column) -> Column:
            here, taken = F.get(found, k), F.get(found, k) != ""
            wide = F.size(F.split(here, "[ -]"))
            return (
                F.when(s["inside"] > 0, F.struct(s["out"].alias("out"), (s["inside"] - 1).alias("inside")))
                .when(taken, F.struct(F.concat(s["out"], F.lit("<"), here, F.lit(">"), F.coalesce(F.get(r["marks"], k + wide - 1), F.lit(""))).alias("out"), (wide - 1).alias("inside")))
                .otherwise(F.struct(F.concat(s["out"], F.get(r["groups"], k), F.coalesce(F.get(r["marks"], k), F.lit(""))).alias("out"), s["inside"].alias("inside")))
            )

        return of

    def of_run(r: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(r["groups"]) - 1)
        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("inside"))
        rebuilt = _with(
            F.transform(places, lambda k: window(r, k)), lambda found: F.when(F.exists(found, lambda w: w != ""), F.aggregate(places, start, turn(r, found), lambda s: s["out"]))
        )
        return F.coalesce(rebuilt, run)

    return _with(F.struct(F.split(run, "[ -]").alias("groups"), F.regexp_extract_all(run, F.lit("[ -]"), F.lit(0)).alias("marks")), of_run)


def _marked(found: Column) -> Column:
    """A match with its values in angle brackets, which no match holds.

    In a run of digits cards of a usual grouping go first, then dates, social security numbers and phones; what else CARD
    takes of the rest is left to be tried as it is.
    """
    others = F.regexp_replace(_cards_marked(found), "|".join((DATE, SSN, PHONE)), "<$0>")
    return F.when(found.rlike("^[0-9][0-9 -]*$"), others).otherwise(F.concat(F.lit("<"), found, F.lit(">")))


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one match; the match itself if it isn't valid."""
    made = F.when(value.contains("@"), _email(key, value))
    for pattern, function in ((DATE, _date), (IPV4, _ipv4), (SSN, _ssn), (PHONE, _phone)):
        made = made.when(value.rlike(f"^(?:{pattern})$"), function(key, value))
    return F.coalesce(made.otherwise(_card(key, value)), value)


def pseudonymise(docs: DataFrame, key: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, `text` with its personal data replaced, and n_replaced (long).

    A null text stays null with 0; an empty one stays empty. What looks like personal data but isn't valid (a number that
    fails Luhn's rule, an address with an octet above 255, a day that no month has) is left as it is. Null keys and
    repeated rows give a row each, an empty table none; very long texts are searched whole. `keep` must not hold a column named like the text or n_replaced.
    """
    value = F.col(text)
    found = F.regexp_extract_all(value, F.lit(ANY), F.lit(0))
    around = F.split(value, ANY, -1)

    def replaced(m: Column) -> Column:
        parts = F.transform(F.regexp_extract_all(m, F.lit(MARKED), F.lit(0)), lambda t: _with(F.translate(t, "<>", ""), lambda v: F.struct(v.alias("was"), pseudonym(v, key).alias("now"))))
        return F.struct(F.split(m, MARKED, -1).alias("around"), parts.alias("parts"))

    def joined(around: Column, between) -> Column:
        """What stands between matches, and what the matches became, in turn."""
        return F.array_join(F.transform(around, lambda a, i: F.concat(a, F.coalesce(between(i), F.lit("")))), "")

    def told(d: Column) -> Column:
        changed = F.size(F.filter(d["parts"], lambda p: p["was"] != p["now"])).cast("bigint")
        return F.struct(joined(d["around"], lambda i: F.get(d["parts"], i)["now"]).alias("now"), changed.alias("changed"))

    done = F.transform(found, lambda m: _with(_with(_marked(m), replaced), told))
    may = value.rlike("[0-9][0-9 .-]|@")  # as every match has
    rows = docs.select(*keep, value.alias(text), F.when(may, around).alias("__around"), F.when(may, done).alias("__done"))
    whole = joined(F.col("__around"), lambda i: F.get(F.col("__done"), i)["now"])
    changed = F.aggregate("__done", F.lit(0).cast("bigint"), lambda n, d: n + d["changed"])
    some = F.col("__done").isNotNull() & (F.size("__done") > 0)
    return rows.select(*keep, F.when(some, whole).otherwise(F.col(text)).alias(text), F.when(some, changed).otherwise(F.lit(0).cast("bigint")).alias("n_replaced"))
