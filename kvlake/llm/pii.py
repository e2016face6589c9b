"""PII pseudonyms that keep their format, in DataFrame functions only.

Validated numbers and dates are replaced by a keyed permutation of their own
format: a Feistel network whose rounds are taken from a keyed SHA-256.  A
permutation maps equal values to equal pseudonyms and different values to
different ones, so documents stay linked and nothing collides.

===========  ==========================================  =====================
kind         found and validated as                      permuted within
===========  ==========================================  =====================
card         13 to 19 digits whose Luhn sum holds        all digits but the
                                                         check digit, which
                                                         stays right
iban         country, check digits and account number    digits of the account;
             whose remainder by 97 is 1                  the check digits follow
national id  area-group-serial (3, 2, 4 digits), none    all numbers so valid
             of them 0, area below 900 and not 666
phone        10 digits, or + and up to 15, in groups     all digits after a
             with ( ) - . or single spaces between       country code
ip           four numbers of at most 255; IPv6 of        all addresses; IPv6
             eight groups, or fewer with ::              is written in full
date         year-month-day or day/month/year that is    days of its 200 years,
             a day of the calendar                       none beyond 0001-9999
secret       32 to 64 hexadecimal digits, one of them    letters and digits of
             a number; known prefixes of keys            that length
email        local@domain                                letters and digits of
                                                         the local part
===========  ==========================================  =====================

Permutations work on a canonical form, without separators, so a value that is
written in several ways stays linked.  A text is cut at its candidates by one
pattern; the pieces between them are never touched.  Digits of other numbers
(years, versions, counts, time stamps) stay.

Defined results: a null text stays null; an empty text stays empty.  Candidates
that fail validation stay as they are.  Repeated rows get equal pseudonyms.  A
column named like an added count is replaced.  Without candidates a text, however
long, costs one pattern search.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlake.llm.common import without

ROUNDS = 6
ADDED = ("n_cards", "n_phones", "n_ips", "n_dates", "n_secrets", "n_emails", "n_ibans", "n_ids")
KINDS = ("card", "phone", "ip", "date", "secret", "email", "iban", "id")
EMAIL = r"[\p{L}0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
# Prefixes by which services mark their keys, with what follows them.
KEY = r"(?:A(?:KIA|SIA)[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{35}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64}|xox[abprs]-[0-9A-Za-z-]{10,72})"
PREFIX = r"^(A(?:KIA|SIA|Iza)|gh[pousr]_|sk-|xox[abprs]-)?"
SECRET = rf"(?<![0-9A-Za-z_-])(?:[0-9A-Fa-f]{{32,64}}|{KEY})(?![0-9A-Za-z])"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
IP6 = r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){1,7}(?:[0-9A-Fa-f]{1,4}|:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![0-9A-Za-z:])|(?<![0-9A-Za-z:.])::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}(?![0-9A-Za-z:])"
DATE = r"(?<![0-9/-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![0-9A-Za-z])"
ID = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9A-Za-z])"
_NEXT = r"(?![0-9]{4}-[0-9]{2}-|[0-9]{2}/)"  # a date that follows is no part of a phone number
PHONE = (
    r"(?<![0-9A-Za-z+])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"
    rf"|\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{1,4}}\)[ .-]?)?[0-9]{{2,4}}(?:[ .-]?{_NEXT}[0-9]{{2,4}}){{1,4}}(?![0-9A-Za-z]))"
)
FOUND = "|".join([EMAIL, IBAN, SECRET, IP, IP6, DATE, ID, CARD, PHONE])
# Country codes of one and two digits; all others have three.
SHORT_CODES = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
ERA = 73_000  # days of 200 years of 365
FIRST_DAY, LAST_ERA = -693_595, 2_920_000  # 0001-01-01, and the day of the last, shorter era, from 1900-01-01


def _round(key: str, kind: str, i: int, half: Column, modulus: Column) -> Column:
    """Round function: a keyed hash of the other half, below ``modulus`` (at most 10**15)."""
    h = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), F.lit(str(i)), half, modulus.cast("string")), 256)
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long") % modulus


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """Digit strings of 2 to 18 digits, permuted among those of equal length."""
    n = F.length(digits)
    h = F.floor(n / 2).cast("int")

    def split(s):
        ma, mb = F.pow(F.lit(10.0), s["h"]).cast("long"), F.pow(F.lit(10.0), s["n"] - s["h"]).cast("long")
        return F.struct(s["a"].alias("a"), s["b"].alias("b"), ma.alias("ma"), mb.alias("mb"), s["h"].alias("h"), s["n"].alias("n"))

    state = F.transform(
        F.array(F.struct(F.substring(digits, F.lit(1), h).cast("long").alias("a"), F.substring(digits, h + 1, n).cast("long").alias("b"), h.alias("h"), n.alias("n"))), split
    )
    for i in range(ROUNDS):  # one struct per round, so that no round is evaluated twice
        state = F.transform(state, _stepper(i, key, kind))
    out = F.transform(state, lambda s: F.concat(F.lpad(s["a"].cast("string"), s["h"], F.lit("0")), F.lpad(s["b"].cast("string"), s["n"] - s["h"], F.lit("0"))))
    return F.element_at(out, 1)


def _step(s: Column, i: int, key: str, kind: str) -> Column:
    a, b = s["a"], s["b"]
    if i % 2 == 0:
        a = (a + _round(key, kind, i, b.cast("string"), s["ma"])) % s["ma"]
    else:
        b = (b + _round(key, kind, i, a.cast("string"), s["mb"])) % s["mb"]
    return F.struct(a.alias("a"), b.alias("b"), s["ma"].alias("ma"), s["mb"].alias("mb"), s["h"].alias("h"), s["n"].alias("n"))


def _stepper(i: int, key: str, kind: str):
    return lambda s: _step(s, i, key, kind)


def _pair(a: Column, b: Column, ma: Column, mb: Column, key: str, kind: str) -> Column:
    """Struct (a, b) of numbers below (ma, mb) after the rounds."""
    state = F.array(F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), ma.cast("long").alias("ma"), mb.cast("long").alias("mb"), F.lit(0).alias("h"), F.lit(0).alias("n")))
    for i in range(ROUNDS):
        state = F.transform(state, _stepper(i, key, kind))
    return F.element_at(state, 1)


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string that ends in its check digit."""
    ds = F.reverse(F.split(digits, ""))
    ds = F.filter(ds, lambda d: d != "")
    return F.aggregate(
        F.transform(ds, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int")))), F.lit(0), lambda acc, x: acc + x
    )


def card(value: Column, key: str) -> Column:
    """All digits but the last are permuted; the last makes the Luhn sum what it
    was.  Separators stay."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    body = permute_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    state = F.array(F.struct(digits.alias("d"), body.alias("b")))
    new = F.transform(state, lambda s: F.concat(s["b"], ((luhn_sum(s["d"]) - luhn_sum(F.concat(s["b"], F.lit("0"))) + 200) % 10).cast("string")))
    return _into(value, F.element_at(new, 1))


def _into(shape: Column, digits: Column) -> Column:
    """Put digits, in order, in place of those of ``shape``."""
    chars = F.filter(F.split(shape, ""), lambda c: c != "")
    state = F.aggregate(
        chars,
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at"), digits.alias("d")),
        lambda s, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.substring(s["d"], s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"), s["d"].alias("d"))).otherwise(
            F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"), s["d"].alias("d"))
        ),
        lambda s: s["out"],
    )
    return state


def phone(value: Column, key: str) -> Column:
    """Digits after a country code are permuted; all else stays."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    code = F.when(value.startswith("+"), F.regexp_extract(digits, rf"^({SHORT_CODES}|[0-9]{{3}})", 1)).otherwise("")
    state = F.transform(F.array(F.struct(digits.alias("d"), code.alias("c"))), lambda s: F.concat(s["c"], permute_digits(F.substring(s["d"], F.length(s["c"]) + 1, F.length(s["d"])), key, "phone")))
    return _into(value, F.element_at(state, 1))


def ip(value: Column, key: str) -> Column:
    q = F.split(value, r"\.")
    at = [F.get(q, F.lit(i)).cast("long") for i in range(4)]
    half = F.lit(65536)
    out = _pair(at[0] * 256 + at[1], at[2] * 256 + at[3], half, half, key, "ip")
    state = F.transform(F.array(out), lambda s: F.concat_ws(".", F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256))
    return F.element_at(state, 1)


def ip6(value: Column, key: str) -> Column:
    """The address in full, its 32 digits permuted."""
    halves = F.split(F.lower(value), "::")
    head = F.filter(F.split(F.get(halves, F.lit(0)), ":"), lambda g: g != "")
    tail = F.filter(F.split(F.coalesce(F.get(halves, F.lit(1)), F.lit("")), ":"), lambda g: g != "")
    zeros = F.array_repeat(F.lit("0"), F.greatest(8 - F.size(head) - F.size(tail), F.lit(0)))
    digits = F.array_join(F.transform(F.concat(head, zeros, tail), lambda g: F.lpad(g, 4, "0")), "")
    return F.regexp_replace(permute_text(digits, key, "ip6", [HEX]), "(.{4})(?=.)", "$1:")


def national_id(value: Column, key: str) -> Column:
    """Another valid number: areas 001-899 without 666, groups 01-99, serials 0001-9999."""
    part = F.split(value, "-")
    area, group, serial = (F.get(part, F.lit(i)).cast("long") for i in range(3))
    place = area - F.when(area > 666, 2).otherwise(1)
    out = _pair(place * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "id")

    def shown(s):
        n = F.floor(s["a"] / 99)
        of = F.when(n >= 665, n + 2).otherwise(n + 1)
        return F.concat_ws("-", F.lpad(of.cast("string"), 3, "0"), F.lpad((s["a"] % 99 + 1).cast("string"), 2, "0"), F.lpad((s["b"] + 1).cast("string"), 4, "0"))

    return F.element_at(F.transform(F.array(out), shown), 1)


def iban_rest(plain: Column) -> Column:
    """Remainder by 97 of an account number with its first four characters last
    and letters as numbers from 10."""
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(4)))
    chars = F.filter(F.split(moved, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97))


def iban(value: Column, key: str) -> Column:
    """Digits of the account are permuted, and the check digits follow."""
    plain = F.regexp_replace(value, " ", "")
    account = permute_text(F.substring(plain, F.lit(5), F.length(plain)), key, "iban", [DIGITS])
    whole = F.transform(F.array(F.concat(F.substring(plain, F.lit(1), F.lit(2)), F.lit("00"), account)), lambda p: F.concat(F.substring(p, F.lit(1), F.lit(2)), F.lpad((98 - iban_rest(p)).cast("string"), 2, "0"), F.substring(p, F.lit(5), F.length(p))))
    return F.element_at(F.transform(whole, lambda p: F.when(value.contains(" "), F.regexp_replace(p, "(.{4})(?=.)", "$1 ")).otherwise(p)), 1)


def _as_date(value: Column) -> Column:
    day = F.coalesce(F.try_to_timestamp(F.when(value.contains("-"), value), F.lit("yyyy-MM-dd")), F.try_to_timestamp(F.when(value.contains("/"), value), F.lit("dd/MM/yyyy"))).cast("date")
    return F.when(day >= F.lit("0001-01-01").cast("date"), day)


def date(value: Column, key: str) -> Column:
    """A day of the same era, in the same notation.

    Eras are 73,000 days from 1900-01-01 both ways; the first and last are what
    is left of the years 1 to 9999."""
    start = F.lit("1900-01-01").cast("date")
    days = F.datediff(_as_date(value), start)
    era = F.floor(days / ERA) * ERA
    first, last = era < FIRST_DAY, era >= LAST_ERA
    ma, mb = F.when(first, 65).when(last, 64).otherwise(365), F.when(first, 563).when(last, 601).otherwise(200)
    state = F.array(F.struct(F.greatest(era, F.lit(FIRST_DAY)).cast("int").alias("o"), days.alias("d"), ma.alias("ma"), mb.alias("mb"), value.alias("v")))
    state = F.transform(state, lambda s: F.struct(_pair((s["d"] - s["o"]) % s["ma"], F.floor((s["d"] - s["o"]) / s["ma"]), s["ma"], s["mb"], key, "date").alias("p"), s["o"].alias("o"), s["v"].alias("v")))
    moved = F.transform(state, lambda s: F.struct(F.date_add(start, (s["o"] + s["p"]["b"] * s["p"]["ma"] + s["p"]["a"]).cast("int")).alias("day"), s["v"].alias("v")))
    return F.element_at(F.transform(moved, lambda s: F.when(s["v"].contains("/"), F.date_format(s["day"], "dd/MM/yyyy")).otherwise(F.date_format(s["day"], "yyyy-MM-dd"))), 1)


def _keystream(value: Column, kind: str, key: str, i: int, n: Column) -> Column:
    """Two hexadecimal digits for each of ``n`` characters."""
    blocks = F.sequence(F.lit(0), F.greatest(F.ceil(n / 32).cast("int") - 1, F.lit(0)))
    return F.array_join(F.transform(blocks, lambda j: F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), F.lit(str(i)), j.cast("string"), value), 256)), "")


def _shift(chars: Column, by: Column, alphabets: list[str]) -> Column:
    """Each character moved within its alphabet by the stream; others stay."""
    cs = F.filter(F.split(chars, ""), lambda c: c != "")

    def move(c, i):
        step = F.conv(F.substring(by, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
        out = c
        for a in alphabets:
            place = F.instr(F.lit(a), c)
            out = F.when(place > 0, F.substring(F.lit(a), (place - 1 + step) % len(a) + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(cs, move), "")


def permute_text(value: Column, key: str, kind: str, alphabets: list[str]) -> Column:
    """Feistel over the two halves of a text of any length: each half's characters
    are moved within their alphabets by a keyed stream of the other half."""
    h = F.floor(F.length(value) / 2).cast("int")
    state = F.array(F.struct(F.substring(value, F.lit(1), h).alias("a"), F.substring(value, h + 1, F.length(value)).alias("b")))

    def turn(i):
        def moved(s):
            a, b = s["a"], s["b"]
            if i % 2 == 0:
                b = _shift(b, _keystream(a, kind, key, i, F.length(b)), alphabets)
            else:
                a = _shift(a, _keystream(b, kind, key, i, F.length(a)), alphabets)
            return F.struct(a.alias("a"), b.alias("b"))

        return moved

    for i in range(4):
        state = F.transform(state, turn(i))
    return F.element_at(F.transform(state, lambda s: F.concat(s["a"], s["b"])), 1)


def secret(value: Column, key: str) -> Column:
    prefix = F.regexp_extract(value, PREFIX, 1)
    rest = F.substring(value, F.length(prefix) + 1, F.length(value))
    hexadecimal = permute_text(value, key, "secret", [HEX, "ABCDEF"])
    return F.when(prefix == "", hexadecimal).otherwise(F.concat(prefix, permute_text(rest, key, "secret", [LOWER, UPPER, DIGITS])))


LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
ACCENTED = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"


def _kind(m: Column) -> Column:
    """Kind of a candidate, or null where validation fails."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    octets = F.forall(F.split(m, r"\."), lambda o: o.cast("int") <= 255)
    groups = F.size(F.filter(F.split(m, ":"), lambda g: g != ""))
    six = F.when(m.contains("::"), groups < 8).otherwise(groups == 8)
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.when(octets, "ip"))
        .when(m.contains(":"), F.when(six, "ip6"))
        .when(m.rlike(r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})$"), F.when(_as_date(m).isNotNull(), "date"))
        .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(~m.rlike("^(000|666|9)|-00-|-0000$"), "id"))
        .when(m.rlike(r"^([0-9]{13,19}|[0-9]{4}([ -][0-9]{4}){3})$"), F.when(luhn_sum(digits) % 10 == 0, "card"))
        .when(m.rlike(rf"^{KEY}$"), "secret")
        .when(m.rlike(r"^[0-9A-Fa-f]{32,64}$"), F.when(m.rlike("[0-9]"), "secret"))
        .when(m.rlike("^[A-Z]{2}[0-9]{2}"), F.when(iban_rest(F.regexp_replace(m, " ", "")) == 1, "iban"))
        .when(F.length(digits).between(10, 15), "phone")
    )


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    return (
        F.when(kind == "card", card(m, key))
        .when(kind == "phone", phone(m, key))
        .when(kind == "ip", ip(m, key))
        .when(kind == "ip6", ip6(m, key))
        .when(kind == "date", date(m, key))
        .when(kind == "id", national_id(m, key))
        .when(kind == "iban", iban(m, key))
        .when(kind == "secret", secret(m, key))
        .when(kind == "email", F.concat(permute_text(local, key, "email", [LOWER, UPPER, DIGITS, *ACCENTED]), F.lit("@"), domain))
        .otherwise(m)
    )


def _is(kind: str):
    return lambda s: s["k"].isin("ip", "ip6") if kind == "ip" else s["k"] == kind


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in the text, and a count of each kind replaced.

    ``key`` is the secret of the permutations; without it they can't be undone.
    """
    docs = without(docs, *ADDED)
    names = [c for c in docs.columns if c.lower() != text_col.lower()]
    text = F.col(f"`{text_col}`")
    some = text.rlike("[0-9@]|::")
    cut = docs.select("*", F.when(some, F.regexp_extract_all(text, F.lit(FOUND), F.lit(0))).alias("_m"))
    cut = cut.select("*", F.when(F.size("_m") > 0, F.split(text, FOUND, -1)).alias("_p"))
    cut = cut.select("*", F.transform("_m", lambda m: F.struct(m.alias("m"), _kind(m).alias("k"))).alias("_k"))
    new = F.transform("_k", lambda s: pseudonym(s["m"], s["k"], key))
    cut = cut.select("*", F.when(F.size("_m") > 0, new).alias("_n"))
    joined = F.array_join(F.flatten(F.zip_with("_p", F.concat("_n", F.array(F.lit(""))), lambda p, n: F.array(p, n))), "")
    kinds = [F.coalesce(F.size(F.filter("_k", _is(k))), F.lit(0)) for k in KINDS]
    return cut.select(*[f"`{c}`" for c in names], F.coalesce(F.when(F.size("_m") > 0, joined), text).alias(text_col), *[F.greatest(c, F.lit(0)).cast("long").alias(n) for n, c in zip(ADDED, kinds)])
