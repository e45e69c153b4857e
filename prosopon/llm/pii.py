r"""Format-preserving pseudonyms for personal numbers and dates, with DataFrame functions only.

One regular expression finds candidates of every kind; each candidate is validated by its own rule, and only a valid one is replaced. Its
variable characters form a list of small numbers, each with a modulus: digits 10, letters 26, address bytes 256, the day of a 400-year
cycle 189 * 773. A balanced Feistel network of ROUNDS rounds runs over that list: each round adds to one half, position by position, numbers
from a SHA-512 of key, kind, round and the other half. That permutes the format: it can be undone with the key, equal values
get equal pseudonyms in all documents, however they are punctuated, and different values stay different.

| kind | valid if | kept |
|---|---|---|
| card | 13 to 19 digits with a right Luhn digit | length, separators; the check digit is made right again |
| iban | its country's number of characters, 8 digits at least, a right ISO 7064 remainder | country, length, case, letters stay letters; check digits made right again |
| phone | + and 8 to 15 digits, or ten digits as (ddd) ddd-dddd, ddd-ddd-dddd or ddd.ddd.dddd | leading +1, number of digits, separators |
| ssn | ddd-dd-dddd | separators |
| ip | four numbers up to 255 | being an address |
| date | a day of the calendar as yyyy-mm-dd, dd.mm.yyyy or mm/dd/yyyy (dd/mm/yyyy where only that is a day) | being a date, its form |
| email | local part of up to 64 characters, at a domain | domain, punctuation, letters and digits in place |

An IBAN ends where its country's length is reached, whatever words or digits follow, and a phone number ends before a date. Domains of addresses
stay in clear text.

Defined results: null text stays null with 0 replacements, empty text stays empty; everything that is not valid is left as it is; whole texts are
read; repeated rows get equal results; other columns are kept, and those named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosopon.functions.text import bind
from prosopon.llm.common import packed, unpacked

ROUNDS = 10
#: Days of a 400-year cycle, factored: each cycle of years from 1700 is permuted in itself.
CYCLE, CYCLE_DAYS, CYCLE_PARTS = "1700-01-01", 146097, (189, 773)

EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27,
    "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}


def iban_pattern() -> str:
    """An alternative per length, so that each candidate ends where its country's IBANs end."""
    countries: dict[int, list[str]] = {}
    for country, length in sorted(IBAN_LENGTHS.items()):
        countries.setdefault(length, []).append(country)
    ways = (rf"(?:{'|'.join(names)}|{'|'.join(names).lower()})\d{{2}}(?: ?[A-Za-z0-9]){{{length - 4}}}" for length, names in countries.items())
    return rf"(?<![A-Za-z0-9])(?=[A-Za-z]{{2}}\d{{2}})(?:{'|'.join(ways)})(?![A-Za-z0-9])"


IBAN = iban_pattern()
DATE_FORMS = r"\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4}"
DATE = rf"(?<![\d.\-/])(?:{DATE_FORMS})(?![\d\-/]|\.\d)"
IP = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)"
#: No digit, and no digit behind a hyphen, on either side: a hyphen alone is punctuation.
ALONE, SO_ALONE = r"(?<!\d)(?<!\d-)", r"(?!-?\d)"
SSN = rf"{ALONE}\d{{3}}-\d{{2}}-\d{{4}}{SO_ALONE}"
PHONE = (
    r"(?:\+1[ .\-]?)?\(\d{3}\) ?\d{3}[ .\-]?\d{4}(?!\d)"
    rf"|\+\d(?:(?![ .\-]?(?:{DATE_FORMS})(?!\d))[ .\-]?\(?\d\)?){{7,14}}(?!\d)"
    rf"|{ALONE}(?<!\.)(?:\d{{3}}-\d{{3}}-\d{{4}}|\d{{3}}\.\d{{3}}\.\d{{4}}){SO_ALONE}(?!\.\d)"
)
CARD = rf"{ALONE}(?:\d{{13,19}}|\d{{4}} \d{{4}} \d{{4}} \d{{4}}|\d{{4}}-\d{{4}}-\d{{4}}-\d{{4}}|\d{{4}} \d{{6}} \d{{5}}|\d{{4}}-\d{{6}}-\d{{5}}){SO_ALONE}"
#: In order of preference where several could start at one place.
PATTERNS = {"email": EMAIL, "iban": IBAN, "date": DATE, "ip": IP, "ssn": SSN, "phone": PHONE, "card": CARD}
#: A character that every candidate has; most texts fail this quick test.
HINT = "[0-9@]"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def feistel(values: Column, moduli: Column, kind: str, key: str) -> Column:
    """`values` permuted within `moduli`; both are arrays of int of one length."""
    half = F.size(values) - F.floor(F.size(values) / 2).cast("int")

    def one_round(held: Column, number: Column) -> Column:
        left = number % 2 == 0
        changes = lambda i: (i < half) == left
        other = F.array_join(F.transform(F.filter(held, lambda _, i: ~changes(i)), lambda x: x.cast("string")), ",")
        # A block of 32 numbers of 16 bits covers 32 positions of a half; longer halves go on with further blocks.
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(held) - 1) / 32).cast("int")), lambda b: F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), F.size(held).cast("string"), number.cast("string"), b.cast("string"), other).cast("binary"), 512))
        add = lambda stream, i: F.conv(F.substring(stream, 4 * i + 1, 4), 16, 10).cast("int")
        return bind(F.array_join(blocks, ""), lambda stream: F.transform(held, lambda x, i: F.when(changes(i), F.pmod(x + add(stream, i), F.get(moduli, i))).otherwise(x)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), values, one_round)


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def code(c: Column) -> Column:
    return F.when(c.between("0", "9"), F.ascii(c) - 48).when(c.between("a", "z"), F.ascii(c) - 97).otherwise(F.ascii(c) - 65)


def modulus(c: Column) -> Column:
    return F.when(c.between("0", "9"), 10).otherwise(26)


def written(value: Column, like: Column) -> Column:
    """The character of the class of `like` that stands for `value`."""
    base = F.when(like.between("0", "9"), 48).when(like.between("a", "z"), 97).otherwise(65)
    return F.char((base + value).cast("bigint"))


def permuted(text: Column, kind: str, key: str) -> Column:
    """ASCII letters and digits of `text` permuted, class by class; nothing else may occur in it."""
    return bind(chars(text), lambda cs: bind(feistel(F.transform(cs, code), F.transform(cs, modulus), kind, key), lambda vs: F.array_join(F.zip_with(vs, cs, written), "")))


def filled(template: Column, pattern: str, found: Column) -> Column:
    """`template` with its characters of `pattern`, in order, replaced by those of `found`, which has as many."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))

    def step(held: Column, c: Column) -> Column:
        own = c.rlike(f"^{pattern}$")
        return F.struct(F.concat(held["out"], F.when(own, F.substring(found, held["next"], 1)).otherwise(c)).alias("out"), (held["next"] + own.cast("int")).alias("next"))

    return F.aggregate(chars(template), start, step, lambda held: held["out"])


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def luhn_sum(number: Column, check: bool) -> Column:
    """Luhn sum of a digit string, with its check digit last or (`check` False) still missing."""
    first = 0 if check else 1

    def weight(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when((i + first) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(chars(F.reverse(number)), weight), F.lit(0), lambda a, x: a + x)


def card(text: Column, key: str) -> Column:
    def new(number: Column) -> Column:
        body = permuted(F.substring(number, F.lit(1), F.length(number) - 1), "card", key)
        return bind(body, lambda b: F.concat(b, F.pmod(-luhn_sum(b, False), F.lit(10)).cast("string")))

    return bind(digits(text), lambda n: F.when(F.length(n).between(13, 19) & (luhn_sum(n, True) % 10 == 0), filled(text, "[0-9]", new(n))))


def remainder(text: Column) -> Column:
    """A string of digits and capitals (A is 10) modulo 97."""
    return F.aggregate(chars(text), F.lit(0), lambda a, c: F.when(c.between("0", "9"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97)


def iban(text: Column, key: str) -> Column:
    def new(plain: Column) -> Column:
        country = F.substring(plain, 1, 2)
        body = permuted(F.substring(plain, F.lit(5), F.length(plain) - 4), "iban", key)
        return bind(body, lambda b: F.concat(country, F.lpad((98 - remainder(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))

    def valid(plain: Column) -> Column:
        right = remainder(F.concat(F.substring(plain, F.lit(5), F.length(plain) - 4), F.substring(plain, 1, 4))) == 1
        return (F.length(F.regexp_replace(plain, "[^0-9]", "")) >= 8) & right

    def as_found(made: Column) -> Column:
        """Letters in the case of `text`; a value and its pseudonym do not depend on it."""
        plain = F.replace(text, F.lit(" "), F.lit(""))
        return F.array_join(F.zip_with(chars(made), chars(plain), lambda m, c: F.when(c.between("a", "z"), F.lower(m)).otherwise(m)), "")

    return bind(F.upper(F.replace(text, F.lit(" "), F.lit(""))), lambda p: F.when(valid(p), filled(text, "[A-Za-z0-9]", as_found(new(p)))))


def phone(text: Column, key: str) -> Column:
    """The last ten digits of a number with +1 or without +, all digits of any other."""
    american = ~text.startswith("+") | text.rlike(r"^\+1(?:[^0-9]*[0-9]){10}[^0-9]*$")
    own = lambda n: F.when(american, F.right(n, F.lit(10))).otherwise(n)
    kept = lambda n: F.substring(n, F.lit(1), F.length(n) - F.length(own(n)))
    new = lambda n: F.concat(kept(n), F.when(american, permuted(own(n), "phone", key)).otherwise(permuted(n, "phone abroad", key)))
    return bind(digits(text), lambda n: filled(text, "[0-9]", new(n)))


def ip(text: Column, key: str) -> Column:
    parts = F.transform(F.split(text, r"\."), lambda x: x.cast("int"))
    valid = lambda p: F.forall(p, lambda x: x < 256)
    return bind(parts, lambda p: F.when(valid(p), F.array_join(F.transform(feistel(p, F.array(*[F.lit(256)] * 4), "ip", key), lambda x: x.cast("string")), ".")))


def day(date: Column, key: str) -> Column:
    """Another day of the same 400-year cycle."""
    first, (major, minor) = F.lit(CYCLE).cast("date"), CYCLE_PARTS

    def new(days: Column) -> Column:
        place = F.pmod(days, F.lit(CYCLE_DAYS))
        values = F.array(F.floor(place / minor).cast("int"), (place % minor).cast("int"))
        moved = feistel(values, F.array(F.lit(major), F.lit(minor)), "date", key)
        return F.date_add(first, bind(moved, lambda v: days - place + v[0] * minor + v[1]))

    return bind(F.datediff(date, first), new)


def date(text: Column, key: str) -> Column:
    def made(pattern: str, year: int, month: int, month_day: int) -> Column:
        """A date from its parts; null if there is no such day."""
        part = lambda at, n: F.substring(text, at, n)
        iso = F.concat_ws("-", part(year, 4), part(month, 2), part(month_day, 2))
        real = F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date")
        return bind(real, lambda d: F.when(d.isNotNull() & (F.substring(iso, 1, 4) > "0001"), F.date_format(day(d, key), pattern)))

    return F.when(F.substring(text, 5, 1) == "-", made("yyyy-MM-dd", 1, 6, 9)).when(F.substring(text, 3, 1) == ".", made("dd.MM.yyyy", 7, 4, 1)).otherwise(
        F.coalesce(made("MM/dd/yyyy", 7, 1, 4), made("dd/MM/yyyy", 7, 4, 1))
    )


def email(text: Column, key: str) -> Column:
    local = F.lower(F.substring_index(text, "@", 1))
    plain = F.regexp_replace(local, r"[^a-z0-9]", "")
    return F.concat(filled(local, "[a-z0-9]", permuted(plain, "email", key)), F.lit("@"), F.substring_index(text, "@", -1))


def ssn(text: Column, key: str) -> Column:
    return filled(text, "[0-9]", permuted(digits(text), "ssn", key))


MAKERS = {"email": email, "iban": iban, "date": date, "ip": ip, "ssn": ssn, "phone": phone, "card": card}


def pseudonym(found: Column, key: str) -> Column:
    """The pseudonym of one candidate; null if it is not valid."""
    out = None
    for kind, pattern in PATTERNS.items():
        # Look-arounds were met in the text; alone, the candidate has nothing around it.
        this = found.rlike(f"^(?:{pattern})$")
        made = MAKERS[kind](found, key)
        out = F.when(this, made) if out is None else out.when(this, made)
    return out


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """`docs` with the text replaced, and n_replaced."""
    rows = packed(docs, old=F.col(text)).withColumn("found", F.when(F.col("old").rlike(HINT) & F.col("old").rlike(ANY), F.regexp_extract_all("old", F.lit(ANY), F.lit(0))))
    made = F.transform("found", lambda x: F.struct(x.alias("old"), pseudonym(x, key).alias("new")))
    rows = rows.withColumn("found", F.when(F.col("found").isNotNull(), made))
    replaced = bind(
        F.split("old", ANY),
        lambda pieces: F.concat(
            F.array_join(F.transform("found", lambda x, i: F.concat(F.get(pieces, i), F.coalesce(x["new"], x["old"]))), ""), F.element_at(pieces, -1)
        ),
    )
    count = F.when(F.col("found").isNull(), 0).otherwise(F.size(F.filter("found", lambda x: x["new"].isNotNull())))
    return unpacked(rows, docs, **{text: F.when(F.col("found").isNull(), F.col("old")).otherwise(replaced)}, n_replaced=count.cast("long"))
