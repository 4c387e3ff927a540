"""Format-preserving pseudonyms for personal data and secrets, with DataFrame functions only.

Values are found by one pattern, validated by kind (Luhn, ISO 13616, octets,
calendar, issued social-security numbers, phone numbers by length or, without a
country, by area and exchange) and replaced by a keyed permutation within their
format:

* strings (mail names, cards, accounts, phones of other countries, secrets): a Feistel
  network over the two halves of the characters; each character moves within its own
  alphabet (digits, lower, upper case, or hex digits) by a key stream derived from
  the other half. Check digits are computed anew;
* addresses, social-security numbers, phone numbers of code 1 or no code: a Feistel
  network over the places of the valid ones. A country's calling code always stays;
* dates: a Feistel network over day numbers, within spans of 73,000 days from 1900 on
  and back; the first span begins on 0001-01-01 and the last one ends on 9999-12-31,
  both shorter. What only reads as month first stays so: such dates are permuted
  again until the day is above 12.

The permutation depends on the key, the kind and the value alone, so equal values
stay linked across documents, and different ones stay different.

Defined results: a null or empty text has no findings and is returned as it is;
text around findings is kept byte for byte; values that fail validation are kept;
repeated rows get equal results; an empty table gives no rows; other columns are
passed through, unless they clash with the result's names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 6
#: Longer halves enter the key stream as their digest, so that its cost stays linear.
LONG = 256
DEMO_KEY = "set a secret key in production"

# What the kinds look like. Runs are bounded or possessive, so that matching is linear in the text.
# A secret is taken whole: dots and = within it, and = behind it, but no full stop.
# A name may end a longer word (authToken, dbpassword).
NAMED = r"(?i:(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)"
#: No finding is without one of these; a look for them is all that most texts cost.
SIGNS = "[0-9@=:]|A[KS]IA"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": r"(?=[TtSsPpAa])" + NAMED + r"[A-Za-z0-9_+/-]{12,}+(?:[.=]++[A-Za-z0-9_+/-]++)*+=*+|(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![\w/-]|\.[0-9])",
    "ip": r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9])",
    "phone": r"(?<![\w+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}(?![\w])|(?<![\w.+-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[.-][0-9]{4}(?![\w]|[.-][0-9])",
    "ssn": r"(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w]|[.-][0-9])",
    "card": r"(?<![\w.+-])[0-9](?:[ -]?[0-9]){12,18}(?![\w]|[.-][0-9])",
}
#: "secret" first: what a name announces is taken whole; then in order.
ORDER = ("secret", "email", "iban", "date", "ip", "phone", "ssn", "card")
ANY = "|".join(f"(?:{PATTERNS[k]})" for k in ORDER)
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
#: ISO 13616: how long account numbers are; of other countries, any length is tried.
IBAN_SIZES = {
    country: int(size)
    for size, countries in {
        "15": "NO", "16": "BE", "18": "DK FI FO GL NL SD", "19": "MK SI", "20": "AT BA EE KZ LT LU XK", "21": "CH HR LI LV", "22": "BG BH CR DE GB GE IE ME RS VA", "23": "AE GI IL IQ OM SO TL",
        "24": "AD CZ ES MD PK RO SA SE SK TN VG", "25": "LY PT ST", "26": "IS TR", "27": "BI DJ FR GR IT MC SM", "28": "AL AZ BY CY DO GT HU LB NI PL SV", "29": "BR EG PS QA UA", "30": "JO KW MU", "31": "MT SC", "32": "LC", "33": "RU",
    }.items()
    for country in countries.split()
}
# Calling codes of one and two digits, and that all others have three; area and exchange of code 1.
CALLING_CODE = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"
HOME = "[2-9][0-9]{2}[2-9][0-9]{6}"
DAYS = (250, 292)  # a span of 73,000 days
#: From 1900-01-01: first day, last day + 1, and the spans at both ends, of 36,595 and 38,464 days.
FIRST_DAY, END_DAY, FIRST_DAYS, LAST_DAYS = -693_595, 2_958_464, (65, 563), (64, 601)
#: Permutations until a date reads as month first: two of five do not, so that all these miss once in 10^25 values.
WALK = 64


def _number(digest: Column, at: int, length: int) -> Column:
    return F.conv(F.substring(digest, at, length), 16, 10).cast("long")


def _stream(key: str, kind: str, n: Column, other: Column, length: Column) -> Column:
    """Key stream: a number of four hex digits for each of `length` characters."""
    told = F.when(F.length(other) > LONG, F.sha2(other, 512)).otherwise(other)
    seed = F.concat(F.lit(f"{key}\0{kind}\0"), n.cast("string"), F.lit("\0"), told)
    # arrays of one bind a value, so that it is made once and not for each block
    blocks = F.flatten(F.transform(F.array(seed), lambda s: F.transform(F.sequence(F.lit(0), F.floor((length + 31) / 32).cast("int")), lambda b: F.sha2(F.concat(s, F.lit("\0"), b.cast("string")), 512))))
    numbers = F.flatten(F.transform(blocks, lambda b: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substring(b, i * 4 + 1, F.lit(4)), 16, 10).cast("int"))))
    return F.slice(numbers, 1, length)


def _shift(text: Column, stream: Column, alphabets: tuple[str, ...]) -> Column:
    """Each character moves within the first of the alphabets that holds it."""

    def one(c: Column, by: Column) -> Column:
        out = c
        for a in reversed(alphabets):
            out = F.when(F.instr(F.lit(a), c) > 0, F.substring(F.lit(a), (F.instr(F.lit(a), c) - 1 + by) % len(a) + 1, F.lit(1))).otherwise(out)
        return out

    return F.when(F.length(text) == 0, text).otherwise(F.array_join(F.zip_with(F.split(text, ""), stream, one), ""))


def permuted(text: Column, key: str, kind: str, *alphabets: str) -> Column:
    """Feistel network over the halves of a string."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    halves = F.struct(F.substring(text, F.lit(1), half).alias("a"), F.substring(text, half + 1, n).alias("b"))

    def step(s: Column, i: Column) -> Column:
        a, b = s["a"], s["b"]
        mark = F.concat(n.cast("string"), F.lit("/"), i.cast("string"))
        even = F.struct(_shift(a, _stream(key, kind, mark, b, F.length(a)), alphabets).alias("a"), b.alias("b"))
        odd = F.struct(a.alias("a"), _shift(b, _stream(key, kind, mark, a, F.length(b)), alphabets).alias("b"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), halves, step, lambda s: F.concat(s["a"], s["b"]))


def permuted_number(value: Column, key: str, kind: str, high: int, low: int) -> Column:
    """Feistel network over a number below high * low."""
    start = F.struct(F.floor(value / low).cast("long").alias("a"), (value % low).cast("long").alias("b"))

    def step(s: Column, i: Column) -> Column:
        def by(other: Column) -> Column:
            return _number(F.sha2(F.concat(F.lit(f"{key}\0{kind}\0"), i.cast("string"), F.lit("\0"), other.cast("string")), 256), 1, 12)

        even = F.struct(((s["a"] + by(s["b"])) % high).alias("a"), s["b"].alias("b"))
        odd = F.struct(s["a"].alias("a"), ((s["b"] + by(s["a"])) % low).alias("b"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: s["a"] * low + s["b"])


def luhn_sum(digits: Column, n: Column) -> Column:
    """Luhn sum of a digit string, of which the last is not doubled."""

    def one(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), one)


def refill(mask: Column, digits: Column) -> Column:
    """The mask with its letters and digits replaced, one after another, by those of `digits`."""

    def one(s: Column, i: Column) -> Column:
        c = F.substring(mask, i, F.lit(1))
        fill = c.rlike("[A-Za-z0-9]")
        return F.struct(F.concat(s["t"], F.when(fill, F.substring(digits, s["k"], F.lit(1))).otherwise(c)).alias("t"), F.when(fill, s["k"] + 1).otherwise(s["k"]).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), F.length(mask)), F.struct(F.lit("").alias("t"), F.lit(1).alias("k")), one, lambda s: s["t"])


def iban_rest(country_and_bban: Column) -> Column:
    """Remainder mod 97 of an account number (BBAN, country, check digits), letters as two digits."""

    def one(r: Column, i: Column) -> Column:
        c = F.substring(country_and_bban, i, F.lit(1))
        v = F.instr(F.lit(DIGITS + UPPER), c) - 1
        return F.when(v > 9, (r * 100 + v) % 97).otherwise((r * 10 + v) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(country_and_bban)), F.lit(0), one)


def _bare(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^A-Za-z0-9]", "")


#: A pseudonym's expression is made where it is used: making one takes a hundred times as long as a look at a column.
Made = Callable[[], Column]


def _card(hit: Column, key: str) -> tuple[Column, Made]:
    bare = _bare(hit)
    n = F.length(bare)
    valid = luhn_sum(bare, n) % 10 == 0

    def made() -> Column:
        body = permuted(F.substring(bare, F.lit(1), n - 1), key, "card", DIGITS)
        digit = F.aggregate(F.array(F.concat(body, F.lit("0"))), F.lit(""), lambda _, b: F.concat(F.substring(b, F.lit(1), n - 1), ((10 - luhn_sum(b, n) % 10) % 10).cast("string")))
        return refill(hit, digit)

    return valid, made


def _iban(hit: Column, key: str) -> tuple[Column, Made]:
    bare = _bare(hit)
    country = F.substring(bare, F.lit(1), F.lit(2))
    bban = F.substring(bare, F.lit(5), F.length(bare))
    valid = iban_rest(F.concat(bban, country, F.substring(bare, F.lit(3), F.lit(2)))) == 1

    def made() -> Column:
        moved = permuted(bban, key, "iban", DIGITS, UPPER)
        whole = F.aggregate(F.array(moved), F.lit(""), lambda _, m: F.concat(country, F.lpad((98 - iban_rest(F.concat(m, country, F.lit("00")))).cast("string"), 2, "0"), m))
        return refill(hit, whole)

    return valid, made


def _ip(hit: Column, key: str) -> tuple[Column, Made]:
    octets = F.transform(F.split(hit, r"\."), lambda x: x.cast("long"))
    valid = F.forall(octets, lambda x: x <= 255)
    value = F.aggregate(octets, F.lit(0).cast("long"), lambda s, x: s * 256 + x)
    moved = F.transform(F.array(permuted_number(value, key, "ip", 1 << 16, 1 << 16)), lambda v: F.array_join(F.array(*[(F.floor(v / (1 << s)) % 256).cast("string") for s in (24, 16, 8, 0)]), "."))
    return valid, lambda: F.get(moved, F.lit(0))


def _date(hit: Column, key: str) -> tuple[Column, Made]:
    form = F.when(hit.contains("-"), F.lit("yyyy-MM-dd")).when(hit.contains("/"), F.lit("dd/MM/yyyy")).otherwise(F.lit("dd.MM.yyyy"))
    # day first, or month first where only that is a date
    other = F.when(hit.contains("/"), F.lit("MM/dd/yyyy")).otherwise(form)
    day, day2 = (F.try_to_timestamp(hit, f).cast("date") for f in (form, other))
    epoch = F.lit("1900-01-01").cast("date")
    moved = lambda v: _moved_day(v, key)
    far = lambda v: F.dayofmonth(F.date_add(epoch, v.cast("int"))) > 12
    start = F.struct(F.datediff(F.coalesce(day, day2), epoch).cast("long").alias("v"), F.lit(False).alias("done"))

    def walk(s: Column, _: Column) -> Column:
        return F.when(s["done"], s).otherwise(F.transform(F.array(moved(s["v"])), lambda v: F.struct(v.alias("v"), far(v).alias("done")))[0])

    number = F.datediff(F.coalesce(day, day2), epoch).cast("long")
    new = F.when(day.isNotNull(), moved(number)).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, walk, lambda s: s["v"]))
    iso = F.get(F.transform(F.array(new), lambda v: F.date_format(F.date_add(epoch, v.cast("int")), "yyyyMMdd")), F.lit(0))
    y, m, d = F.substring(iso, 1, 4), F.substring(iso, 5, 2), F.substring(iso, 7, 2)
    text = F.when(hit.contains("-"), F.concat_ws("-", y, m, d)).when(hit.contains("/"), F.when(day.isNotNull(), F.concat_ws("/", d, m, y)).otherwise(F.concat_ws("/", m, d, y))).otherwise(F.concat_ws(".", d, m, y))
    return number.isNotNull(), lambda: text


def _moved_day(number: Column, key: str) -> Column:
    """Day number from 1900-01-01 -> another one of its span."""
    size = DAYS[0] * DAYS[1]
    first, last = FIRST_DAY + FIRST_DAYS[0] * FIRST_DAYS[1], END_DAY - LAST_DAYS[0] * LAST_DAYS[1]
    span = F.floor(number / size) * size
    inner = permuted_number(number - span, key, "date", *DAYS) + span
    low = permuted_number(number - FIRST_DAY, key, "date", *FIRST_DAYS) + FIRST_DAY
    high = permuted_number(number - last, key, "date", *LAST_DAYS) + last
    return F.when(number < first, low).when(number >= last, high).otherwise(inner)


def _ssn(hit: Column, key: str) -> tuple[Column, Made]:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    valid = hit.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
    area, group, serial = (F.substring(hit, a, n).try_cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    place = area - F.when(area > 666, 2).otherwise(1)
    moved = permuted_number((place * 99 + group - 1) * 9999 + serial - 1, key, "ssn", 898 * 99, 9999)

    def shown(v: Column) -> Column:
        area = F.floor(v / (99 * 9999)) + 1
        parts = ((area + F.when(area > 665, 1).otherwise(0), 3), (F.floor(v / 9999) % 99 + 1, 2), (v % 9999 + 1, 4))
        return F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in parts])

    return valid, lambda: F.get(F.transform(F.array(moved), shown), F.lit(0))


def _abroad(bare: Column, key: str) -> Column:
    """Digits of a number with its country's code, which stays; of what follows, a first 0 stays a 0 and any other digit does not become one."""
    lead = F.length(F.regexp_extract(bare, "^(?:" + CALLING_CODE + ")", 0))
    rest = F.substring(bare, lead + 1, F.length(bare))
    coded = F.concat(F.translate(F.substring(rest, F.lit(1), F.lit(1)), "1234567890", "abcdefghiz"), F.substring(rest, F.lit(2), F.length(rest)))
    moved = permuted(coded, key, "phone", DIGITS, "abcdefghi", "z")
    return F.concat(F.substring(bare, F.lit(1), lead), F.translate(moved, "abcdefghiz", "1234567890"))


def _home(bare: Column, key: str) -> Column:
    """Ten digits; area and exchange do not begin with 0 or 1."""
    area, exchange, line = (F.substring(bare, a, n).try_cast("long") for a, n in ((1, 3), (4, 3), (7, 4)))
    moved = permuted_number(((area - 200) * 800 + exchange - 200) * 10_000 + line, key, "phone", 800 * 800, 10_000)
    return F.get(F.transform(F.array(moved), lambda v: F.concat((F.floor(v / 8_000_000) + 200).cast("string"), (F.floor(v / 10_000) % 800 + 200).cast("string"), F.lpad((v % 10_000).cast("string"), 4, "0"))), F.lit(0))


def _phone(hit: Column, key: str) -> tuple[Column, Made]:
    """With a country: 8 to 15 digits. Without, it is that of code 1: the same number is linked with and without it, however it is spaced."""
    bare = _bare(hit)
    valid = F.when(hit.startswith("+"), bare.rlike("^[1-9][0-9]{7,14}$")).otherwise(bare.rlike(f"^{HOME}$"))
    code = F.when(bare.rlike(f"^1{HOME}$"), F.lit("1")).otherwise(F.lit(""))

    def made() -> Column:
        of_home = F.concat(code, _home(F.substring(bare, F.length(code) + 1, F.lit(10)), key))
        return refill(hit, F.when((code == "1") | ~hit.startswith("+"), of_home).otherwise(_abroad(bare, key)))

    return valid, made


def _kinds(hit: Column, key: str) -> list[tuple[str, Column, Column, Made]]:
    """(kind, is of this kind, is valid, pseudonym), in the order of the pattern."""
    true = F.lit(True)
    at = F.instr(hit, "@")
    mail = F.concat(permuted(F.substring(hit, F.lit(1), at - 1), key, "email", DIGITS, LOWER, UPPER), F.substring(hit, at, F.length(hit)))
    lead = F.when(hit.rlike("^A[KS]IA[A-Z0-9]{16}$"), F.lit(4)).otherwise(F.length(F.regexp_extract(hit, "^" + NAMED, 0)))
    told = F.substring(hit, lead + 1, F.length(hit))
    secret = F.concat(F.substring(hit, F.lit(1), lead), F.when(told.rlike("^[0-9a-f]+$"), permuted(told, key, "secret", HEX)).otherwise(permuted(told, key, "secret", DIGITS, LOWER, UPPER)))
    rows = [
        ("email", hit.rlike("^(?:" + PATTERNS["email"] + ")$"), true, lambda: mail),
        ("iban", hit.rlike("^(?:" + PATTERNS["iban"] + ")$"), *_iban(hit, key)),
        ("date", hit.rlike("^(?:" + PATTERNS["date"] + ")$"), *_date(hit, key)),
        ("ip", hit.rlike("^(?:" + PATTERNS["ip"] + ")$"), *_ip(hit, key)),
        ("phone", hit.rlike("^(?:" + PATTERNS["phone"] + ")$"), *_phone(hit, key)),
        ("ssn", hit.rlike("^(?:" + PATTERNS["ssn"] + ")$"), *_ssn(hit, key)),
        ("card", hit.rlike("^(?:" + PATTERNS["card"] + ")$"), *_card(hit, key)),
    ]
    return [("secret", hit.rlike("^(?:" + PATTERNS["secret"] + ")$"), true, lambda: secret), *rows]


KINDS = ("email", "iban", "date", "ip", "phone", "ssn", "card", "secret")


def _ends(hit: Column, key: str) -> Column:
    """The hit, or where a card's or account's number fails, its longest valid beginning before a blank or hyphen."""
    like = lambda kind: hit.rlike("^(?:" + PATTERNS[kind] + ")$")

    def longest(valid) -> Column:
        begins = F.transform(F.sequence(F.lit(1), F.length(hit)), lambda i: F.substring(hit, F.lit(1), i))
        return F.coalesce(F.try_element_at(F.filter(begins, lambda b: F.substring(hit, F.length(b) + 1, F.lit(1)).isin(" ", "-") & valid(b)), F.lit(-1)), hit)

    def card(b: Column) -> Column:
        return (F.length(_bare(b)) > 12) & _card(b, key)[0]

    def iban(b: Column) -> Column:
        size = F.try_element_at(F.create_map(*[F.lit(x) for kv in IBAN_SIZES.items() for x in kv]), F.substring(b, F.lit(1), F.lit(2)))
        return b.rlike("^(?:" + PATTERNS["iban"] + ")$") & (F.length(_bare(b)) == F.coalesce(size, F.length(_bare(b)))) & _iban(b, key)[0]

    # the order of the kinds: no hit is of two of these
    out = hit
    for name, of, valid in (("card", _card, card), ("iban", _iban, iban)):
        out = F.when(like(name) & ~like("secret") & ~of(hit, key)[0], longest(valid)).otherwise(out)
    return out


def found(text: Column, key: str = DEMO_KEY) -> Column:
    """Array of struct(value, kind, pseudonym, at), one for each place where a pattern matches, in text order; kind
    is null where validation fails. `at` is the text from there to the next place: values may go beyond it."""

    def one(hit: Column, at: Column) -> Column:
        rows = _kinds(hit, key)
        kind = F.lit(None).cast("string")
        for name, like, valid, _ in reversed(rows):
            kind = F.when(like, F.when(valid, F.lit(name))).otherwise(kind)

        def row(k: Column) -> Column:  # the kind is bound, so that it is found once
            new = hit
            for name, _, _, pseudonym in rows:
                new = F.when(k == name, pseudonym()).otherwise(new)
            return F.struct(hit.alias("value"), k.alias("kind"), new.alias("pseudonym"), at.alias("at"))

        return F.get(F.transform(F.array(kind), row), F.lit(0))

    hits = F.transform(F.regexp_extract_all(text, F.lit(f"(?=({ANY}))"), F.lit(1)), lambda h: _ends(h, key))
    return F.zip_with(hits, F.slice(_places(text), 2, F.length(text) + 1), one)


def _places(text: Column) -> Column:
    """What stands before the first place where a pattern matches, behind a blank, and the text from each to the next."""
    return F.split(F.concat(F.lit(" "), text), f"(?={ANY})", -1)


def _taken(places: Column) -> Column:
    """The places without those within an earlier valid value; `at` is what such a value leaves of its own and of those."""
    def step(s: Column, x: Column) -> Column:
        value = F.when(x["kind"].isNull(), F.lit(0)).otherwise(F.length(x["value"]))
        covered = s["left"] > 0
        left = F.when(covered, s["left"]).otherwise(value)
        rest = F.substring(x["at"], left + 1, F.length(x["at"]))
        piece = F.struct(F.when(~covered, x["value"]).alias("value"), F.when(~covered, x["kind"]).alias("kind"), F.when(~covered, x["pseudonym"]).alias("pseudonym"), rest.alias("at"))
        return F.struct(F.greatest(F.lit(0), left - F.length(x["at"])).alias("left"), F.concat(s["out"], F.array(piece)).alias("out"))

    none = F.array().cast("array<struct<value:string,kind:string,pseudonym:string,at:string>>")
    return F.aggregate(places, F.struct(F.lit(0).alias("left"), none.alias("out")), step, lambda s: s["out"])


def pseudonymize(docs: DataFrame, key: str = DEMO_KEY) -> DataFrame:
    """`docs` with the text replaced, and: found (see above), n_found, n_<kind>."""
    text = F.col("text").cast("string")
    has = F.coalesce(text.rlike(SIGNS) & text.rlike(ANY), F.lit(False))
    d = docs.drop("found", "n_found", *[f"n_{k}" for k in KINDS]).withColumn("found", F.when(has, _taken(found(text, key))))
    first = F.substring(F.get(_places(text), F.lit(0)), F.lit(2), F.length(text))
    whole = F.concat(first, F.array_join(F.transform("found", lambda x: F.concat(F.when(x["kind"].isNotNull(), x["pseudonym"]).otherwise(F.lit("")), x["at"])), ""))
    found_ = F.transform(F.filter("found", lambda x: x["value"].isNotNull()), lambda x: F.struct(x["value"].alias("value"), x["kind"].alias("kind"), x["pseudonym"].alias("pseudonym")))
    d = d.withColumn("text", F.when(F.col("found").isNull(), text).otherwise(whole)).withColumn("found", found_)

    def count(kind: str) -> Column:
        return F.when(F.col("found").isNull(), 0).otherwise(F.size(F.filter("found", lambda x: x["kind"] == kind)))

    d = d.withColumns({f"n_{k}": count(k) for k in KINDS})
    return d.withColumn("n_found", sum((F.col(f"n_{k}") for k in KINDS), F.lit(0)))
