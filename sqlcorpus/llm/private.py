"""Format-preserving pseudonyms for personal data, in built-in column functions only.

Card numbers (Luhn), IBANs (mod 97), phone numbers, IPv4 addresses and ISO dates are permuted
within their format by a keyed Feistel network, and e-mail addresses get a keyed local part. The
permutation depends on the key and the value alone, so equal values stay linked across
documents and different values stay different. Separators stay where they are; card numbers and
IBANs get check digits that are right again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# The shapes that are looked for, in the order in which they are tried.
SHAPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![0-9-])(?:1[89]|2[01])[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9-])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
}
# IBANs are looked for first (see ``valid_ibans``); ``__IBANS__`` stands for those that a text has.
OTHERS = "|".join(f"(?:{p})" for k, p in SHAPES.items() if k != "iban")
ANY = "|".join(f"(?:{'(?<![A-Za-z0-9])(?:__IBANS__)(?![A-Za-z0-9])' if k == 'iban' else p})" for k, p in SHAPES.items())
IBAN_HERE = r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![A-Za-z0-9])))"
#: Characters of a country's IBAN, from the public registry. For other countries any length goes.
IBAN_LENGTHS = {
    n: c.split()
    for n, c in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 33: "RU", 32: "LC",
    }.items()
}

CYCLE = 146_097  # days of 400 years, 27 x 5411; dates from 1800-01-01 to 2199-12-31
DATE_LEFT, DATE_RIGHT = 27, 5_411


def _with(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _digest(key: str, kind: str, turn: Column, half: Column) -> Column:
    """A keyed number of 60 bits for one half in one round."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), half.cast("string"))
    inner = F.sha2(F.concat(F.lit(key), F.sha2(text, 256)), 256)
    return F.conv(F.substring(inner, 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the pairs below (a, b): each round adds a function of one half to the other."""

    def turn(s: Column, k: Column) -> Column:
        even = k % 2 == 0
        moved_l = F.when(even, F.pmod(s["l"] + F.pmod(_digest(key, kind, k, s["r"]), a), a)).otherwise(s["l"])
        moved_r = F.when(even, s["r"]).otherwise(F.pmod(s["r"] + F.pmod(_digest(key, kind, k, s["l"]), b), b))
        return F.struct(moved_l.alias("l"), moved_r.alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _ten(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """Other digits, as many; at least two and at most 36 are expected."""

    def go(d: Column) -> Column:
        h = F.floor(F.length(d) / 2).cast("int")
        rest = F.length(d) - h
        left, right = F.substring(d, F.lit(1), h), F.substring(d, h + 1, rest)
        s = feistel(left, right, _ten(h), _ten(rest), key, kind)
        return _with(s, lambda x: F.concat(F.lpad(x["l"].cast("string"), h, "0"), F.lpad(x["r"].cast("string"), rest, "0")))

    return _with(digits, go)


def luhn_sum(digits: Column) -> Column:
    """Sum with every second digit from the right doubled; a multiple of ten for a valid number."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(F.pmod(n - i, F.lit(2)) == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda s, x: s + x)


def mod97(text: Column) -> Column:
    """Remainder of a code whose letters count 10 to 35."""

    def step(s: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.when(digit, F.pmod(s * 10 + F.expr("0") + F.coalesce(c.try_cast("int"), F.lit(0)), F.lit(97))).otherwise(
            F.pmod(s * 100 + F.ascii(c) - 55, F.lit(97))
        )

    return F.aggregate(F.split(text, ""), F.lit(0), lambda s, c: F.when(F.length(c) == 1, step(s, c)).otherwise(s))


def refilled(text: Column, digits: Column) -> Column:
    """``text`` with its digits replaced, in order, by ``digits``."""

    def at(i: Column) -> Column:
        c = F.substring(text, i, F.lit(1))
        before = F.length(F.regexp_replace(F.substring(text, F.lit(1), i), "[^0-9]", ""))
        return F.when(c.rlike("[0-9]"), F.substring(digits, before, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), at), "")


def _only(text: Column, kept: str = "0-9") -> Column:
    return F.regexp_replace(text, f"[^{kept}]", "")


def card(text: Column, key: str) -> Column:
    """A card number with another body and a right check digit; null if the number is not valid."""

    def go(d: Column) -> Column:
        body = permuted_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
        new = _with(body, lambda b: F.concat(b, F.pmod(10 - F.pmod(luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")))
        return F.when(luhn_sum(d) % 10 == 0, refilled(text, new))

    return _with(_only(text), go)


def long_number(text: Column, key: str) -> Column:
    """A number of a card's shape whose check digit is wrong: permuted as plain digits."""
    return refilled(text, permuted_digits(_only(text), key, "number"))


def phone(text: Column, key: str) -> Column:
    """The last ten digits are permuted; a country code in front stays."""

    def go(d: Column) -> Column:
        n = F.length(d) - 10
        return refilled(text, F.concat(F.substring(d, F.lit(1), n), permuted_digits(F.substring(d, n + 1, F.lit(10)), key, "phone")))

    return _with(_only(text), go)


def ip(text: Column, key: str) -> Column:
    """Four bytes, permuted as two halves of 16 bits."""

    def go(p: Column) -> Column:
        n = [p[k].cast("long") for k in range(4)]
        s = feistel(n[0] * 256 + n[1], n[2] * 256 + n[3], F.lit(65536), F.lit(65536), key, "ip")
        half = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), (x % 256).cast("string"))
        return _with(s, lambda x: F.concat_ws(".", half(x["l"]), half(x["r"])))

    return _with(F.split(text, r"\."), go)


def date(text: Column, key: str) -> Column:
    """Another day of the same 400 years; null if there is no such day."""
    first = F.to_date(F.lit("1800-01-01"))

    def go(n: Column) -> Column:
        s = feistel(F.floor(n / DATE_RIGHT), n % DATE_RIGHT, F.lit(DATE_LEFT), F.lit(DATE_RIGHT), key, "date")
        return _with(s, lambda x: F.date_format(F.date_add(first, (x["l"] * DATE_RIGHT + x["r"]).cast("int")), "yyyy-MM-dd"))

    return _with(F.date_diff(F.try_to_date(text, "yyyy-MM-dd") if hasattr(F, "try_to_date") else text.try_cast("date"), first), lambda n: F.when(n.isNotNull(), go(n)))


def iban(text: Column, key: str) -> Column:
    """Digits behind the check digits are permuted, then these are computed anew; null if not valid."""

    def go(t: Column) -> Column:
        country, body = F.substring(t, 1, 2), F.substring(t, F.lit(5), F.length(t))
        valid = mod97(F.concat(body, F.substring(t, 1, 4))) == 1
        digits = _only(body)
        new = F.when(F.length(digits) >= 2, refilled(body, permuted_digits(digits, key, "iban"))).otherwise(body)

        def checked(b: Column) -> Column:
            check = F.lpad((98 - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0")
            return _with(F.concat(country, check, b), lambda full: _spaced(text, full))

        return F.when(valid, _with(new, checked))

    return _with(_only(text, "0-9A-Z"), go)


def valid_ibans(text: Column) -> Column:
    """The IBANs of a text with right check digits, each once, the longest first.

    An IBAN may begin at each place of its shape, inside another's too. What follows it, words,
    numbers or a card, is cut off at a blank: by the country's length, else the longest part with
    right check digits counts.
    """

    def best(longest: Column) -> Column:
        words = F.split(longest, " ")
        parts = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(words, 1, k), " "))
        sized = F.filter(parts, lambda p: F.length(_only(p, "0-9A-Z")).between(15, 34) & p.rlike(f"^(?:{SHAPES['iban']})$"))
        right = F.filter(sized, lambda p: _with(_only(p, "0-9A-Z"), lambda t: mod97(F.concat(F.substring(t, F.lit(5), F.length(t)), F.substring(t, 1, 4)))) == 1)

        def own_length(p: Column) -> Column:
            n = F.lit(0)
            for size, countries in IBAN_LENGTHS.items():
                n = F.when(F.substring(p, 1, 2).isin(countries), F.lit(size)).otherwise(n)
            return F.length(_only(p, "0-9A-Z")) == n

        return _with(right, lambda r: F.coalesce(F.get(F.filter(r, own_length), 0), F.get(r, 0)))

    found = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(IBAN_HERE), F.lit(1)), best), lambda p: p.isNotNull()))
    ranked = F.array_sort(F.transform(found, lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p"))))
    return F.coalesce(ranked["p"], F.array().cast("array<string>"))


def _spaced(shape: Column, chars: Column) -> Column:
    """``chars`` with the blanks of ``shape`` put back."""

    def at(i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(shape, F.lit(1), i), " ", ""))
        return F.when(F.substring(shape, i, F.lit(1)) == " ", F.lit(" ")).otherwise(F.substring(chars, before, F.lit(1)))

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), at), "")


def email(text: Column, key: str) -> Column:
    """A keyed local part; the domain stays, in lower case."""
    low = F.lower(text)
    local = F.substring(F.sha2(F.concat(F.lit(key), F.sha2(F.concat(F.lit(key + "|email|"), low), 256)), 256), 1, 12)
    return F.concat(F.lit("u"), local, F.lit("@"), F.substring_index(low, "@", -1))


def pseudonym(value: Column, key: str) -> Column:
    """kind and new text of one match; a match that no rule validates keeps its text and has the kind ''."""
    whole = {k: f"^(?:{p})$" for k, p in SHAPES.items()}

    def named(kind: str, new: Column) -> Column:
        return _with(new, lambda n: F.struct(F.when(n.isNull(), F.lit("")).otherwise(F.lit(kind)).alias("kind"), F.coalesce(n, value).alias("text")))

    rules = {"email": email, "iban": iban, "date": date, "ip": ip, "phone": phone, "card": lambda v, k: F.coalesce(card(v, k), long_number(v, k))}
    out = F.struct(F.lit("").alias("kind"), value.alias("text"))
    for kind in reversed(list(SHAPES)):
        out = F.when(value.rlike(whole[kind]), named(kind, rules[kind](value, key))).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text: str = "text", found: str = "found") -> DataFrame:
    """All columns of ``docs``, personal data in ``text`` replaced, and ``found`` (a map of kind to count).

    A null text stays null and has an empty map; repeated rows stay. Whole texts, row by row: no
    shuffle and no Python. A column that is called ``found`` already is replaced.
    """
    from .common import fresh

    columns = [c for c in docs.columns if c != found]
    gaps, hits, ibans, shapes = (fresh(docs.columns, n) for n in ("gaps", "hits", "ibans", "shapes"))
    head, tail = ANY.split("__IBANS__")
    own = docs.select(*columns, F.inline(F.array(F.struct(valid_ibans(F.col(text)).alias(ibans)))))
    own = own.withColumn(shapes, F.when(F.size(ibans) > 0, F.concat(F.lit(head), F.array_join(ibans, "|"), F.lit(tail))).otherwise(F.lit(OTHERS)))
    marked = own.withColumns({hits: F.regexp_extract_all(F.col(text), F.col(shapes), F.lit(0))})
    new = F.transform(F.col(hits), lambda v: pseudonym(v, key))
    # the optimiser keeps a generator's input as it is, so the matches are made once
    marked = marked.select(*columns, F.inline(F.array(F.struct(F.coalesce(new, F.array()).alias(hits), F.split(F.col(text), F.col(shapes), -1).alias(gaps)))))
    pieces = F.zip_with(F.col(gaps), F.col(hits), lambda g, h: F.concat(g, F.coalesce(h["text"], F.lit(""))))
    replaced = F.when(F.size(hits) > 0, F.array_join(pieces, "")).otherwise(F.col(text)).alias(text)
    kinds = F.filter(F.col(hits)["kind"], lambda k: k != "")
    counts = F.map_from_arrays(F.array_distinct(kinds), F.transform(F.array_distinct(kinds), lambda k: F.size(F.filter(kinds, lambda x: x == k))))
    return marked.select(*[replaced if c == text else F.col(c) for c in columns], counts.alias(found))
