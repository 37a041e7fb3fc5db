"""Format-preserving pseudonyms by a keyed Feistel network; DataFrame functions only.

Personal identifiers in text (mail addresses, phone numbers, payment cards, bank accounts, social security numbers, IPv4
addresses, dates) are recognised, validated and permuted within their format by a secret key: a digit stays a digit, a letter
a letter of its script and case (Latin, Greek, Cyrillic; others stay), separators stay; cards and accounts keep right check
digits, addresses stay addresses, dates stay dates. The
permutation depends on nothing but key, kind and value, so equal values stay linked across documents, no table of
pseudonyms is needed and nothing is shuffled. With the key, `restore=True` takes it back.

The network: characters in two halves; each round shifts the characters of one half, each within its class, by
numbers from a keyed hash of the other half.

Edge cases: null and empty texts stay as they are; candidates that fail validation stay; identifiers that touch other
letters or digits are not taken; a local part of over 64 characters is no mail address; every row, repeated or with a null
id, has one in the result, which has doc_id, text and the counts, whatever other columns there are or what they are called; an empty
table gives an empty table. Not recognised: IPv6 addresses, and dates before 1900 or after 2099.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 6
#: Cards in their usual groups. A number beside one belongs to it in no case.
_GROUPED = r"(?:[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}(?:\.[0-9]{4}){3}|[0-9]{4}\.[0-9]{6}\.[0-9]{5}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5}|[0-9]{13,19})(?![0-9A-Za-z])"
#: Letters of any script and digits, for a pattern's brackets: letters beyond ASCII are what is not punctuation or a space there.
_WORD = "A-Za-z0-9\u00c0-\u1fff\u2c00-\u2fef\u3040-\ud7ff"
#: Letters that are permuted among each other, besides those of ASCII: small and capital ones of Latin, Greek and Cyrillic.
ALPHABETS = ["".join(c for c in map(chr, range(lo, hi)) if kept(c)) for lo, hi in ((0xC0, 0x250), (0x370, 0x400), (0x400, 0x530)) for kept in (str.islower, str.isupper)]
#: Kinds in the order in which a place in the text is tried.
PATTERNS = {
    "email": rf"(?<![{_WORD}._%+-])[{_WORD}_%+-][{_WORD}._%+-]{{0,63}}+@[{_WORD}](?:[{_WORD}.-]{{0,250}}[{_WORD}])?\.[A-Za-z]{{2,24}}(?![{_WORD}])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [0-9]{1,3})?|[A-Z0-9]{11,30})(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{3}(?=[ .-]))[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9A-Za-z/])0[0-9]{2,5}/[0-9]{4,10}(?![0-9/])",
    "card": rf"(?<![0-9A-Za-z])(?:{_GROUPED}|[0-9](?:(?![ -]{_GROUPED})[ -]?[0-9]){{12,18}}(?![0-9A-Za-z]))",
}
KINDS = list(PATTERNS)
#: Most kinds begin with one of few characters, which most places in a text are passed over by.
NUMBERS = f"(?:{PATTERNS['iban']})|(?=[0-9+(])(?:" + "|".join(f"(?:{p})" for k, p in PATTERNS.items() if k not in ("email", "iban")) + ")"
ANY = f"(?:{PATTERNS['email']})|{NUMBERS}"
#: Dates are permuted among 250 x 292 days from here on.
FIRST_DAY, DAY_A, DAY_B = "1900-01-01", 250, 292


def _let(value: Column, then) -> Column:
    """then(value), value being evaluated once."""
    return F.transform(F.array(value), then)[0]


def _number(text: Column, at: Column, width: int = 4) -> Column:
    """Hex digits of text from place `at` (from 0, in steps of width) as a number."""
    return F.conv(F.substr(text, at * width + 1, F.lit(width)), 16, 10).cast("int")


def _hash(key: str, kind: Column, turn: Column, other: Column) -> Column:
    """64 four-digit numbers."""
    base = F.concat_ws("|", F.lit(key), kind, turn.cast("string"), other)
    return F.concat(F.sha2(F.concat(F.lit("0"), base), 512), F.sha2(F.concat(F.lit("1"), base), 512))


def _shift(half: Column, stream: Column, sign: int) -> Column:
    """Each letter and digit of half moved within its class."""

    def one(both: Column, i: Column) -> Column:
        c = F.substr(both["half"], i + 1, F.lit(1))
        k = _number(both["stream"], F.pmod(i, F.lit(64))) * sign

        def moved(first: str, size: int) -> Column:
            low = ord(first)
            return F.char(F.lit(low) + F.pmod(F.ascii(c) - low + k, F.lit(size)))

        def within(letters: str, rest: Column) -> Column:
            place = F.position(c, F.lit(letters))
            return F.when(place > 0, F.substr(F.lit(letters), F.pmod(place - 1 + k, F.lit(len(letters))) + 1, F.lit(1))).otherwise(rest)

        other = c
        for letters in ALPHABETS:
            other = within(letters, other)
        return F.when(c.between("0", "9"), moved("0", 10)).when(c.between("a", "z"), moved("a", 26)).when(c.between("A", "Z"), moved("A", 26)).when(c > "~", other).otherwise(c)

    def shifted(both: Column) -> Column:
        letters = F.transform(F.sequence(F.lit(0), F.length(both["half"]) - 1), lambda i: one(both, i))
        return F.when(F.length(both["half"]) > 0, F.array_join(letters, "")).otherwise("")

    return _let(F.struct(half.alias("half"), stream.alias("stream")), shifted)


def _turns(restore: bool) -> Column:
    turns = list(range(ROUNDS))
    return F.array(*[F.lit(t) for t in (turns[::-1] if restore else turns)])


def permute_string(value: Column, kind: Column, key: str, restore: bool = False) -> Column:
    """A permutation of strings that keeps length and the class of every character."""
    def halves(v: Column) -> Column:
        cut = F.floor(F.length(v) / 2).cast("int")
        return F.struct(F.substr(v, F.lit(1), cut).alias("a"), F.substr(v, cut + 1, F.length(v)).alias("b"))

    start = _let(value, halves)
    sign = -1 if restore else 1

    def turn(s: Column, t: Column) -> Column:
        even = t % 2 == 0
        moved = _shift(F.when(even, s["a"]).otherwise(s["b"]), _hash(key, kind, t, F.when(even, s["b"]).otherwise(s["a"])), sign)
        return _let(moved, lambda m: F.struct(F.when(even, m).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(m).alias("b")))

    return F.aggregate(_turns(restore), start, turn, lambda s: F.concat(s["a"], s["b"]))


def permute_pair(a: Column, b: Column, sizes: tuple[int, int], kind: str, key: str, restore: bool, done) -> Column:
    """A permutation of pairs of numbers below the two sizes; done turns the pair into the result."""
    sign = -1 if restore else 1

    def turn(s: Column, t: Column) -> Column:
        even = t % 2 == 0
        k = F.conv(F.substr(_hash(key, F.lit(kind), t, F.when(even, s["b"]).otherwise(s["a"]).cast("string")), F.lit(1), F.lit(8)), 16, 10).cast("long") * sign
        return F.struct(
            F.when(even, F.pmod(s["a"] + k, F.lit(sizes[0]))).otherwise(s["a"]).cast("long").alias("a"),
            F.when(even, s["b"]).otherwise(F.pmod(s["b"] + k, F.lit(sizes[1]))).cast("long").alias("b"),
        )

    return F.aggregate(_turns(restore), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn, done)


def luhn(digits: Column) -> Column:
    """The sum of Luhn's rule over digits whose last is the check digit, mod 10."""

    def summed(text: Column) -> Column:
        n = F.length(text)

        def one(total: Column, i: Column) -> Column:
            d = F.substr(text, n - i, F.lit(1)).cast("int") * (1 + i % 2)
            return total + F.floor(d / 10).cast("int") + d % 10

        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), one) % 10

    return _let(digits, summed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refill(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, in order."""
    return _let(digits, lambda d: _filled(shape, d))


def _filled(shape: Column, digits: Column) -> Column:
    spots = F.transform(F.sequence(F.lit(1), F.length(shape)), lambda i: F.substr(shape, i, F.lit(1)))
    filled = F.aggregate(
        spots,
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.when(c.between("0", "9"), F.struct(F.concat(s["out"], F.substr(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(
            F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))
        ),
        lambda s: s["out"],
    )
    return filled


def _card(value: Column, key: str, restore: bool) -> Column:
    d = _digits(value)
    body = F.concat(F.substr(d, F.lit(1), F.lit(1)), permute_string(F.substr(d, F.lit(2), F.length(d) - 2), F.lit("card"), key, restore))
    return _refill(value, _let(body, lambda b: F.concat(b, F.pmod(10 - luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string"))))


def _ip(value: Column, key: str, restore: bool) -> Column:
    o = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    byte = lambda x, k: F.shiftright(x, 8 * k).bitwiseAND(F.lit(255)).cast("string")
    return permute_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], (65536, 65536), "ip", key, restore, lambda s: F.concat_ws(".", byte(s["a"], 1), byte(s["a"], 0), byte(s["b"], 1), byte(s["b"], 0)))


def _written_day(value: Column, year: int, month: int, day: int) -> Column:
    """Days since FIRST_DAY of a date whose parts begin at those places; null if there is no such date."""
    iso = F.concat_ws("-", F.substr(value, F.lit(year), F.lit(4)), F.substr(value, F.lit(month), F.lit(2)), F.substr(value, F.lit(day), F.lit(2)))
    return F.datediff(iso.try_cast("date"), F.lit(FIRST_DAY).cast("date"))


def _year_first(value: Column) -> Column:
    return F.substr(value, F.lit(5), F.lit(1)).isin("-", "/")


def _day(value: Column) -> Column:
    """Where the year comes last, the month comes first only if there is no such date with the day first."""
    return F.when(_year_first(value), _written_day(value, 1, 6, 9)).otherwise(F.coalesce(_written_day(value, 7, 4, 1), _written_day(value, 7, 1, 4)))


def _date(value: Column, key: str, restore: bool) -> Column:
    def moved(day: Column) -> Column:
        return permute_pair(F.floor(day / DAY_B), day % DAY_B, (DAY_A, DAY_B), "date", key, restore, lambda s: (s["a"] * DAY_B + s["b"]).cast("int"))

    def date(day: Column) -> Column:
        return F.date_add(F.lit(FIRST_DAY).cast("date"), day)

    def shown(day: Column, first: int, second: int) -> Column:
        iso, sep = date(day).cast("string"), F.substr(value, F.lit(3), F.lit(1))
        return F.concat_ws("", F.substr(iso, F.lit(first), F.lit(2)), sep, F.substr(iso, F.lit(second), F.lit(2)), sep, F.substr(iso, F.lit(1), F.lit(4)))

    # with the month first, only days after the 12th are told: the permutation's cycle is walked to the next such date (one
    # step in 0.6 of all cases; that 64 are not enough has a chance of 1e-25, and then the last date reached is shown)
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(64)),
        F.struct(_day(value).alias("day"), F.lit(False).alias("over")),
        lambda s, _: F.when(s["over"], s).otherwise(_let(moved(s["day"]), lambda d: F.struct(d.alias("day"), (F.dayofmonth(date(d)) > 12).alias("over")))),
        lambda s: s["day"],
    )
    return (
        F.when(_year_first(value), _let(moved(_day(value)), lambda d: F.replace(date(d).cast("string"), F.lit("-"), F.substr(value, F.lit(5), F.lit(1)))))
        .when(_written_day(value, 7, 4, 1).isNotNull(), _let(moved(_day(value)), lambda d: shown(d, 9, 6)))
        .otherwise(_let(walked, lambda d: shown(d, 6, 9)))
    )


def _ssn_fits(d: Column) -> Column:
    return ~(d.startswith("000") | d.startswith("666") | d.startswith("9") | (F.substr(d, F.lit(4), F.lit(2)) == "00") | (F.substr(d, F.lit(6), F.lit(4)) == "0000"))


def _ssn(value: Column, key: str, restore: bool) -> Column:
    """Valid numbers are counted off: 898 areas (001 to 899 without 666), and 99 groups of 9,999 serial numbers."""

    def indexed(d: Column) -> Column:
        area, group, serial = (F.substr(d, F.lit(at), F.lit(n)).cast("long") for at, n in ((1, 3), (4, 2), (6, 4)))
        return F.struct((area - F.when(area > 666, 2).otherwise(1)).alias("a"), ((group - 1) * 9999 + serial - 1).alias("b"))

    def shown(s: Column) -> Column:
        area, group, serial = s["a"] + F.when(s["a"] > 664, 2).otherwise(1), F.floor(s["b"] / 9999) + 1, s["b"] % 9999 + 1
        return F.concat(*[F.lpad(x.cast("string"), n, "0") for x, n in ((area, 3), (group, 2), (serial, 4))])

    moved = _let(indexed(_digits(value)), lambda x: permute_pair(x["a"], x["b"], (898, 99 * 9999), "ssn", key, restore, shown))
    return _refill(value, moved)


def _phone(value: Column, key: str, restore: bool) -> Column:
    code = F.regexp_extract(value, r"^(?:\+[0-9]{1,3}(?=[ .(-])|0(?=[0-9]+/))", 0)
    return F.concat(code, permute_string(F.substr(value, F.length(code) + 1, F.length(value)), F.lit("phone"), key, restore))


def _email(value: Column, key: str, restore: bool) -> Column:
    """The local part and the domain's labels but the last are permuted, so people of one domain stay together."""
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    top = F.substring_index(domain, ".", -1)
    rest = F.substr(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    return F.concat(permute_string(local, F.lit("local"), key, restore), F.lit("@"), permute_string(rest, F.lit("domain"), key, restore), F.lit("."), top)


def mod97(text: Column) -> Column:
    """The remainder by 97 of digits and capitals, a letter counting as its number from 10 on."""

    def one(r: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (r * 10 + c.cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)

    return _let(text, lambda t: F.aggregate(F.sequence(F.lit(1), F.length(t)), F.lit(0), lambda r, i: one(r, F.substr(t, i, F.lit(1)))))


def _iban(value: Column, key: str, restore: bool) -> Column:
    """The account within its country, with its check digits; in groups of four if it was."""
    bare = F.replace(value, F.lit(" "), F.lit(""))
    country = F.substr(bare, F.lit(1), F.lit(2))
    body = permute_string(F.substr(bare, F.lit(5), F.length(bare)), F.lit("iban"), key, restore)
    made = _let(body, lambda b: F.concat(country, F.lpad((98 - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
    return F.when(value.contains(" "), F.regexp_replace(made, "(.{4})(?=.)", "$1 ")).otherwise(made)


_MAKE = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def kind_of(value: Column) -> Column:
    """The kind of a match, or null if it fails validation."""
    parts, bare = F.split(value, r"\."), F.replace(value, F.lit(" "), F.lit(""))
    valid = {
        "iban": F.length(bare).between(15, 34) & (mod97(F.concat(F.substr(bare, F.lit(5), F.length(bare)), F.substr(bare, F.lit(1), F.lit(4)))) == 1),
        "email": ~value.contains("..") & ~value.contains(".@"),
        "ip": ~F.exists(parts, lambda x: (F.length(x) > 3) | (x.try_cast("int") > 255)),
        "date": F.coalesce(_day(value).between(0, DAY_A * DAY_B - 1), F.lit(False)),
        "ssn": _ssn_fits(_digits(value)),
        "phone": F.length(_digits(value)).between(7, 15),
        "card": F.length(_digits(value)).between(13, 19) & (luhn(_digits(value)) == 0),
    }
    out = F.lit(None).cast("string")
    for k in reversed(KINDS):
        out = F.when(value.rlike(f"^(?:{PATTERNS[k]})$"), F.when(valid[k], k)).otherwise(out)
    return out


def _replaced(match: Column, key: str, restore: bool) -> Column:
    """struct(kind, value) of a match."""
    typed = F.struct(kind_of(match).alias("kind"), match.alias("raw"))

    def made(s: Column) -> Column:
        value = s["raw"]
        for k in KINDS:
            value = F.when(s["kind"] == k, _MAKE[k](s["raw"], key, restore)).otherwise(value)
        return F.struct(s["kind"].alias("kind"), value.alias("value"))

    return F.transform(F.array(typed), made)[0]


def pseudonymize(docs: DataFrame, key: str, restore: bool = False) -> DataFrame:
    """doc_id, text with every identifier permuted, and n_<kind> of each kind, for every row of docs (doc_id, text).

    Texts are cut at the matches, the matches permuted, and all put together again, row by row. Whoever has the key can
    take the pseudonyms back, so it comes from the caller's secrets and never from the source.
    """
    if not key:
        raise ValueError("a secret key is needed")
    text = F.col("text")
    mails, touched = text.contains("@"), text.rlike("[0-9@]")
    parts = F.when(touched, F.when(mails, F.split(text, ANY, -1)).otherwise(F.split(text, NUMBERS, -1)))
    matches = F.when(touched, F.when(mails, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(NUMBERS), F.lit(0))))
    found = F.transform(matches, lambda m: _replaced(m, key, restore))
    cut = docs.select("doc_id", "text", parts.alias("_parts"), found.alias("_found"))
    # a part and the match after it, in turn; the last part has none
    joined = F.array_join(F.transform("_parts", lambda p, i: F.concat(p, F.coalesce(F.get(F.col("_found"), i)["value"], F.lit("")))), "")

    def counted(kind: str) -> Column:
        return F.coalesce(F.greatest(F.size(F.filter("_found", lambda f: f["kind"] == kind)), F.lit(0)), F.lit(0)).alias(f"n_{kind}")

    return cut.select("doc_id", F.when(F.col("_parts").isNotNull(), joined).otherwise(F.col("text")).alias("text"), *map(counted, KINDS))
