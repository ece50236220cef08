"""Personal data: format-preserving pseudonyms by keyed Feistel permutations.

Found values are validated (payment cards and bank accounts by their check
digits, network addresses and dates by their ranges, social security numbers
by their areas, telephone numbers by their lengths) and permuted within their
format: a Feistel network adds a keyed hash of one half to the other, modulo
the size of its domain, for ``ROUNDS`` rounds. That is a bijection on each
format, so equal values stay linked across documents and different ones stay
different; separators, lengths and check digits hold. DataFrame functions
only. What fails validation, and all other text, stays as it is.

Kinds: e-mail addresses (the local part, each letter and digit within its run
of the alphabet), IPv4 and IPv6 addresses, international bank account numbers,
payment cards (also among up to 200 other groups of digits), telephone numbers
(North American forms, forms with a plus sign, French pairs; country codes
stay, and valid area and exchange codes stay valid), social security numbers,
dates from 1900 to 2099 as year-month-day, day/month/year or day.month.year.
An IPv6 address is linked in each spelling of its own.

The key comes from the session's ``spark.tessera.pseudonyms.secret`` unless it
is given; without either, a demonstration key is used and a warning says so.

Cases: a null text stays null with zero replacements, an empty one stays empty. Texts of
any length are treated whole; patterns are bounded, so time is linear. Repeated
rows get equal results. Columns keep their names and order, whatever their
names; ``n_pii`` is appended and replaces a column of that name. An empty table
stays empty.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import unused

ROUNDS = 8
KEY = "tessera-demo-key"
SECRET = "spark.tessera.pseudonyms.secret"

#: Pattern of each kind, in order of precedence.
_HEX = "[0-9A-Fa-f]{1,4}"
#: What stands before the last groups of a card, which are then no date or telephone number.
_CARD = r"|\d{4}-|\d{4}  ?\d{4}  ?|\d{4}\.\d{4}\.|\d{6}[ .-]"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){0,8}\.\p{L}{2,24}(?!\p{L})",
    "ip6": rf"(?<![\p{{L}}\p{{N}}:.])(?={_HEX}:)(?:(?:{_HEX}:){{7}}{_HEX}|{_HEX}(?::{_HEX}){{0,5}}::{_HEX}(?::{_HEX}){{0,5}})(?![\p{{L}}\p{{N}}:])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "date": rf"(?<![\d.]{_CARD})(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{2}}/\d{{2}}/\d{{4}}|\d{{2}}\.\d{{2}}\.\d{{4}})(?![\d/])",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)",
    "phone": r"(?<![\p{L}\d]" + _CARD + r")(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[ .-]\d{4}(?!\d)",
    "spaced": r"(?<![\p{L}\d]|\d )[2-9]\d{2} \d{3} \d{4}(?! ?\d)",
    "abroad": r"(?<![\p{L}\d+])(?:\+1[ .-]?\(?[2-9]\d{2}\)?[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,6})(?!\d)",
    "pairs": r"(?<![\p{L}\d]|\d[ .-])0[1-9](?:[ .-]\d{2}){4}(?![ .-]?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
}
#: What may hold payment cards: digit groups apart by a point, a dash or up to two blanks, at least 13 digits in all. Searched in what the other kinds leave.
GROUPS = r"(?<!\d)(?=(?:\d(?: {1,2}|[.-])?){12}\d)\d++(?:(?: {1,2}|[.-])\d++){0,200}+"
#: First digits and lengths that card issuers use.
ISSUED = "^(?:4(?:.{12}|.{15}|.{18})|(?:5[1-5]|2[2-7]|35|36|38|39|30).{12,14}|3[47].{13}|6.{15,18})$"
#: Between the characters of a string.
CHARS = r"(?!^|\z)"
LETTERED = ("email", "ip6", "iban")
#: Kinds that begin with a letter, then the others, tried only where a digit, a plus sign or a bracket stands.
ANY = "(?:" + "|".join(PATTERNS[k] for k in LETTERED) + "|(?=[0-9+(])(?:" + "|".join(v for k, v in PATTERNS.items() if k not in LETTERED) + "))"
MARK = "\x01"

#: Runs of letters beyond ASCII, by first code point and length: Latin, Greek, Cyrillic, Hebrew, Arabic, Devanagari, kana, CJK, Hangul.
RUNS = (
    (0xC0, 23), (0xD8, 7), (0xE0, 23), (0xF8, 8), (0x100, 128), (0x391, 17), (0x3A3, 7), (0x3B1, 25), (0x400, 16), (0x410, 32), (0x430, 32), (0x450, 16),
    (0x5D0, 27), (0x621, 26), (0x641, 10), (0x905, 53), (0x3041, 86), (0x30A1, 90), (0x4E00, 20992), (0xAC00, 11172),
)


def _let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once."""
    return F.transform(F.array(value), then)[0]


def _keyed(key: str, tweak: str, i: Column, half: Column) -> Column:
    """60 keyed bits for round i of the other half."""
    text = F.concat(F.lit(f"{key}|{tweak}|"), i.cast("string"), F.lit("|"), half.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, n_left: Column, n_right: Column, key: str, tweak: str) -> Column:
    """Permute pairs of longs below (n_left, n_right); a struct (l, r)."""
    def turn(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(
            F.when(odd, F.pmod(s["l"] + _keyed(key, tweak, i, s["r"]), n_left)).otherwise(s["l"]).alias("l"),
            F.when(odd, s["r"]).otherwise(F.pmod(s["r"] + _keyed(key, tweak, i, s["l"]), n_right)).alias("r"),
        )

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _tens(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permute_digits(d: Column, key: str, tweak: str) -> Column:
    """Permute digit strings of each length of 2 to 36."""
    a = F.floor(F.length(d) / 2).cast("int")
    b = F.length(d) - a
    got = feistel(F.substring(d, F.lit(1), a), F.substring(d, a + 1, b), _tens(a), _tens(b), key, tweak)
    return F.transform(F.array(got), lambda g: F.concat(F.lpad(g["l"].cast("string"), a, "0"), F.lpad(g["r"].cast("string"), b, "0")))[0]


def luhn_sum(d: Column) -> Column:
    """Sum of the digits, every second from the right doubled and cast out nines."""
    def part(i: Column) -> Column:
        x = F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(d)), part), F.lit(0), lambda s, x: s + x)


def _refill(m: Column, d: Column) -> Column:
    """The form of m with its digits replaced by those of d in order."""
    def at(c: Column, i: Column) -> Column:
        return F.when(c.rlike("[0-9]"), F.substring(d, F.length(_digits(F.substring(m, F.lit(1), i + 1))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(m, CHARS), at), "")


def _respell(m: Column, chars: Column) -> Column:
    """The form of m with all but its blanks replaced by ``chars`` in order."""
    def at(c: Column, i: Column) -> Column:
        return F.when(c == " ", c).otherwise(F.substring(chars, F.length(F.regexp_replace(F.substring(m, F.lit(1), i + 1), " ", "")), F.lit(1)))

    return F.array_join(F.transform(F.split(m, CHARS), at), "")


def _card(m: Column, key: str) -> Column:
    """Replace all cards in a run of digit groups: spans of whole groups, 13 to 19 digits, whose check digit holds.

    In a run of more digits than a card has, a span of several groups must have
    an issuer's first digits, four digits first and three to six in each group;
    so rows of numbers stay.
    Of those that overlap the one with an issuer's first digits and length
    counts, then one of 16 digits, then 15, then the longest, then the first.
    """
    d = _digits(m)
    ends = F.aggregate(F.regexp_extract_all(m, F.lit("([0-9]+)"), F.lit(1)), F.array(F.lit(0)), lambda a, g: F.concat(a, F.array(F.element_at(a, -1) + F.length(g))))
    apart = lambda ends: F.zip_with(F.slice(ends, F.lit(2), F.size(ends) - 1), F.slice(ends, F.lit(1), F.size(ends) - 1), lambda b, a: b - a)

    grouped = lambda own, sizes: own.rlike(ISSUED) & (sizes[0] == 4) & (F.array_min(sizes) >= 3) & (F.array_max(sizes) <= 6)

    def best(s: Column, i: Column, ends: Column) -> Column:
        """The best card that starts at a group."""
        def span(e: Column) -> Column:
            own = F.substring(d, s + 1, e - s)
            return F.struct(F.struct(own.rlike(ISSUED).alias("issued"), (e - s == 16).alias("usual"), (e - s == 15).alias("short"), (e - s).alias("n")).alias("rank"), (-s).alias("first"), s.alias("s"))

        near = F.filter(F.slice(ends, i + 2, 19), lambda e, k: (e - s).between(13, 19) & ((k == 0) | (F.length(d) <= 19) | grouped(F.substring(d, s + 1, e - s), apart(F.slice(ends, i + 1, k + 2)))) & (luhn_sum(F.substring(d, s + 1, e - s)) % 10 == 0))
        return F.array_max(F.transform(near, span))

    def chosen(found: Column) -> Column:
        """The best first, then what does not overlap those taken; in their order in the text."""
        apart_ = lambda x, y: (x["s"] >= y["s"] + y["rank"]["n"]) | (y["s"] >= x["s"] + x["rank"]["n"])
        take = lambda held, x: F.when(F.forall(held, lambda y: apart_(x, y)), F.concat(held, F.array(x))).otherwise(held)
        held = F.aggregate(F.sort_array(found, asc=False), F.filter(found, lambda x: F.lit(False)), take)
        return F.array_sort(F.transform(held, lambda x: F.struct(x["s"].alias("s"), x["rank"].alias("rank"))))

    def fresh(cards: Column) -> Column:
        check = lambda b: F.concat(b, F.pmod(10 - luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string"))
        own = lambda x: _let(permute_digits(F.substring(d, x["s"] + 1, x["rank"]["n"] - 1), key, "card"), check)
        start = F.struct(F.lit("").alias("said"), F.lit(0).alias("at"))
        step = lambda z, x: F.struct(F.concat(z["said"], F.substring(d, z["at"] + 1, x["s"] - z["at"]), own(x)).alias("said"), (x["s"] + x["rank"]["n"]).alias("at"))
        return F.aggregate(cards, start, step, lambda z: F.concat(z["said"], F.substring(d, z["at"] + 1, F.length(d))))

    def of(ends: Column) -> Column:
        return F.filter(F.transform(F.slice(ends, F.lit(1), F.size(ends) - 1), lambda s, i: best(s, i, ends)), lambda x: x.isNotNull())

    return _let(_let(_let(ends, of), chosen), lambda cards: F.when(F.size(cards) == 0, m).otherwise(_let(fresh(cards), lambda f: _refill(m, f))))


def _ten(d: Column, key: str) -> Column:
    """Ten digits of area, exchange and line; codes from 200 on move among those, lower ones among theirs."""
    area, rest = F.substring(d, 1, 3).cast("long"), F.substring(d, 4, 7).cast("long")
    valid = lambda x, of, yes, no: F.when(x >= of, F.lit(yes)).otherwise(F.lit(no))
    a0, r0 = valid(area, 200, 200, 0), valid(rest, 2_000_000, 2_000_000, 0)
    got = feistel(area - a0, rest - r0, valid(area, 200, 800, 200), valid(rest, 2_000_000, 8_000_000, 2_000_000), key, "phone")
    return _let(got, lambda g: F.concat(F.lpad((g["l"] + a0).cast("string"), 3, "0"), F.lpad((g["r"] + r0).cast("string"), 7, "0")))


def _phone(m: Column, key: str) -> Column:
    def fresh(d: Column) -> Column:
        head = F.length(d) - 10
        return F.concat(F.substring(d, F.lit(1), head), _ten(F.substring(d, head + 1, F.lit(10)), key))

    return _let(_let(_digits(m), fresh), lambda x: _refill(m, x))


def _abroad(m: Column, key: str) -> Column:
    """A number with a plus sign: country code and first digit stay. 8 to 15 digits."""
    def fresh(d: Column) -> Column:
        told = F.length(F.regexp_extract(m, r"^\+(\d{1,3})[ .(-]", 1))
        code = F.when(told > 0, told).when(d.rlike("^[17]"), 1).otherwise(2)

        def of(code: Column) -> Column:
            own = F.substring(d, code + 2, F.length(d))
            tail = F.concat(F.substring(d, code + 1, F.lit(1)), permute_digits(own, key, "abroad"))
            ten = (F.substring(d, F.lit(1), code) == "1") & (F.length(d) - code == 10)
            return F.concat(F.substring(d, F.lit(1), code), F.when(ten, _ten(F.substring(d, code + 1, F.lit(10)), key)).otherwise(tail))

        return _let(code, of)

    return _let(_digits(m), lambda d: F.when(F.length(d).between(8, 15), _let(fresh(d), lambda x: _refill(m, x))).otherwise(_card(m, key)))


def _pairs(m: Column, key: str) -> Column:
    d = _digits(m)
    return _let(F.concat(F.substring(d, 1, 2), permute_digits(F.substring(d, 3, 8), key, "pairs")), lambda x: _refill(m, x))


def _mod97(s: Column) -> Column:
    """Remainder by 97 of a bank account number, letters read as 10 to 35."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(s, CHARS), F.lit(0), step)


def _iban(m: Column, key: str) -> Column:
    """Country stays, the account moves by character, check digits follow. Words in capitals after the number stay:
    of the runs of groups from the first the longest valid one counts."""
    parts = F.split(m, " ")
    bare = lambda x: F.regexp_replace(x, " ", "")
    runs = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), " "))
    valid = lambda x: (F.length(bare(x)) >= 12) & (_mod97(F.concat(F.substring(bare(x), F.lit(5), F.length(x)), F.substring(bare(x), 1, 4))) == 1)

    def fresh(x: Column) -> Column:
        s = bare(x)
        land = F.substring(s, 1, 2)

        def said(own: Column) -> Column:
            check = 98 - _mod97(F.concat(own, land, F.lit("00")))
            return F.concat(_respell(x, F.concat(land, F.lpad(check.cast("string"), 2, "0"), own)), F.substring(m, F.length(x) + 1, F.length(m)))

        return _let(permute_letters(F.substring(s, F.lit(5), F.length(s)), key, "iban"), said)

    return _let(F.get(F.reverse(F.filter(runs, valid)), F.lit(0)), lambda x: F.when(x.isNull(), _card(m, key)).otherwise(fresh(x)))


def _ip6(m: Column, key: str) -> Column:
    """Each group keeps its length; hexadecimal digits move among themselves. Eight groups, or three to seven and a gap."""
    groups = F.size(F.regexp_extract_all(m, F.lit("([0-9A-Fa-f]+)"), F.lit(1)))
    return F.when((groups == 8) | (m.contains("::") & groups.between(3, 7)), permute_letters(m, key, "ip6")).otherwise(m)


def _ip(m: Column, key: str) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    got = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ip")
    said = lambda g: F.concat_ws(".", F.shiftright(g["l"], 8), g["l"] % 256, F.shiftright(g["r"], 8), g["r"] % 256)
    return F.when(F.forall(o, lambda x: x <= 255), F.transform(F.array(got), said)[0]).otherwise(m)


def _ssn(m: Column, key: str) -> Column:
    p = F.transform(F.split(m, "-"), lambda x: x.cast("int"))
    area = p[0] - F.when(p[0] > 666, 2).otherwise(1)  # 898 areas: 001 to 899 without 666
    got = feistel(area * 99 + (p[1] - 1), p[2] - 1, F.lit(898 * 99), F.lit(9999), key, "ssn")

    def said(g: Column) -> Column:
        a = F.floor(g["l"] / 99)
        a = a + F.when(a >= 665, 2).otherwise(1)
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((g["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((g["r"] + 1).cast("string"), 4, "0"))

    valid = (p[0] > 0) & (p[0] < 900) & (p[0] != 666) & (p[1] > 0) & (p[2] > 0)
    return F.when(valid, F.transform(F.array(got), said)[0]).otherwise(m)


def _date(m: Column, key: str) -> Column:
    """Days from 1900-01-01 to 2099-12-31 number 73,049 = 229 x 319, the domains of the halves."""
    def form(pattern: str) -> Column:
        day = F.try_to_timestamp(m, F.lit(pattern)).cast("date")
        n = F.datediff(day, F.lit("1900-01-01").cast("date"))
        got = feistel(F.floor(n / 319), n % 319, F.lit(229), F.lit(319), key, "date")
        said = lambda g: F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), (g["l"] * 319 + g["r"]).cast("int")), pattern)
        return F.when(n.between(0, 73048), F.transform(F.array(got), said)[0]).otherwise(m)

    return F.when(m.rlike("^....-"), form("yyyy-MM-dd")).when(m.contains("/"), form("dd/MM/yyyy")).otherwise(form("dd.MM.yyyy"))


def _turned(c: Column, by: Column, tweak: str) -> Column:
    """A character moved by ``by`` places within its run; others stay."""
    x = F.ascii(c)
    turn = lambda low, n: F.char(F.pmod(x - low + by, F.lit(n)) + low)
    if tweak == "ip6":
        sixteen = F.pmod(F.instr(F.lit("0123456789abcdef"), F.lower(c)) - 1 + by, F.lit(16))
        own = F.substring(F.lit("0123456789abcdef"), sixteen + 1, F.lit(1))
        return F.when(c == ":", c).when(c.rlike("[A-F]"), F.upper(own)).otherwise(own)
    ascii_ = F.when(x.between(97, 122), turn(97, 26)).when(x.between(65, 90), turn(65, 26)).when(x.between(48, 57), turn(48, 10))
    runs = F.array(*[F.struct(F.lit(a).alias("low"), F.lit(n).alias("n")) for a, n in RUNS])
    run = F.filter(runs, lambda r: (x >= r["low"]) & (x < r["low"] + r["n"]))
    said = lambda r: F.decode(F.unhex(F.lpad(F.hex(F.pmod(x - r["low"] + by, r["n"]) + r["low"]), 4, "0")), "UTF-16BE")
    return ascii_.when(x > 127, _let(F.get(run, F.lit(0)), lambda r: F.when(r.isNull(), c).otherwise(said(r)))).otherwise(c)


def permute_letters(s: Column, key: str, tweak: str) -> Column:
    """Permute strings of one form: each character moves within its run, keyed by the other half."""
    def shift(mine: Column, other: Column, i: Column) -> Column:
        stream = F.sha2(F.concat(F.lit(f"{key}|{tweak}|"), i.cast("string"), F.lit("|"), F.length(mine).cast("string"), F.lit("|"), other), 256)

        def all_of(stream: Column) -> Column:
            by = lambda k: F.conv(F.substring(stream, (k % 21) * 3 + 1, F.lit(3)), 16, 10).cast("int")
            return F.array_join(F.transform(F.split(mine, CHARS), lambda c, k: _turned(c, by(k), tweak)), "")

        return F.when(F.length(mine) == 0, mine).otherwise(_let(stream, all_of))

    def turn(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(F.when(odd, shift(s["l"], s["r"], i)).otherwise(s["l"]).alias("l"), F.when(odd, s["r"]).otherwise(shift(s["r"], s["l"], i)).alias("r"))

    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substring(s, F.lit(1), half).alias("l"), F.substring(s, half + 1, F.length(s)).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda g: F.concat(g["l"], g["r"]))


def _email(m: Column, key: str) -> Column:
    """The local part moves, the domain stays."""
    local = F.substring_index(m, "@", 1)
    return F.concat(permute_letters(local, key, "email"), F.substring(m, F.length(local) + 1, F.length(m)))


def pseudonym(m: Column, key: str = KEY) -> Column:
    """The pseudonym of one found value; the value itself if it is not valid."""
    whole = lambda kind: m.rlike("^(?:" + PATTERNS[kind] + ")$")
    out = F.when(m.contains("@"), _email(m, key))
    for kind, fresh in (("ip6", _ip6), ("iban", _iban), ("date", _date), ("ip", _ip), ("phone", _phone), ("spaced", _phone), ("abroad", _abroad), ("pairs", _pairs), ("ssn", _ssn)):
        out = out.when(whole(kind), fresh(m, key))
    return out.otherwise(_card(m, key))


def pseudonymise(docs: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in ``text`` and their number in ``n_pii``."""
    key = key or docs.sparkSession.conf.get(SECRET, None)
    if not key:
        warnings.warn(f"no key given and {SECRET} not set: pseudonyms are of the demonstration key", stacklevel=2)
        key = KEY
    t = F.col(text)
    docs = docs.drop("n_pii")
    old, new = unused(docs, "pieces", "fresh")
    # gaps and found values in turn; texts that hold the mark themselves are searched twice
    def parted(x: Column, pattern: str) -> Column:
        marked = F.split(F.regexp_replace(x, f"({pattern})", f"{MARK}$1{MARK}"), MARK, -1)
        twice = F.flatten(F.zip_with(F.split(x, pattern, -1), F.regexp_extract_all(x, F.lit(f"({pattern})"), F.lit(1)), lambda g, m: F.array(g, F.coalesce(m, F.lit("")))))
        return F.when(x.contains(MARK), F.slice(twice, F.lit(1), F.size(twice) - 1)).otherwise(marked)

    def with_cards(pieces: Column) -> Column:
        # a gap becomes gaps and digit runs in turn, so that values and runs stay at odd places
        runs = lambda g: F.when(g.rlike(GROUPS), parted(g, GROUPS)).otherwise(F.array(g))
        return F.flatten(F.transform(pieces, lambda g, i: F.when(i % 2 == 0, runs(g)).otherwise(F.array(g))))

    pieces = F.when(t.rlike("[0-9@]|::"), _let(parted(t, ANY), with_cards))
    rows = docs.withColumn(old, pieces)
    rows = rows.withColumn(new, F.transform(old, lambda m, i: F.when((i % 2 == 1) & (m != ""), pseudonym(m, key)).otherwise(m)))
    changed = F.coalesce(F.size(F.filter(F.zip_with(old, new, lambda a, b: a != b), lambda x: x)).cast("long"), F.lit(0).cast("long"))
    return rows.select(
        *(F.when(F.size(old) > 1, F.array_join(F.col(new), "")).otherwise(t).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns),
        F.greatest(changed, F.lit(0).cast("long")).alias("n_pii"),
    )
