"""Format-preserving pseudonyms for personal data by a keyed Feistel network. DataFrame functions only.

A value is a list of digits with a radix each; the network permutes the lists of one format, so a pseudonym has its
value's format, equal values get equal pseudonyms in all documents, and the key's holder can invert it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import packed

ROUNDS = 8
#: First day of the range within which dates are permuted, and its number of days, 319 * 229.
DAY_0, DAYS = "1900-01-01", (319, 229)

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Whole tokens only: no letter, digit or joining mark on either side.
EDGE, END = r"(?<![\p{L}0-9])(?<![0-9][.-])", r"(?![\p{L}0-9])(?![.-][0-9])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": EDGE + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + END,
    "ip": EDGE + rf"{OCTET}(?:\.{OCTET}){{3}}" + END,
    "date": EDGE + r"(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])" + END,
    "ssn": EDGE + r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}" + END,
    "phone": r"(?<![\p{L}0-9])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}" + END,
    "card": EDGE + r"[0-9](?:[ -]?[0-9]){12,18}" + END,
}


def _digit(hexes: Column, i: Column) -> Column:
    """16 bits of the round's hash for place i (64 hex digits hold 16 places; more places take further hashes)."""
    return F.conv(F.substr(hexes, i * 4 + 1, F.lit(4)), 16, 10).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def feistel(values: Column, radices: Column, key: str, tweak: Column, rounds: int = ROUNDS) -> Column:
    """array<bigint> of the same length, values[i] staying below radices[i]. Halves shift each other, place by place,
    by a keyed hash modulo the radix: a bijection for any radices. Up to 64 values."""

    def shifted(side: Column, other: Column, sizes: Column, step: Column, tweak: Column) -> Column:
        hexes = F.sha2(F.concat_ws("|", F.lit(key), tweak, step.cast("string"), F.concat_ws(",", other.cast("array<string>"))), 256)
        whole = F.when(F.size(side) > 16, F.concat(hexes, F.sha2(F.concat(F.lit(f"{key}+"), hexes), 256))).otherwise(hexes)
        return let(whole, lambda h: F.transform(side, lambda x, i: (x + _digit(h, i)) % F.get(sizes, i)))

    def run(x: Column) -> Column:
        def turn(state: Column, step: Column) -> Column:
            left = F.when(step % 2 == 0, shifted(state.l, state.r, x.rl, step, x.t)).otherwise(state.l)
            right = F.when(step % 2 == 1, shifted(state.r, state.l, x.rr, step, x.t)).otherwise(state.r)
            return F.struct(left.alias("l"), right.alias("r"))

        end = F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), F.struct(x.l.alias("l"), x.r.alias("r")), turn)
        return let(end, lambda e: F.concat(e.l, e.r))

    def halves(x: Column) -> Column:
        n, half = F.size(x.v), F.ceil(F.size(x.v) / 2).cast("int")
        return F.struct(F.slice(x.v, 1, half).alias("l"), F.slice(x.v, half + 1, n).alias("r"), F.slice(x.m, 1, half).alias("rl"), F.slice(x.m, half + 1, n).alias("rr"), x.t.alias("t"))

    return let(F.struct(values.alias("v"), radices.alias("m"), tweak.alias("t")), lambda x: let(halves(x), run))


def _chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def _refill(chars: Column, places: Column, values: Column) -> Column:
    """chars with those at the given indices (ascending) replaced by values, in order."""
    put = lambda z: F.array_join(F.transform(z.c, lambda c, i: F.coalesce(F.get(z.v, (F.array_position(z.p, i) - 1).cast("int")), c)), "")
    return let(F.struct(chars.alias("c"), places.alias("p"), values.alias("v")), put)


def _ords(chars: Column, places: Column) -> Column:
    return F.transform(places, lambda i: F.ascii(F.get(chars, i)).cast("long"))


def _places(chars: Column, pattern: str) -> Column:
    return F.filter(F.transform(chars, lambda c, i: F.when(c.rlike(pattern), i).otherwise(F.lit(-1))), lambda i: i >= 0)


def _swap(x: Column, key: str, kind: str) -> Column:
    """x with its letters and digits permuted within a-z, A-Z and 0-9."""

    def by_place(z: Column) -> Column:
        floor = lambda o: F.when(o >= 97, 97).when(o >= 65, 65).otherwise(48)
        radices = F.transform(z.o, lambda o: F.when(o >= 65, 26).otherwise(10).cast("long"))
        new = feistel(F.transform(z.o, lambda o: o - floor(o)), radices, key, F.concat(F.lit(kind), z.s))
        return _refill(z.c, z.p, F.zip_with(z.o, new, lambda o, v: F.char(floor(o) + v)))

    shape = F.regexp_replace(F.regexp_replace(x, "[0-9]", "9"), "[A-Za-z]", "a")
    placed = lambda z: F.struct(z.c.alias("c"), z.p.alias("p"), z.s.alias("s"), _ords(z.c, z.p).alias("o"))
    return let(F.struct(_chars(x).alias("c"), _places(_chars(x), "[A-Za-z0-9]").alias("p"), shape.alias("s")), lambda z: let(placed(z), by_place))


def _digits(x: Column) -> Column:
    return F.transform(_chars(F.regexp_replace(x, "[^0-9]", "")), lambda c: c.cast("long"))


def luhn_sum(digits: Column) -> Column:
    """Luhn's sum, the last place counting once."""
    n = F.size(digits)
    doubled = F.transform(digits, lambda d, i: F.when((n - i) % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(doubled, F.lit(0).cast("long"), lambda a, d: a + d)


def _mod97(x: Column) -> Column:
    """An IBAN's remainder, of its text without blanks."""
    moved = F.concat(F.substring(x, 5, 40), F.substring(x, 1, 4))
    step = lambda a, o: F.when(o >= 65, (a * 100 + o - 55) % 97).otherwise((a * 10 + o - 48) % 97)
    return F.aggregate(F.transform(_chars(moved), lambda c: F.ascii(c).cast("long")), F.lit(0).cast("long"), step)


def _ten(digits: Column) -> Column:
    return F.transform(digits, lambda d: F.lit(10).cast("long"))


def _card(x: Column, key: str) -> Column:
    def checked(body: Column) -> Column:
        # The check digit makes the sum a multiple of 10.
        check = F.pmod(-luhn_sum(F.concat(body, F.array(F.lit(0).cast("long")))), F.lit(10).cast("long"))
        return F.concat(body, F.array(check)).cast("array<string>")

    def new(d: Column) -> Column:
        n = F.size(d)
        body = feistel(F.slice(d, 1, n - 1), _ten(F.slice(d, 1, n - 1)), key, F.concat(F.lit("card"), n.cast("string")))
        return F.when(luhn_sum(d) % 10 == 0, _refill(_chars(x), _places(_chars(x), "[0-9]"), let(body, checked))).otherwise(x)

    return let(_digits(x), new)


def _phone(x: Column, key: str) -> Column:
    """The last ten digits. Area code and exchange starting with 2 to 9 keep doing so, those starting with 0 or 1 as
    well: each of the four classes is permuted within itself."""

    def new(d: Column) -> Column:
        least = F.transform(d, lambda v, i: F.when(i.isin(0, 3) & (v >= 2), 2).otherwise(0).cast("long"))
        radices = F.transform(d, lambda v, i: F.when(~i.isin(0, 3), 10).when(v >= 2, 8).otherwise(2).cast("long"))
        moved = feistel(F.zip_with(d, least, lambda v, a: v - a), radices, key, F.lit("phone"))
        return F.zip_with(moved, least, lambda v, a: v + a).cast("array<string>")

    return _refill(_chars(x), F.slice(_places(_chars(x), "[0-9]"), -10, 10), let(F.slice(_digits(x), -10, 10), new))


def _ip(x: Column, key: str) -> Column:
    octets = F.split(x, r"\.").cast("array<bigint>")
    return F.array_join(feistel(octets, F.array(*[F.lit(256).cast("long")] * 4), key, F.lit("ip")).cast("array<string>"), ".")


def _date(x: Column, key: str) -> Column:
    day = F.datediff(F.try_to_date(x, "yyyy-MM-dd"), F.lit(DAY_0).cast("date")).cast("long")
    a, b = DAYS
    new = feistel(F.array((day / b).cast("long"), day % b), F.array(F.lit(a).cast("long"), F.lit(b).cast("long")), key, F.lit("date"))
    dated = lambda v: F.date_format(F.date_add(F.lit(DAY_0).cast("date"), (F.get(v, 0) * b + F.get(v, 1)).cast("int")), "yyyy-MM-dd")
    return F.when(day.isNull(), x).otherwise(let(new, dated))


def _ssn(x: Column, key: str) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    part = lambda at, n: F.substring(x, at, n).cast("long")
    area = part(1, 3)
    values = F.array(F.when(area > 666, area - 2).otherwise(area - 1), part(5, 2) - 1, part(8, 4) - 1)
    new = feistel(values, F.array(*[F.lit(r).cast("long") for r in (898, 99, 9999)]), key, F.lit("ssn"))
    placed = lambda v: F.format_string("%03d-%02d-%04d", F.get(v, 0) + F.when(F.get(v, 0) >= 665, 2).otherwise(1), F.get(v, 1) + 1, F.get(v, 2) + 1)
    return let(new, placed)


def _iban(x: Column, key: str) -> Column:
    def new(plain: Column) -> Column:
        land = F.substring(plain, 1, 2)
        checked = lambda body: F.concat(land, F.lpad((F.lit(98) - _mod97(F.concat(land, F.lit("00"), body))).cast("string"), 2, "0"), body)
        full = let(_swap(F.substring(plain, 5, 40), key, "iban"), checked)
        return F.when(_mod97(plain) == 1, _refill(_chars(x), _places(_chars(x), "[A-Z0-9]"), _chars(full))).otherwise(x)

    return let(F.regexp_replace(x, " ", ""), new)


def _email(x: Column, key: str) -> Column:
    """The local part; the domain stays."""
    return F.concat(_swap(F.substring_index(x, "@", 1), key, "email"), F.lit("@"), F.substring_index(x, "@", -1))


KINDS = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonymize(docs: DataFrame, key: str, kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """docs with its text's personal data replaced, and n_pseudonyms, the number of replaced values. Whoever has the key
    can turn pseudonyms back; the same key gives the same ones in another run.

    Where several kinds would match at one place, the first in the order given takes it. Values that fail their kind's
    check (Luhn's sum, mod 97, a calendar day, octets, areas of SSNs) stay as they are.

    Null text stays null with count 0; empty and clean texts are unchanged; rows are independent, so equal rows get
    equal results and an empty table gives an empty one; extra columns are kept (a column n_pseudonyms is replaced).
    """
    pattern = "|".join(f"(?:{PATTERNS[k]})" for k in kinds)

    def new(x: Column) -> Column:
        out = None
        for k in kinds:
            own = x.rlike(f"^(?:{PATTERNS[k]})$")
            out = F.when(own, KINDS[k](x, key)) if out is None else out.when(own, KINDS[k](x, key))
        return out.otherwise(x)

    # Every kind has a digit or an at sign, which most texts lack.
    held = docs["text"].rlike("[0-9@]") & docs["text"].rlike(pattern)
    found = F.when(held, F.regexp_extract_all(docs["text"], F.lit(pattern), F.lit(0)))
    out = packed(docs, text=docs["text"], found=found).withColumn("new", F.transform("found", new))
    joined = F.array_join(F.zip_with(F.split("text", pattern, -1), "new", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = F.size(F.filter(F.zip_with("found", "new", lambda a, b: a != b), lambda z: z))
    text = F.when(F.col("found").isNull(), F.col("text")).otherwise(joined).alias("text")
    others = [text if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c != "n_pseudonyms"]
    return out.select(*others, F.when(F.col("found").isNull(), 0).otherwise(changed).alias("n_pseudonyms"))
