"""The pseudonym query against a plain restatement, one value at a time."""

import datetime
import random
import re
from hashlib import sha256

import regex
from conftest_llm import table

import __spark_entry__
from termloom.llm import pseudonyms as ps
from termloom.llm import queries

KEY = "demo-key"


def feistel(values, radices, tweak):
    half = -(-len(values) // 2)
    sides, sizes = [list(values[:half]), list(values[half:])], [radices[:half], radices[half:]]
    for step in range(ps.ROUNDS):
        mine, other = sides[step % 2], sides[1 - step % 2]
        hexes = sha256("|".join([KEY, tweak, str(step), ",".join(map(str, other))]).encode()).hexdigest()
        if len(mine) > 16:
            hexes += sha256(f"{KEY}+{hexes}".encode()).hexdigest()
        sides[step % 2] = [(v + int(hexes[4 * i : 4 * i + 4], 16)) % m for i, (v, m) in enumerate(zip(mine, sizes[step % 2], strict=True))]
    return sides[0] + sides[1]


def refill(x, pattern, values, last=None):
    at = [i for i, c in enumerate(x) if regex.match(pattern, c)][-(last or 0) :]
    out = list(x)
    for i, v in zip(at, values, strict=True):
        out[i] = str(v)
    return "".join(out)


def swap(x, kind):
    at = [c for c in x if regex.match("[A-Za-z0-9]", c)]
    floor = [97 if c >= "a" else 65 if c >= "A" else 48 for c in at]
    shape = regex.sub("[A-Za-z]", "a", regex.sub("[0-9]", "9", x))
    new = feistel([ord(c) - f for c, f in zip(at, floor, strict=True)], [26 if f > 48 else 10 for f in floor], kind + shape)
    return refill(x, "[A-Za-z0-9]", [chr(f + v) for f, v in zip(floor, new, strict=True)])


def luhn(digits):
    return sum((2 * d - 9 if d > 4 else 2 * d) if (len(digits) - i) % 2 == 0 else d for i, d in enumerate(digits))


def mod97(x):
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97


def card(x):
    d = [int(c) for c in x if c.isdigit()]
    if luhn(d) % 10:
        return x
    body = feistel(d[:-1], [10] * (len(d) - 1), f"card{len(d)}")
    return refill(x, "[0-9]", [*body, -luhn([*body, 0]) % 10])


def phone(x):
    d = [int(c) for c in x if c.isdigit()][-10:]
    first = {0, 3}  # of area code and exchange: 0 and 1 are a class, 2 to 9 another
    least = [2 if i in first and v > 1 else 0 for i, v in enumerate(d)]
    radices = [10 if i not in first else 8 if v > 1 else 2 for i, v in enumerate(d)]
    new = feistel([a - b for a, b in zip(d, least, strict=True)], radices, "phone")
    return refill(x, "[0-9]", [a + b for a, b in zip(new, least, strict=True)], 10)


def date(x):
    first = datetime.date(1900, 1, 1)
    try:
        day = (datetime.date.fromisoformat(x) - first).days
    except ValueError:
        return x
    a, b = feistel([day // 229, day % 229], [319, 229], "date")
    return str(first + datetime.timedelta(a * 229 + b))


def ssn(x):
    a, b, c = map(int, x.split("-"))
    a, b, c = feistel([a - 2 if a > 666 else a - 1, b - 1, c - 1], [898, 99, 9999], "ssn")
    return f"{a + (2 if a >= 665 else 1):03d}-{b + 1:02d}-{c + 1:04d}"


def iban(x):
    plain = x.replace(" ", "")
    if mod97(plain) != 1:
        return x
    body = swap(plain[4:], "iban")
    return refill(x, "[A-Z0-9]", plain[:2] + f"{98 - mod97(plain[:2] + '00' + body):02d}" + body)


RESTATED = {
    "email": lambda x: swap(x.split("@")[0], "email") + "@" + x.split("@")[-1],
    "iban": iban,
    "ip": lambda x: ".".join(map(str, feistel([int(o) for o in x.split(".")], [256] * 4, "ip"))),
    "date": date,
    "ssn": ssn,
    "phone": phone,
    "card": card,
}
EVERY = regex.compile("|".join(f"(?:{p})" for p in ps.PATTERNS.values()))
KINDS = {k: regex.compile(f"^(?:{p})$") for k, p in ps.PATTERNS.items()}


def restated(text):
    if text is None:
        return None, 0
    n = 0

    def new(m):
        nonlocal n
        for kind, pattern in KINDS.items():
            if pattern.match(m[0]):
                out = RESTATED[kind](m[0])
                n += out != m[0]
                return out
        return m[0]

    return EVERY.sub(new, text), n


TEXTS = [
    "x 123-45-6789 born 1984-02-29, 1984-02-30 GB82 WEST 1234 5698 7654 32 or DE89370400440532013000, DE89370400440532013001.",
    "4111 1111 1111 1111 4111111111111112 4111-1111-1111-1111 call (212) 555-0100, 212.555.0100 +1 646-555-0199 1-212-555-0100",
    "A.b-c9@x.org first_last+tag.0123456789.abcdefghijklmnopqrstuvwxyz0123456789@mail.example.co.uk 1.2.3.4 v1.2.3.4.5 256.1.1.1 665-01-0001 667-99-9999 666-12-1234",
    "9999-12-31 2099-12-31 1900-01-01 é212-555-0100 4111111111111111é 000000000000000000 a@b.c @ ..",
]


def test_whole_query(spark):
    sf = "/root/testdata/sf0.01"
    source = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    spark.conf.set(queries.KEY, KEY)
    got = __spark_entry__.queries()["op1_feistel_pseudonyms"](spark, sf).collect()
    spark.conf.unset(queries.KEY)
    assert len(got) == len(source) and sum(r["n_pseudonyms"] for r in got) > 50
    for r in got:
        assert (r["text"], r["n_pseudonyms"]) == restated(source[r["doc_id"]])


def test_every_kind(spark, awkward):
    docs = table(spark, [(i, t, "a") for i, t in enumerate(TEXTS)]).union(awkward)
    for r, s in zip(ps.pseudonymize(docs, "demo-key").collect(), docs.collect(), strict=True):
        assert (r["text"], r["n_pseudonyms"]) == restated(s["text"])


def test_there_is_no_key_by_default(spark):
    spark.conf.unset(queries.KEY)
    first = queries.pseudonym_key(spark)
    assert len(first) == 64 and queries.pseudonym_key(spark) == first
    spark.conf.unset(queries.KEY)
    assert queries.pseudonym_key(spark) != first
    spark.conf.unset(queries.KEY)


def planted(r):
    """A value of each kind, made without the operator's patterns, with its kind."""
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card():
        body = r.choice("3456") + digits(14)
        total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(body)), 1) for d in [d])
        total = sum((2 * d - 9 if d > 4 else 2 * d) if i % 2 else d for i, d in enumerate(map(int, reversed(body)), 1))
        full = body + str(-total % 10)
        return r.choice([full, " ".join(full[i : i + 4] for i in range(0, 16, 4)), "-".join(full[i : i + 4] for i in range(0, 16, 4))])

    def iban():
        body = digits(18)
        return "DE" + f"{98 - int(body + '131400') % 97:02d}" + body

    yield "email", r.choice(["ann", "bo.lee", "x_y+z"]) + digits(2) + "@" + r.choice(["mail.example.com", "ex.org"])
    yield "iban", iban()
    yield "ip", ".".join(str(r.randrange(256)) for _ in range(4))
    yield "date", f"{r.randrange(1900, 2100)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}"
    yield "ssn", f"{r.choice([*range(1, 666), *range(667, 900)]):03d}-{r.randrange(1, 100):02d}-{r.randrange(1, 10000):04d}"
    yield "phone", r.choice(["+1 ({}) {}-{}", "({}) {}-{}", "{}-{}-{}", "{}.{}.{}"]).format(digits(3), digits(3), digits(4))
    yield "card", card()


def test_planted_values_are_found(spark):
    """Detection against values made by their own rules, in plain words that must stay."""
    r = random.Random(31)
    rows, plain = [], []
    for i in range(60):
        values = [v for _, v in planted(r)]
        r.shuffle(values)
        words = [f"w{chr(97 + j)}" for j in range(len(values) + 1)]
        rows.append((i, " ".join(x for pair in zip(words, [*values, ""], strict=True) for x in pair).strip(), "a"))
        plain.append((words, values))
    for (words, values), got in zip(plain, ps.pseudonymize(table(spark, rows), "k").orderBy("doc_id").collect(), strict=True):
        rest = got["text"]
        for a, b, old in zip(words, words[1:], values, strict=False):
            new = rest[rest.index(a) + len(a) : rest.index(f" {b}")].strip()
            shape = lambda v: re.sub(r"[0-9]", "9", re.sub(r"[A-Za-z]", "a", re.sub(r"^\d+\.\d+\.\d+\.\d+$", "ip", v)))
            assert shape(new) == shape(old), (old, new)
            assert new != old, old
        assert got["n_pseudonyms"] == len(values)
