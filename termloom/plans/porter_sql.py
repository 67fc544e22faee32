"""Porter's stemmer as DuckDB SQL over a table of terms, restated step by step to check the other one.

Beside each word w its pattern c is kept, V for vowels and C for consonants, so that a stem's measure is a count of VC.
"""

from __future__ import annotations

from ..functions.porter import IRREGULAR, STEP2, STEP3, STEP4


def _pattern(w: str) -> str:
    out = f"regexp_replace(regexp_replace(regexp_replace({w}, '[aeiou]', 'V', 'g'), '[b-df-hj-np-tv-xz0-9]', 'C', 'g'), '^y', 'C')"
    for _ in range(8):  # each round settles one more y of a run
        out = f"replace(replace({out}, 'Cy', 'CV'), 'Vy', 'VC')"
    return out


def _constant(letters: str) -> str:
    return "".join("V" if x in "aeiou" else "C" for x in letters)


def _cut(column: str, n: int) -> str:
    return f"substr({column}, 1, length({column}) - {n})"


def _measure(c: str) -> str:
    return f"((length({c}) - length(replace({c}, 'VC', ''))) // 2)"


def _short(w: str, c: str) -> str:
    return f"((length({w}) > 2 and right({c}, 3) = 'CVC' and right({w}, 1) not in ('w', 'x', 'y')) or {c} = 'VC' and length({w}) = 2)"


def _suffixes(table: dict[str, str], least: int) -> tuple[str, str]:
    """Expressions of the next w and c: the longest ending in the table gives way if what is before it measures more than least."""
    w, c = "case", "case"
    for end in sorted(table, key=len, reverse=True):
        n, ok = len(end), f"ends_with(w, '{end}')"
        more = f"{_measure(_cut('c', n))} > {least}" + (" and right(" + _cut("w", 3) + ", 1) in ('s', 't')" if end == "ion" and least else "")
        w += f" when {ok} then case when {more} then {_cut('w', n)} || '{table[end]}' else w end"
        c += f" when {ok} then case when {more} then {_cut('c', n)} || '{_constant(table[end])}' else c end"
    return w + " else w end", c + " else c end"


def stems(terms: str) -> str:
    """A SELECT of tok and stem for the table `terms` of distinct lower-case tok."""
    steps: list[tuple[str, str]] = []
    # plurals
    n = "case when ends_with(w, 'sses') then 2 when ends_with(w, 'ies') then case when length(w) = 4 then 1 else 2 end when ends_with(w, 's') and not ends_with(w, 'ss') then 1 else 0 end"
    steps.append((f"substr(w, 1, length(w) - ({n}))", f"substr(c, 1, length(c) - ({n}))"))
    # past forms: the base b with its pattern d, null where there is none
    base = f"case when ends_with(w, 'ied') or ends_with(w, 'eed') then null when ends_with(w, 'ed') and contains({_cut('c', 2)}, 'V') then 2 when ends_with(w, 'ing') and contains({_cut('c', 3)}, 'V') then 3 end"
    b, d = f"substr(w, 1, length(w) - ({base}))", f"substr(c, 1, length(c) - ({base}))"
    doubled = f"(length({b}) > 1 and substr({b}, length({b}), 1) = substr({b}, length({b}) - 1, 1) and right({d}, 1) = 'C')"
    with_e = f"(right({b}, 2) in ('at', 'bl', 'iz') or not {doubled} and {_measure(d)} = 1 and {_short(b, d)})"
    less = f"({doubled} and right({b}, 2) not in ('at', 'bl', 'iz') and right({b}, 1) not in ('l', 's', 'z'))"
    past = lambda x, y, e: (
        f"case when ends_with(w, 'ied') then case when length(w) = 4 then {_cut(x, 1)} else {_cut(x, 2)} end"
        f" when ends_with(w, 'eed') then case when {_measure(_cut('c', 3))} > 0 then {_cut(x, 1)} else {x} end"
        f" when ({base}) is null then {x} when {with_e} then {y} || '{e}' when {less} then {_cut(y, 1)} else {y} end"
    )
    steps.append((past("w", b, "e"), past("c", d, "V")))
    # final y
    y = "ends_with(w, 'y') and length(w) > 2 and substr(c, length(c) - 1, 1) = 'C'"
    steps.append((f"case when {y} then {_cut('w', 1)} || 'i' else w end", f"case when {y} then {_cut('c', 1)} || 'V' else c end"))
    # double endings
    alli = f"ends_with(w, 'alli') and {_measure(_cut('c', 4))} > 0"
    steps.append((f"case when {alli} then {_cut('w', 2)} else w end", f"case when {alli} then {_cut('c', 2)} else c end"))
    table = {k: v for k, v in STEP2.items() if k != "abli"} | {"bli": "ble", "fulli": "ful"}
    w, c = _suffixes(table, 0)
    logi = f"case when ends_with(w, 'logi') then case when {_measure(_cut('c', 3))} > 0 then {{}} else {{}} end else {{}} end"
    steps.append((logi.format(_cut("w", 1), "w", w), logi.format(_cut("c", 1), "c", c)))
    steps.append(_suffixes(STEP3, 0))
    steps.append(_suffixes(dict.fromkeys(STEP4, ""), 1))
    # final e and ll
    rest, pattern = _cut("w", 1), _cut("c", 1)
    e = f"ends_with(w, 'e') and ({_measure(pattern)} > 1 or {_measure(pattern)} = 1 and not {_short(rest, pattern)})"
    steps.append((f"case when {e} then {rest} else w end", f"case when {e} then {pattern} else c end"))
    ll = f"ends_with(w, 'll') and {_measure(pattern)} > 1"
    steps.append((f"case when {ll} then {rest} else w end", "c"))
    out = f"select tok, tok as w, {_pattern('tok')} as c from {terms}"
    for w, c in steps:
        out = f"select tok, {w} as w, {c} as c from ({out})"
    special = "".join(f" when '{k}' then '{v}'" for k, v in IRREGULAR.items())
    return f"select tok, case tok{special} else case when length(tok) <= 2 then tok else w end end as stem from ({out})"
