"""XXH64 of texts in DuckDB SQL, for oracles: 128-bit numbers stand in for wrapping ones."""

from __future__ import annotations

from collections.abc import Callable

#: The primes of XXH64.
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
_WORD = 1 << 64


def _u(value: int) -> str:
    return f"{value % _WORD}::UHUGEINT"


_P1, _P2, _P3, _P4, _P5 = map(_u, PRIMES)
_M = f"{_WORD}::UHUGEINT"


def _let(value: str, name: str, body: Callable[[str], str]) -> str:
    """``body`` of a value that is computed once."""
    return f"list_transform([{value}], lambda {name}: {body(name)})[1]"


def _times(a: str, b: str) -> str:
    return f"(({a}) * {b} % {_M})"


def _turned(value: str, bits: int, name: str) -> str:
    return _let(value, name, lambda v: f"(({v} * {_u(1 << bits)} % {_M}) + {v} // {_u(1 << 64 - bits)})")


def _round(state: str, lane: str, name: str) -> str:
    return _times(_turned(f"({state} + {_times(lane, _P2)}) % {_M}", 31, name), _P1)


def _lane(at: str, n: int) -> str:
    """``n`` bytes of the hexadecimal text h from byte ``at`` on, the first one least significant."""
    digits = " || ".join(f"substr(h, CAST(2 * ({at} + {n - 1 - k}) + 1 AS BIGINT), 2)" for k in range(n))
    return f"CAST(CAST('0x' || {digits} AS UBIGINT) AS UHUGEINT)"


def xxh64_ctes(source: str, column: str, seed: int) -> str:
    """CTEs whose last, ``xxh64``, has ``column`` of ``source`` (texts, not null) and its unsigned hash."""
    start = "[" + ", ".join(map(_u, (seed + PRIMES[0] + PRIMES[1], seed + PRIMES[1], seed, seed - PRIMES[0]))) + "]"
    lanes = ", ".join(_round(f"s[{i + 1}]", _lane(f"32 * o[1] + {8 * i}", 8), f"u{i}") for i in range(4))
    whole = f"list_reduce(list_transform(range(0, n // 32), lambda j: [CAST(j AS UHUGEINT)]), lambda s, o: [{lanes}], {start})"
    joined = "(" + " + ".join(_turned(f"a[{i + 1}]", bits, f"r{i}") for i, bits in enumerate((1, 7, 12, 18))) + f") % {_M}"
    for i in range(4):
        joined = f"({_times(f'xor({joined}, ' + _round('0::UHUGEINT', f'a[{i + 1}]', f'm{i}') + ')', _P1)} + {_P4}) % {_M}"
    eight = _times(_turned(f"xor(z, {_round('0::UHUGEINT', _lane('CAST(o AS BIGINT)', 8), 'w1')})", 27, "w2"), _P1)
    four = _times(_turned(f"xor(g, {_times(_lane('n // 8 * 8', 4), _P1)})", 23, "w3"), _P2)
    one = _times(_turned(f"xor(z, {_times(_lane('CAST(o AS BIGINT)', 1), _P5)})", 11, "w4"), _P1)
    places = lambda first, count, step: f"list_transform(range(0, {count}), lambda j: CAST({first} + {step} * j AS UHUGEINT))"
    return f"""x0 AS (SELECT {column}, hex(encode({column})) AS h, octet_length(encode({column})) AS n FROM {source}),
x1 AS (SELECT *, CASE WHEN n >= 32 THEN {whole} END AS a FROM x0),
x2 AS (SELECT {column}, h, n, ((CASE WHEN n >= 32 THEN {joined} ELSE {_u(seed + PRIMES[4])} END) + n::UHUGEINT) % {_M} AS g FROM x1),
x3 AS (SELECT {column}, h, n, list_reduce({places("n // 32 * 32", "n % 32 // 8", 8)}, lambda z, o: ({eight} + {_P4}) % {_M}, g) AS g FROM x2),
x4 AS (SELECT {column}, h, n, CASE WHEN n % 8 >= 4 THEN ({four} + {_P3}) % {_M} ELSE g END AS g FROM x3),
x5 AS (SELECT {column}, list_reduce({places("n // 4 * 4", "n % 4", 1)}, lambda z, o: {one}, g) AS g FROM x4),
x6 AS (SELECT {column}, {_times(f"xor(g, g // {_u(1 << 33)})", _P2)} AS g FROM x5),
x7 AS (SELECT {column}, {_times(f"xor(g, g // {_u(1 << 29)})", _P3)} AS g FROM x6),
xxh64 AS (SELECT {column}, CAST(xor(g, g // {_u(1 << 32)}) AS UBIGINT) AS hash FROM x7)"""
