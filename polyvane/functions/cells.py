"""Cells: categorical descriptions of notes, steps, pairs and sonorities, as SQL expressions over integer columns."""

from __future__ import annotations

VOICES = ("S", "A", "T", "B")
#: Voice pairs with their role; a step's pair is (upper, lower).
PAIRS = (("S", "A", "adjacent"), ("S", "T", "diagonal"), ("S", "B", "outer"), ("A", "T", "adjacent"), ("A", "B", "diagonal"), ("T", "B", "adjacent"))
ADJACENT = tuple(p for p in PAIRS if p[2] == "adjacent")
FIELDS = ("V", "H", "M", "S", "P", "O", "G", "Q", "K", "J", "D", "R", "U", "W", "F")
SPARSE = ("Q", "P", "G", "O", "K", "J", "D", "R", "U", "W", "F")
DIATONIC = (0, 2, 4, 5, 7, 9, 11)
#: Weights of the twelve degrees in major and minor for key finding.
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)
#: Pitch class names.
PITCH_NAMES = ("C", "C#", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B")
#: Upper limits of the duration classes; longer is 'long'.
DURATIONS = ((0.26, "16"), (0.51, "8"), (1.01, "4"), (2.01, "2"), (4.01, "1"))


def one(x: str) -> str:
    return f"CASE WHEN {x} THEN 1 ELSE 0 END"


def pmod(x: str, n: int = 12) -> str:
    """Floor modulo; SQL's % truncates."""
    return f"((({x}) % {n} + {n}) % {n})"


def text(*parts: str) -> str:
    return f"concat({', '.join(parts)})"


def isin(x: str, values: tuple[int, ...]) -> str:
    return f"{x} IN ({', '.join(map(str, values))})"


def by_voice(v: str, form: str) -> str:
    """form with %s replaced by the voice letter that column v holds."""
    return f"CASE {v} " + " ".join(f"WHEN '{x}' THEN {form % x.lower()}" for x in VOICES) + " END"


def sign_class(a: str, b: str) -> str:
    return f"CASE WHEN {a} = 0 AND {b} = 0 THEN 'stat' WHEN {a} = 0 OR {b} = 0 THEN 'obl' WHEN ({a} > 0) = ({b} > 0) THEN 'same' ELSE 'opp' END"


def motion(a: str, b: str) -> str:
    return f"CASE WHEN {a} = 0 AND {b} = 0 THEN 'static' WHEN {a} = 0 OR {b} = 0 THEN 'oblique' WHEN ({a} > 0) <> ({b} > 0) THEN 'contrary' WHEN {a} = {b} THEN 'parallel' ELSE 'similar' END"


def perfect(iv: str) -> str:
    a = f"abs({iv})"
    return f"CASE WHEN {a} = 0 THEN 'P1' WHEN {a} = 7 THEN 'P5' WHEN {a} % 12 = 7 THEN 'P5c' WHEN {a} = 12 THEN 'P8' WHEN {a} % 12 = 0 THEN 'P8c' ELSE '-' END"


def v_cell(da: str, db: str, iv0: str, iv1: str, role: str) -> str:
    bit = lambda name, x: f"'{name}=', {one(x)}"
    return text(bit("both", f"{da} <> 0 AND {db} <> 0"), bit("|eqΔ", f"{da} = {db}"), bit("|pc07", f"abs({iv1}) % 12 IN (0, 7)"), bit("|hold", f"{iv1} = {iv0}"),
                bit("|leapU", f"abs({da}) > 2"), f"'|sgn=', {sign_class(da, db)}", f"'|role=', {role}")


def h_cell(pair: str, gap: str) -> str:
    return text(pair, f"'|gap=', CASE WHEN {gap} < 0 THEN 'cross' WHEN {gap} <= 7 THEN 'le8' WHEN {gap} <= 12 THEN '8to12' WHEN {gap} <= 19 THEN '12to19' ELSE 'gt19' END")


def o_cell(pair: str, a0: str, b0: str, a1: str, b1: str) -> str:
    return text(pair, f"'|ov=', {one(f'{b1} > {a0} OR {a1} < {b0}')}")


def g_cell(d: str) -> str:
    return f"CASE WHEN abs({d}) >= 12 THEN 'oct+' WHEN abs({d}) IN (10, 11) THEN '7th' WHEN abs({d}) = 6 THEN 'tritone' WHEN abs({d}) >= 5 THEN 'leap' ELSE 'small' END"


def move(d: str) -> str:
    return (f"CASE {d} WHEN 1 THEN '+1' WHEN -1 THEN '-1' WHEN -2 THEN '-2' WHEN 0 THEN 'stay' WHEN 2 THEN 'step' ELSE "
            f"CASE WHEN abs({d}) = 6 THEN 'tritone' WHEN abs({d}) IN (10, 11) THEN '7th' WHEN abs({d}) >= 12 THEN 'oct+' ELSE 'leap' END END")


def m_cell(voice: str, deg0: str, d: str) -> str:
    return text(f"'out=', {one(f'{voice} IN (' + chr(39) + 'S' + chr(39) + ', ' + chr(39) + 'B' + chr(39) + ')')}", f"'|lt=', {one(f'{deg0} = 11')}", f"'|b7=', {one(f'{deg0} = 10')}", f"'|mv=', {move(d)}")


def total(xs: list[str]) -> str:
    return "(" + " + ".join(xs) + ")"


def any_of(xs: list[str]) -> str:
    return "(" + " OR ".join(xs) + ")"


def s_cell(m: list[str], tonic: str) -> str:
    """Sonority flags of four pitches S, A, T, B."""
    deg = [pmod(f"{x} - {tonic}") for x in m]
    has = lambda k: any_of([f"{d} = {k}" for d in deg])
    third = any_of([f"abs({x} - {m[3]}) % 12 IN (3, 4)" for x in m])
    full = f"({has(0)} AND {has(7)} AND ({has(4)} OR {has(3)}))"
    count = lambda k: f"least({total([one(f'{d} = {k}') for d in deg])}, 2)"
    return text(f"'nlt=', {count(11)}", f"'|miss3=', {one(f'NOT {third}')}", f"'|n7=', {count(10)}", f"'|missTon=', {one(f'NOT {full}')}")


def bucket(deg: str) -> str:
    return f"CASE WHEN {isin(deg, DIATONIC)} THEN cast({deg} AS varchar(2)) ELSE 'x' END"


def p_cell(bass: str, soprano: str) -> str:
    return text(f"'b=', {bucket(bass)}", f"'|sop=', {bucket(soprano)}")


def k_token(m: list[str], tonic: str) -> str:
    """Bass bucket, sorted distinct degrees, chromatic flag."""
    deg = [pmod(f"{x} - {tonic}") for x in m]
    degrees = ", ".join(f"CASE WHEN {any_of([f'{d} = {k}' for d in deg])} THEN '{k}' END" for k in range(12))
    chromatic = any_of([f"NOT {isin(d, DIATONIC)}" for d in deg])
    return text(f"'b=', {bucket(deg[3])}", f"'|set=', concat_ws('.', {degrees})", f"'|ch=', {one(chromatic)}")


def u_cell(m: list[str], tonic: str) -> str:
    deg = [pmod(f"{x} - {tonic}") for x in m]
    twice = [f"WHEN {total([one(f'{d} = {k}') for d in deg])} >= 2 THEN '{k}'" for k in range(12)]
    return text("'dbl='", f"CASE {' '.join(twice)} ELSE 'none' END")


def d_cell(m0: str, m1: str, m2: str, others: list[str], following: list[str], held: str, hold_others: str, pedal: str, hov: int) -> str:
    """Non-harmonic bits of a three-note window; others and following are the other voices' pitches then and at the third note."""
    a, b, pc = f"({m1} - {m0})", f"({m2} - {m1})", pmod(m1)
    inn = f"coalesce({any_of([f'{pmod(x)} = {pc}' for x in others])}, false)"
    nxt = f"coalesce({any_of([f'{pmod(x)} = {pc}' for x in following])}, false)"
    bits = {"st01": f"abs{a} IN (1, 2)", "st12": f"abs{b} IN (1, 2)", "same": f"{a} <> 0 AND {b} <> 0 AND ({a} > 0) = ({b} > 0)", "ret": f"{m2} = {m0}", "inn": inn, "held": held,
            "leap": f"abs{a} >= 3", "ant": f"NOT {inn} AND {nxt}", "ped": pedal, "holdO": hold_others}
    return text(*[f"'{'|' if k else ''}{name}=', {one(x)}" for k, (name, x) in enumerate(bits.items())], f"'|hov={hov}'")


def metric(pos: str) -> str:
    """Metric label for bars of four, from the position in the bar."""
    return f"CASE WHEN abs({pos}) < 0.000001 THEN 'downbeat' WHEN abs({pos} - 2) < 0.000001 THEN 'strong' WHEN abs({pos} - round({pos})) < 0.000001 THEN 'weak' ELSE 'offbeat' END"


def duration(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} < {limit} THEN '{name}'" for limit, name in DURATIONS) + " ELSE 'long' END"


def pitch_name(m: str) -> str:
    names = " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(PITCH_NAMES))
    return f"CASE WHEN {m} IS NULL THEN 'rest' ELSE concat(CASE {pmod(m)} {names} END, cast(floor({m} / 12.0) - 1 AS int)) END"


def cell_z(nr: str, n0: str, total_real: str, total_null: str) -> str:
    lam = f"(({n0} + 0.5) * {total_real} / greatest({total_null}, 1))"
    return f"(({nr} - {lam}) / sqrt({lam} + 0.5))"


def erfc(z: str) -> str:
    """Complementary error function by the Chebyshev form of Numerical Recipes (fixed values); error below 1.2e-7 of the value."""
    coefficients = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    t = f"(1 / (1 + abs({z}) / 2))"
    poly = str(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        poly = f"({c} + {t} * {poly})"
    tail = f"({t} * exp(-({z}) * ({z}) + {poly}))"
    return f"CASE WHEN {z} >= 0 THEN {tail} ELSE 2 - {tail} END"


def normal_cdf(z: str) -> str:
    return f"(0.5 * ({erfc(f'(-({z}) / sqrt(2.0))')}))"


def normal_quantiles(source: str, columns: str, digits: int = 9) -> str:
    """Rows of source(p, ...) with z, the largest number of so many digits, from -10 on, whose normal probability is at most p: the inverse by search, one
    decimal place after the other, on rows instead of in a loop."""
    places = ", ".join(f"({k})" for k in range(20))
    rows = f"SELECT {columns}, p, -10.0 AS z FROM ({source}) q"
    for k in range(digits + 1):
        rows = f"SELECT {columns}, p, max(z) AS z FROM (SELECT {columns}, p, z + d * {10.0 ** -k:.{k}f} AS z, d FROM ({rows}) a{k} CROSS JOIN (VALUES {places}) AS v{k}(d)) b{k} WHERE d = 0 OR {normal_cdf('z')} <= p GROUP BY {columns}, p"
    return rows.replace("* 1 AS z", "* 1.0 AS z")
