"""The 38 reference predicates over cells, for evaluation only: nothing that fits, counts or selects imports this module."""

from __future__ import annotations


def key(cell: str, name: str) -> str:
    """Value of name= in a cell or part of one; '' if absent."""
    return f"regexp_extract({cell}, '(^|[|]){name}=([^|]*)', 2)"


def has(cell: str, **wanted: str | tuple[str, ...]) -> str:
    parts = []
    for name, value in wanted.items():
        options = (value,) if isinstance(value, str) else value
        parts.append(f"{key(cell, name)} IN ({', '.join(repr(str(v)) for v in options)})")
    return "(" + " AND ".join(parts) + ")"


FROM, TO = "split_part({c}, '/to/', 1)", "split_part(split_part({c}, '/to/', 2), '|slot=', 1)"
SLOT = "split_part({c}, '|slot=', 2)"
#: Degree sets that count as triads and as dominant sevenths.
TRIADS = ("0.4.7", "0.3.7", "2.5.9", "2.5.8", "4.7.11", "3.7.10", "0.5.9", "0.5.8", "2.7.11", "2.7.10", "0.4.9", "0.3.8", "2.5.11", "2.5.10")
SEVENTHS = ("2.5.7.11", "2.5.7.10", "2.7.11", "5.7.11", "2.5.11")
TONIC = ("0.4.7", "0.3.7")


def predicates(c: str = "cell") -> list[tuple[str, str, str, str]]:
    """(atom, field, polarity, SQL condition on the column c)."""
    a, b, slot = FROM.format(c=c), TO.format(c=c), SLOT.format(c=c)
    eq = "regexp_extract({c}, '(^|[|])eqΔ=([^|]*)', 2) = '1'".format(c=c)
    # sequence cells only; a coarse cell has no degree set, so conditions on sets pass it by
    seq = f"instr({c}, '/to/') > 0"
    any_set = lambda sets, **more: f"({has(a, set=sets, **more)} OR {has(b, set=sets, **more)})"
    pair = lambda x, y: f"({key(a, 'b')} = '{x}' AND {key(b, 'b')} = '{y}')"
    sa_at = f"(({c} LIKE 'SA|%' OR {c} LIKE 'AT|%') AND {has(c, gap=('12to19', 'gt19'))}) OR ({c} LIKE 'TB|%' AND {has(c, gap='gt19')})"
    normal = {"S": (5, 6), "A": (4, 5, 6), "T": (4, 5), "B": (3, 4, 5)}
    outside = " OR ".join(f"({has(c, v=v)} AND {key(c, 'oct')} NOT IN ({', '.join(repr(str(o)) for o in octaves)}))" for v, octaves in normal.items())
    return [
        ("A1", "V", "under", f"{has(c, both='1', pc07='1', hold='1', sgn='same')} AND {eq}"),
        ("A2", "V", "under", has(c, role="outer", both="1", sgn="same", pc07="1", leapU="1")),
        ("A3", "H", "under", has(c, gap="cross")),
        ("A4", "O", "under", has(c, ov="1")),
        ("A5", "H", "under", sa_at),
        ("A6", "M", "under", f"{has(c, lt='1', out='1')} AND {key(c, 'mv')} <> '+1'"),
        ("A7", "M", "under", f"{has(c, b7='1')} AND {key(c, 'mv')} NOT IN ('-1', '-2')"),
        ("A8", "M", "under", has(c, mv="tritone")),
        ("A9", "G", "under", f"{c} = '7th'"),
        ("A10", "G", "under", f"{c} = 'oct+'"),
        ("A11", "S", "under", has(c, nlt="2")),
        ("A12", "S", "under", has(c, miss3="1")),
        ("A13", "S", "under", f"{has(c, missTon='1')} AND {key(c, 'n7')} <> '0'"),
        ("B1", "K", "over", any_set(TRIADS)),
        ("B2", "J", "under", f"{slot} = 'int' AND {any_set(TONIC, b='7')}"),
        ("B3", "K", "over", any_set(SEVENTHS)),
        ("B4", "K", "over", f"{has(a, ch='1')} AND {has(b, ch='0')} AND {key(a, 'b')} NOT IN ('0', '7')"),
        ("B5", "K", "under", f"{seq} AND {pair(7, 5)}"),
        ("B6", "K", "over", f"{seq} AND ({pair(0, 5)} OR {pair(5, 7)} OR {pair(7, 0)})"),
        ("C1", "Q", "over", f"{slot} = 'fin' AND {has(a, b='7')} AND {has(b, b='0', sop='0')}"),
        ("C2", "Q", "over", f"{slot} = 'fin' AND {has(b, b='0', sop=('4', '7'))}"),
        ("C3", "Q", "over", f"{pair(5, 0)} AND {has(b, sop='0')}"),
        ("C4", "Q", "over", has(b, b="7")),
        ("C5", "Q", "over", pair(7, 9)),
        ("C6", "K", "over", f"{has(a, ch='1')} AND {has(b, set=TRIADS, ch='0')} AND {key(a, 'b')} <> '7'"),
        ("C7", "Q", "over", f"{slot} = 'int' AND {has(b, b='7')}"),
        ("C8", "K", "over", f"{has(a, ch='1')} AND {has(b, b='0', set=TONIC)}"),
        ("D1", "D", "over", has(c, st01="1", st12="1", same="1", inn="0")),
        ("D2", "D", "over", has(c, st01="1", st12="1", ret="1", inn="0")),
        ("D3", "D", "over", has(c, hov="1", inn="0", st12="1")),
        ("D4", "D", "over", has(c, leap="1", st12="1", inn="0")),
        ("D5", "D", "over", has(c, ant="1")),
        ("E1", "R", "under", outside),
        ("E2", "U", "over", has(c, dbl="0")),
        ("E3", "W", "over", has(c, mot=("contrary", "oblique"))),
        ("F1", "F", "over", has(c, kind="L", bars=("2", "4"))),
        ("F2", "F", "over", has(c, kind="S", slot="fin", b="0")),
        ("F3", "F", "over", has(c, kind="S", slot="int", b="7")),
    ]
