"""Corpora with coordination destroyed: each gives a relation of raw slices for ``add_slices``; pitches move, attacks and bar positions stay.

All draws are hashes of (scheme, seed, piece, voice): the same on every run, partitioning and engine.
"""

from __future__ import annotations

from polyvane.functions import cells as C
from polyvane.operators.counts import add_counts
from polyvane.operators.infer import add_residuals
from polyvane.operators.polyphony import SLOTS, VOICES, add_slices, pick, values
from polyvane.plans.dialect import Plan

STAY = "piece, i, tonic, mode, xs, xa, xt, xb"


def _gather(moved: str, source: str = "{raw_slices}") -> str:
    """Slices whose pitches come from moved(piece, i, voice, m)."""
    return f"""SELECT b.{STAY.replace(', ', ', b.')}, {', '.join(f"max(CASE WHEN v.voice = '{v}' THEN v.m END) AS m{v.lower()}" for v in C.VOICES)}
        FROM {source} b LEFT JOIN ({moved}) v ON v.piece = b.piece AND v.i = b.i GROUP BY b.{STAY.replace(', ', ', b.')}"""


def draw(name: str, n: str, *keys: str) -> str:
    """Uniform integer in [0, n)."""
    return f"(@HASH32(concat_ws('|', '{name}', {', '.join(keys)})) % ({n}))"


def add_desync(plan: Plan, seed: int = 0) -> None:
    voiced = f"SELECT r.piece, r.i, v.voice, {pick('v.voice')} AS m FROM {{raw_slices}} r CROSS JOIN {VOICES}"
    back = lambda shift: C.pmod(f"i - ({shift})", SLOTS)
    free = lambda shift: f"CASE voice WHEN 'S' THEN 0 ELSE {shift} END"
    agree = " UNION ALL ".join(f"SELECT {s} AS shift, {sum(k % 8 == (k + s) % SLOTS % 8 for k in range(SLOTS)) / SLOTS} AS agree" for s in range(1, SLOTS))
    source = "CASE r WHEN 1 THEN 'S' WHEN 2 THEN 'A' WHEN 3 THEN 'T' ELSE 'B' END"
    plan.add(
        **{name: _gather(f"SELECT piece, {back(free('1 + ' + draw(f'rot{k}', str(SLOTS - 1), 'piece', 'voice')))} AS i, voice, m FROM ({voiced}) s") for name, k in (("rotated", seed), ("rotated1", seed + 1), ("rotated2", seed + 2))},
        # shifts that keep the bar positions aligned in nine of ten slices, or else the five that do so best
        metric_shifts=f"SELECT shift, row_number() OVER (ORDER BY shift) - 1 AS k, count(*) OVER () AS n FROM (SELECT *, row_number() OVER (ORDER BY agree DESC, shift) AS r, max(agree) OVER () AS best FROM ({agree}) a) b WHERE agree >= 0.9 OR best < 0.9 AND r <= 5",
        rotated_metric=_gather(f"""SELECT piece, {back(free('shift'))} AS i, voice, m FROM ({voiced}) s JOIN {{metric_shifts}} c ON c.k = {draw(f'metric{seed}', 'c.n', 'piece', 'voice')}"""),
        in_phrase=f"""SELECT r.piece, r.i, f.ph, row_number() OVER (PARTITION BY r.piece, f.ph ORDER BY r.i) - 1 AS k, count(*) OVER (PARTITION BY r.piece, f.ph) AS n
            FROM {{raw_slices}} r JOIN {{phrases}} f ON f.piece = r.piece AND r.i * 500 >= f.t0 AND r.i * 500 < f.t1""",
        rotated_phrase=_gather(f"""SELECT s.piece, coalesce(t.i, s.i) AS i, s.voice, s.m FROM (SELECT v.*, q.ph, q.k, q.n FROM ({voiced}) v LEFT JOIN {{in_phrase}} q ON q.piece = v.piece AND q.i = v.i) s
            LEFT JOIN {{in_phrase}} t ON t.piece = s.piece AND t.ph = s.ph AND s.n >= 3
             AND t.k = CASE s.voice WHEN 'S' THEN s.k ELSE ((s.k - 1 - {draw(f'phrase{seed}', 'greatest(s.n, 2) - 1', 's.piece', 's.ph', 's.voice')}) % s.n + s.n) % s.n END"""),
        permuted=_gather(f"SELECT s.piece, s.i, p.target AS voice, s.m FROM ({voiced}) s JOIN (SELECT piece, voice, {source} AS target FROM (SELECT piece, voice, row_number() OVER (PARTITION BY piece ORDER BY @HASH32(concat_ws('|', 'label{seed}', piece, voice)), voice) AS r FROM {{tonic}} CROSS JOIN {VOICES}) q) p ON p.piece = s.piece AND p.voice = s.voice"),
        # each voice from another piece of the same order: no piece keeps a voice of its own but the soprano
        # numbered by bucket of the hash, at most 4,096 of them, on top of the buckets before
        donor_hashes=f"SELECT piece, h, cast(floor(h / 1048576.0) AS int) AS bucket FROM (SELECT piece, @HASH32(concat_ws('|', 'donor{seed}', piece)) AS h FROM {{tonic}}) t",
        donor_buckets="SELECT bucket, sum(count(*)) OVER (ORDER BY bucket) - count(*) AS before, sum(count(*)) OVER () AS n FROM {donor_hashes} GROUP BY bucket",
        numbered_pieces="SELECT h.piece, cast(b.before + row_number() OVER (PARTITION BY h.bucket ORDER BY h.h, h.piece) - 1 AS bigint) AS k, cast(b.n AS bigint) AS n FROM {donor_hashes} h JOIN {donor_buckets} b ON b.bucket = h.bucket",
        recombined=_gather(f"""SELECT t.piece, s.i, s.voice, s.m FROM ({voiced}) s JOIN {{numbered_pieces}} d ON d.piece = s.piece
            JOIN {{numbered_pieces}} t ON t.k = (d.k + CASE s.voice WHEN 'S' THEN 0 WHEN 'A' THEN 1 WHEN 'T' THEN 2 ELSE 3 END) % d.n"""),
        transposed=f"SELECT {STAY}, {', '.join(f'm{v.lower()} + 5 AS m{v.lower()}' for v in C.VOICES)} FROM {{raw_slices}}".replace("tonic,", "(tonic + 5) % 12 AS tonic,"),
    )


def add_circular(plan: Plan, copies: int = 16) -> None:
    """A null of real counts: those of so many independently rotated copies of the corpus, each copy of a piece a piece of its own."""
    voiced = f"SELECT r.piece, r.i, v.voice, {pick('v.voice')} AS m FROM {{copied}} r CROSS JOIN {VOICES}"
    shift = f"CASE voice WHEN 'S' THEN 0 ELSE 1 + {draw('circular', str(SLOTS - 1), 'piece', 'voice')} END"
    plan.add(copied=f"SELECT piece * {copies} + c.k AS piece, {STAY.removeprefix('piece, ')}, ms, ma, mt, mb FROM {{raw_slices}} CROSS JOIN {values([(k,) for k in range(copies)], 'c(k)')}",
             shifted=_gather(f"SELECT piece, {C.pmod(f'i - ({shift})', SLOTS)} AS i, voice, m FROM ({voiced}) s", "{copied}"))
    add_slices(plan, "c_", "shifted")
    add_counts(plan, "c_", rest=False)
    pair = lambda f: f"SELECT '{f}' AS field, coalesce(r.cell, c.cell) AS cell, @DOUBLE(coalesce(r.n, 0)) AS nr, @DOUBLE(c.n) AS null_n FROM {{real_{f.lower()}}} r FULL OUTER JOIN {{c_real_{f.lower()}}} c ON c.cell = r.cell"
    plan.add(circular_joined=" UNION ALL ".join(map(pair, CIRCULAR)))
    add_residuals(plan, "circular_residuals", "circular_joined")


#: Fields that a rotation of whole voices changes and that read nothing but slices.
CIRCULAR = ("V", "O", "H", "S")
