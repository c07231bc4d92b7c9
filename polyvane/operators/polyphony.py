"""Notes, time-grid slices, steps and phrases.

The polyphony is derived from ``events``: a user is a piece, four event types are the voices, onsets are snapped up to a grid of
``SLOTS`` steps of half a quarter, a voice's last event of a slot counts, and a note lasts until the voice's next one. A note covers its slots
by an interval join with the fixed grid; everything after works on one row per (piece, slot) and runs through windows partitioned by piece.
"""

from __future__ import annotations

from polyvane.functions import cells as C
from polyvane.plans.dialect import Plan

SLOTS = 30
VOICE_EVENTS = (("S", "view", 60), ("A", "click", 53), ("T", "purchase", 48), ("B", "error", 40))
M = ["ms", "ma", "mt", "mb"]
COMPLETE = " AND ".join(f"{m} IS NOT NULL" for m in M)


def values(rows, names: str) -> str:
    quote = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    return f"(VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) AS {names}"


GRID = values([(k,) for k in range(SLOTS)], "g(i)")
PAIRS = values(C.PAIRS, "p(va, vb, role)")
ADJACENT = values(C.ADJACENT, "p(va, vb, role)")
VOICES = values([(v,) for v in C.VOICES], "v(voice)")


def pick(v: str, suffix: str = "") -> str:
    return C.by_voice(v, f"m%s{suffix}")


#: Share of the pieces, in hundredths, that are fitted on; the others are held out.
TRAIN = 40


def split_of(piece: str, seed: int = 0) -> str:
    """'train' or 'hold', by hash: a piece's side depends on nothing but the piece."""
    return f"CASE WHEN @HASH32(concat_ws('|', 'split{seed}', {piece})) % 100 < {TRAIN} THEN 'train' ELSE 'hold' END"


def add_notes(plan: Plan, part: str | None = None, catalogue: str | None = None) -> None:
    """notes, tonic and slices of all pieces or of one side of the split; ``cat_notes`` are the notes that catalogues are made of."""
    voice = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{v}'" for v, e, _ in VOICE_EVENTS) + " END"
    base = "CASE event_type " + " ".join(f"WHEN '{e}' THEN {b}" for _, e, b in VOICE_EVENTS) + " END"
    plan.add(
        snapped=f"""SELECT user_id AS piece, {voice} AS voice, cast(ceil(@HOURS(ts) / 24) AS int) AS i,
            cast({base} + cast(round(value * 100) AS bigint) % 20 AS int) AS midi, ts, event_id
            FROM {{events}} WHERE event_type IN ({', '.join(f"'{e}'" for _, e, _ in VOICE_EVENTS)}) AND user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL""",
        splits=f"SELECT piece, {split_of('piece')} AS set_name FROM (SELECT DISTINCT piece FROM {{every_note}}) p",
        notes="SELECT * FROM {every_note}" + (f" WHERE {split_of('piece')} = '{part}'" if part else ""),
        cat_notes="SELECT * FROM {every_note}" + (f" WHERE {split_of('piece')} = '{catalogue or part}'" if catalogue or part else ""),
        every_note=f"""SELECT piece, voice, i, coalesce(lead(i) OVER (PARTITION BY piece, voice ORDER BY i), {SLOTS}) AS stop, midi,
            lead(midi) OVER (PARTITION BY piece, voice ORDER BY i) AS next_midi, lead(i) OVER (PARTITION BY piece, voice ORDER BY i) AS next_i
            FROM (SELECT *, row_number() OVER (PARTITION BY piece, voice, i ORDER BY ts DESC, event_id DESC) AS r FROM {{snapped}} WHERE i >= 0 AND i < {SLOTS}) s WHERE r = 1""",
        # key finding: twelve rotations of two profiles against the pitch-class histogram
        tonic=f"""SELECT piece, tonic, mode FROM (SELECT *, row_number() OVER (PARTITION BY piece ORDER BY score DESC, tonic, mode) AS r FROM
            (SELECT piece, t.tonic, p.mode, round(sum(n * weight) / max(total), 9) AS score FROM
             (SELECT piece, pc, n, sum(n) OVER (PARTITION BY piece) AS total FROM (SELECT piece, {C.pmod('midi')} AS pc, count(*) AS n FROM {{notes}} GROUP BY piece, {C.pmod('midi')}) c) h
             CROSS JOIN {values([(k,) for k in range(12)], 't(tonic)')}
             JOIN {values([('major', k, w) for k, w in enumerate(C.MAJOR)] + [('minor', k, w) for k, w in enumerate(C.MINOR)], 'p(mode, degree, weight)')}
               ON p.degree = {C.pmod('h.pc - t.tonic')} GROUP BY piece, t.tonic, p.mode) s) q WHERE r = 1""",
        raw_slices=f"""SELECT b.piece, b.i, b.tonic, b.mode, {', '.join(f"max(CASE WHEN n.voice = '{v}' THEN n.midi END) AS m{v.lower()}" for v in C.VOICES)},
            {', '.join(f"coalesce(max(CASE WHEN n.voice = '{v}' AND n.i = b.i THEN 1 END), 0) AS x{v.lower()}" for v in C.VOICES)}
            FROM (SELECT piece, tonic, mode, i FROM {{tonic}} CROSS JOIN {GRID}) b LEFT JOIN {{notes}} n ON n.piece = b.piece AND n.i <= b.i AND b.i < n.stop
            GROUP BY b.piece, b.i, b.tonic, b.mode""",
    )


def add_slices(plan: Plan, p: str = "", source: str = "raw_slices") -> None:
    """Relations over slices, under names that begin with p: slices, steps, changes, on-beat slices, phrases, tokens."""
    deg = lambda m: C.pmod(f"{m} - tonic")
    lag = ", ".join(f"lag({m}) OVER w AS {m}0" for m in M)
    plan.add(**{
        f"{p}slices": f"SELECT *, {', '.join(f'{deg(m)} AS d{m[1]}' for m in M)}, @DOUBLE(i % 8) * 0.5 AS pos, {C.metric('(i % 8 * 0.5)')} AS metric FROM {{{source}}}",
        f"{p}steps": f"SELECT *, {lag}, {', '.join(f'lag(d{m[1]}) OVER w AS d{m[1]}0' for m in M)} FROM {{{p}slices}} WINDOW w AS (PARTITION BY piece ORDER BY i)",
        f"{p}pairs": f"""SELECT piece, i, va, vb, role, {pick('va')} AS a, {pick('vb')} AS b, {pick('va', '0')} AS a0, {pick('vb', '0')} AS b0
            FROM {{{p}steps}} CROSS JOIN {PAIRS} WHERE {' AND '.join(f'{m} IS NOT NULL AND {m}0 IS NOT NULL' for m in M)}""",
        f"{p}changes": f"""SELECT piece, i, voice, m, m0, d0 FROM (SELECT piece, i, voice, {pick('voice')} AS m, {pick('voice', '0')} AS m0, {C.by_voice('voice', 'd%s0')} AS d0
            FROM {{{p}steps}} CROSS JOIN {VOICES}) c WHERE m IS NOT NULL AND m0 IS NOT NULL AND m <> m0""",
        # complete slices on the beat; all complete ones where a piece has fewer than two of them
        f"{p}beats": f"""SELECT piece, i, tonic, {', '.join(M)}, ds, db, {C.p_cell('db', 'ds')} AS p, {C.k_token(M, 'tonic')} AS k FROM
            (SELECT *, sum({C.one('i % 2 = 0')}) OVER (PARTITION BY piece) AS beats FROM {{{p}slices}} WHERE {COMPLETE}) s WHERE i % 2 = 0 OR beats < 2""",
        f"{p}ends": f"SELECT t.piece, coalesce(max(b.i) * 500 + 10, {(SLOTS - 1) * 500}) AS end_ms FROM {{tonic}} t LEFT JOIN {{{p}beats}} b ON b.piece = t.piece GROUP BY t.piece",
        # phrases: cut after long soprano notes; times in thousandths of a quarter
        f"{p}phrases": f"""SELECT piece, ph, t0, t1, fin FROM (SELECT piece, ph, t0, t1, fin, count(*) OVER (PARTITION BY piece) AS n, alone FROM
            (SELECT piece, row_number() OVER w AS ph, t AS t0, lead(t) OVER w AS t1, {C.one('lead(t, 2) OVER w IS NULL')} AS fin, 0 AS alone FROM
             (SELECT piece, 0 AS t FROM {{{p}ends}} UNION SELECT piece, end_ms FROM {{{p}ends}} UNION
              SELECT n.piece, n.stop * 500 FROM {{notes}} n JOIN {{{p}ends}} e ON e.piece = n.piece AND n.stop * 500 <= e.end_ms WHERE n.voice = 'S' AND n.stop - n.i >= 4) c
             WINDOW w AS (PARTITION BY piece ORDER BY t)) s WHERE t1 - t0 > 500) q
            UNION ALL SELECT e.piece, 1, 0, e.end_ms + 1000, 1 FROM {{{p}ends}} e WHERE e.end_ms <= 500""",
        f"{p}inside": f"""SELECT b.*, f.ph, f.t0, f.t1, f.fin FROM {{{p}beats}} b JOIN {{{p}phrases}} f ON f.piece = b.piece AND b.i * 500 >= f.t0 AND b.i * 500 < f.t1""",
        # runs of equal cells collapse to their last slice
        f"{p}phrase_p": f"""SELECT piece, ph, fin, i, p, db, row_number() OVER (PARTITION BY piece, ph ORDER BY i DESC) AS back, lag(p) OVER (PARTITION BY piece, ph ORDER BY i) AS p0 FROM
            (SELECT *, lead(p) OVER (PARTITION BY piece, ph ORDER BY i) AS p1 FROM {{{p}inside}}) s WHERE p1 IS NULL OR p1 <> p""",
        f"{p}phrase_k": f"""SELECT piece, ph, i FROM (SELECT piece, ph, i, row_number() OVER (PARTITION BY piece, ph ORDER BY i DESC) AS back FROM
            (SELECT *, lead(k) OVER (PARTITION BY piece, ph ORDER BY i) AS k1 FROM {{{p}inside}}) s WHERE k1 IS NULL OR k1 <> k) q WHERE back <= 3""",
        f"{p}tokens": f"""SELECT piece, i, k, lag(k) OVER (PARTITION BY piece ORDER BY i) AS k0 FROM
            (SELECT *, lead(k) OVER (PARTITION BY piece ORDER BY i) AS k1 FROM {{{p}beats}}) s WHERE k1 IS NULL OR k1 <> k""",
        # a token is final if it is among the last three of the first phrase that holds its time
        f"{p}moves": f"""SELECT m.piece, m.i, m.k0, m.k, CASE WHEN f.i IS NULL THEN 'int' ELSE 'fin' END AS slot FROM
            (SELECT t.piece, t.i, t.k0, t.k, min(f.ph) AS ph FROM {{{p}tokens}} t LEFT JOIN {{{p}phrases}} f ON f.piece = t.piece AND t.i * 500 BETWEEN f.t0 AND f.t1
             WHERE t.k0 IS NOT NULL GROUP BY t.piece, t.i, t.k0, t.k) m
            LEFT JOIN {{{p}phrase_k}} f ON f.piece = m.piece AND f.ph = m.ph AND f.i = m.i""",
        f"{p}uniq_p": f"""SELECT piece, i, p, lag(p) OVER (PARTITION BY piece ORDER BY i) AS p0 FROM
            (SELECT *, lead(p) OVER (PARTITION BY piece ORDER BY i) AS p1 FROM {{{p}beats}}) s WHERE p1 IS NULL OR p1 <> p""",
        # three-note windows: changes that skip rests, and held notes under which another voice moves
        f"{p}held": _held(p),
    })


def _held(p: str) -> str:
    def others(v: str, form: str) -> str:
        return ", ".join(form.replace("?", w.lower()).replace("#", str(k)) for k, w in enumerate(x for x in C.VOICES if x != v))

    parts = []
    for v in C.VOICES:
        x, rest = v.lower(), [w.lower() for w in C.VOICES if w != v]
        columns = ", ".join(f"m{w} AS o{k}" for k, w in enumerate(rest))
        moved = C.any_of([f"coalesce(m{w} <> m{w}0, false)" for w in rest])
        parts.append(f"""SELECT piece, i, '{v}' AS voice, m{x} AS m, m{x}0 AS m0, {columns},
            {C.one(f"m{x} IS NOT NULL AND x{x} = 0 AND {C.any_of([f'x{w} = 1' for w in rest])}")} AS held,
            {C.one(' AND '.join(f'm{w} IS NOT NULL AND x{w} = 0' for w in rest))} AS hold_others,
            {C.one(f"m{x}0 = m{x} AND i < {SLOTS - 1} AND {moved}")} AS over FROM {{{p}steps}}""")
    return " UNION ALL ".join(parts)
