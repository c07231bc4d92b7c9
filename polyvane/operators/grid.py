"""Slices of pieces of any length: the grid of a piece runs to its own end, and what sounds is carried forward in time order.

Starts of notes, and rests where a note ends before the voice's next one begins, are rows of (piece, slot); the grid is outer-joined with them and each voice
keeps its last value: one window by piece instead of an interval join. Notes come from a longer window of ``events`` (four slots a day, as many days
as there are) or from score files (two slots a quarter).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyvane.functions import cells as C
from polyvane.operators.counts import add_counts
from polyvane.operators.infer import add_cells
from polyvane.operators.polyphony import SLOTS, add_notes, add_slices
from polyvane.plans.dialect import Plan

#: Hours of a slot of the longer window.
HOURS = 6


def free_plan(scores: bool = False) -> Plan:
    """Notes, slices, phrases and cells on grids by piece; from {score_notes} (piece, voice, i, stop, midi) or from {events}."""
    plan = Plan()
    add_notes(plan)
    if scores:
        plan.add(every_note="""SELECT piece, voice, i, stop, midi, lead(midi) OVER (PARTITION BY piece, voice ORDER BY i) AS next_midi, lead(i) OVER (PARTITION BY piece, voice ORDER BY i) AS next_i FROM {score_notes} WHERE midi IS NOT NULL""",
                 spans="SELECT piece, max(stop) AS slots FROM {score_notes} GROUP BY piece")
    else:
        plan.add(snapped=plan.nodes["snapped"].replace("@HOURS(ts) / 24)", f"@HOURS(ts) / {HOURS})"),
                 every_note="""SELECT piece, voice, i, coalesce(next_i, upto) AS stop, midi, next_midi, next_i FROM (SELECT piece, voice, i, midi, max(i) OVER (PARTITION BY piece) + 1 AS upto,
                    lead(midi) OVER (PARTITION BY piece, voice ORDER BY i) AS next_midi, lead(i) OVER (PARTITION BY piece, voice ORDER BY i) AS next_i FROM
                    (SELECT *, row_number() OVER (PARTITION BY piece, voice, i ORDER BY ts DESC, event_id DESC) AS r FROM {snapped} WHERE i >= 0) s WHERE r = 1) q""",
                 spans="SELECT piece, max(stop) AS slots FROM {every_note} GROUP BY piece")
    carried = lambda v: f"CASE WHEN @LATEST(e.v{v}) OVER w >= 0 THEN @LATEST(e.v{v}) OVER w END AS m{v}"
    voices = [v.lower() for v in C.VOICES]
    plan.add(
        # what begins in a slot; -1 where a voice falls silent
        begins=f"""SELECT piece, i, {', '.join(f"max(CASE WHEN voice = '{v}' THEN midi END) AS v{v.lower()}, max(CASE WHEN voice = '{v}' THEN x ELSE 0 END) AS x{v.lower()}" for v in C.VOICES)} FROM
            (SELECT piece, voice, i, midi, 1 AS x FROM {{notes}} UNION ALL SELECT piece, voice, stop, -1, 0 FROM {{notes}} WHERE next_i IS NULL OR next_i > stop) s GROUP BY piece, i""",
        grid="SELECT t.piece, t.tonic, t.mode, g.slots, g.i FROM {tonic} t JOIN @UPTO(piece, slots; slots; {spans}) g ON g.piece = t.piece",
        raw_slices=f"""SELECT g.piece, g.i, g.tonic, g.mode, {', '.join(map(carried, voices))}, {', '.join(f'coalesce(e.x{v}, 0) AS x{v}' for v in voices)}, g.slots
            FROM {{grid}} g LEFT JOIN {{begins}} e ON e.piece = g.piece AND e.i = g.i WINDOW w AS (PARTITION BY g.piece ORDER BY g.i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    )
    add_slices(plan)
    add_counts(plan)
    add_cells(plan)
    plan.add(held=plan.nodes["held"].replace(f"i < {SLOTS - 1} ", "i < slots - 1 "),
             ends="SELECT t.piece, coalesce(max(b.i) * 500 + 10, max(s.slots - 1) * 500) AS end_ms FROM {tonic} t JOIN {spans} s ON s.piece = t.piece LEFT JOIN {beats} b ON b.piece = t.piece GROUP BY t.piece")
    return plan.add(query_long_slices="SELECT piece, i, tonic, mode, ms, ma, mt, mb, xs, xa, xt, xb, metric FROM {slices}", query_long_phrases="SELECT piece, ph, t0, t1, fin FROM {phrases}", query_long_real_counts="SELECT * FROM {cells_real}")


LONG_QUERIES = ("long_slices", "long_phrases", "long_real_counts")


def score_grid(notes: DataFrame) -> DataFrame:
    """(piece, voice, i, stop, midi) of score notes in quarters: slots of half a quarter, the first four parts as voices S, A, T, B; a rest is
    a null pitch. A note shorter than a slot holds the slot it begins in; of several in one slot the last counts."""
    from pyspark.sql import Window

    parts = notes.select("piece", "part").distinct().withColumn("k", F.row_number().over(Window.partitionBy("piece").orderBy("part")))
    named = parts.where("k <= 4").select("piece", "part", F.element_at(F.array(*map(F.lit, C.VOICES)), F.col("k")).alias("voice"))
    placed = notes.join(named, ["piece", "part"]).withColumn("i", F.floor(F.col("onset") * 2 + 1e-6).cast("int"))
    last = Window.partitionBy("piece", "voice", "i").orderBy(F.desc("onset"), F.desc("midi"))
    placed = placed.withColumn("r", F.row_number().over(last)).where("r = 1")
    return placed.select("piece", "voice", "i", F.greatest(F.ceil(F.col("offset") * 2 - 1e-6).cast("int"), F.col("i") + 1).alias("stop"), F.col("midi").cast("int").alias("midi"))


def score_cells(spark, notes: DataFrame) -> DataFrame:
    """(field, cell, n): the real cells of score files, notes as ``read_scores`` gives them."""
    return free_plan(scores=True).frame("query_long_real_counts", {"score_notes": score_grid(notes)}, spark)
