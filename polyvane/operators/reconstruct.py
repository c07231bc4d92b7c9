"""Reconstruction of each voice by a model of its own: onsets, phrases and key stay, pitches are drawn anew.

A voice's first note in a phrase is drawn from the pitches, relative to the tonic, that begin phrases in its mode; later ones by steps, given the degree they
leave, the metre and the place in the phrase, within the voice's range. A state seen fewer than LEAST times, or without a step inside the range, gives
way to the next wider one. No voice sees another. Catalogues are plain aggregations and number with the vocabulary (voices, modes, degrees,
places, steps): one row a voice, as maps, broadcast. A voice is a fold over its notes in order, in the JVM; draws are hashes of (seed, piece, voice, slot, copy).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyvane.functions import cells as C
from polyvane.plans.dialect import Plan

LEAST = 20
STATES = ("concat_ws('.', 'full', mode, degree, metre, place)", "concat_ws('.', 'metre', mode, degree, metre)", "concat_ws('.', 'degree', mode, degree)", "'any'")


def add_reconstruction(plan: Plan) -> None:
    notes = """SELECT n.piece, n.voice, n.i, n.stop, n.midi, t.tonic, t.mode, coalesce(max(f.ph), 1) AS ph FROM {notes} n JOIN {tonic} t ON t.piece = n.piece
        LEFT JOIN {phrases} f ON f.piece = n.piece AND f.t0 <= n.i * 500 GROUP BY n.piece, n.voice, n.i, n.stop, n.midi, t.tonic, t.mode"""
    plan.add(
        placed=f"""SELECT piece, voice, i, stop, midi, tonic, mode, ph, CASE WHEN j = 1 THEN 1 ELSE 0 END AS first, CASE WHEN j = n THEN 'final' WHEN j = n - 1 THEN 'penult' ELSE 'interior' END AS place,
            CASE WHEN i % 4 = 0 THEN 'strong' ELSE 'weak' END AS metre, before, {C.pmod('before - tonic')} AS degree FROM
            (SELECT *, row_number() OVER (PARTITION BY piece, voice, ph ORDER BY i) AS j, count(*) OVER (PARTITION BY piece, voice, ph) AS n, lag(midi) OVER (PARTITION BY piece, voice ORDER BY i) AS before FROM ({notes}) p) q""",
        recon_starts="SELECT voice, mode AS state, midi - tonic AS d, count(*) AS n FROM {placed} WHERE first = 1 GROUP BY voice, mode, midi - tonic UNION ALL SELECT voice, '*', midi - tonic, count(*) FROM {placed} WHERE first = 1 GROUP BY voice, midi - tonic",
        recon_steps=" UNION ALL ".join(f"SELECT voice, {s} AS state, midi - before AS d, count(*) AS n FROM {{placed}} WHERE first = 0 GROUP BY voice, {s}, midi - before" for s in STATES),
        recon_ranges="SELECT voice, min(midi) AS lo, max(midi) AS hi FROM {notes} GROUP BY voice",
    )


def _catalogue(rows: DataFrame, name: str) -> DataFrame:
    """(voice, map of state -> (value, number) in the order of values): one row a voice."""
    states = rows.groupBy("voice", "state").agg(F.array_sort(F.collect_list(F.struct(F.col("d").cast("int").alias("d"), F.col("n").cast("long").alias("n")))).alias("entries"))
    return states.groupBy("voice").agg(F.map_from_entries(F.collect_list(F.struct("state", "entries"))).alias(name))


def _bound(x: Column, use) -> Column:
    """use(x) with x computed once."""
    return F.transform(F.array(x), use)[0]


def _pick(entries: Column, low: Column, high: Column, least: int, u: Column) -> Column:
    """The value within [low, high] whose cumulated number is the first above u of all there, or null where the state is unknown, too rare or has none."""

    def choose(held: Column) -> Column:
        inside = F.filter(held, lambda x: (x["d"] >= low) & (x["d"] <= high))
        number = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x["n"])

        def by_weight(some: Column) -> Column:
            return _bound(u * number(some), lambda goal: F.aggregate(some, F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("int").alias("d")), lambda a, x: F.struct(
                (a["upto"] + x["n"]).alias("upto"), F.when(a["d"].isNull() & (a["upto"] + x["n"] > goal), x["d"]).otherwise(a["d"]).alias("d")))["d"])

        return F.when(number(held) >= least, _bound(inside, by_weight))

    return _bound(entries, choose)


def reconstruct(placed: DataFrame, starts: DataFrame, steps: DataFrame, ranges: DataFrame, copies: int = 1, seed: int = 0) -> DataFrame:
    """(piece, voice, copy, i, stop, midi): notes of the same onsets and ends with drawn pitches. A voice without a value within its range in any state is an error."""
    catalogue = _catalogue(starts, "first").join(_catalogue(steps, "then"), "voice", "left").join(ranges, "voice")
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"recon{seed}"), "piece", "voice", "i", "copy")), 1, 8), 16, 10).cast("double") / 4294967296.0
    drawn = placed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("u", u)
    voices = drawn.groupBy("piece", "voice", "copy", "tonic", "mode").agg(F.array_sort(F.collect_list(F.struct("i", "stop", "first", "metre", "place", "u"))).alias("notes"))
    voices = voices.join(F.broadcast(catalogue), "voice")  # a row a voice: values by states, a bounded vocabulary
    lo, hi, mode = F.col("lo"), F.col("hi"), F.col("mode")

    def note(held: Column, x: Column) -> Column:
        now, degree = held["now"], F.pmod(held["now"] - F.col("tonic"), F.lit(12)).cast("string")
        begin = lambda state, least: _pick(F.element_at("first", state), lo - F.col("tonic"), hi - F.col("tonic"), least, x["u"]) + F.col("tonic")
        move = lambda state, least: _pick(F.element_at("then", state), lo - now, hi - now, least, x["u"]) + now
        dotted = lambda *parts: F.concat_ws(".", *parts)
        states = (dotted(F.lit("full"), mode, degree, x["metre"], x["place"]), dotted(F.lit("metre"), mode, degree, x["metre"]), dotted(F.lit("degree"), mode, degree))
        none = F.raise_error(F.concat(F.lit("no value within the range of voice "), F.col("voice"))).cast("int")
        midi = F.when(x["first"] == 1, F.coalesce(begin(mode, LEAST), begin(F.lit("*"), 0), none)).otherwise(F.coalesce(*(move(s, LEAST) for s in states), move(F.lit("any"), 0), none)).cast("int")
        return _bound(midi, lambda m: F.struct(m.alias("now"), F.concat(held["out"], F.array(F.struct(x["i"].alias("i"), x["stop"].alias("stop"), m.alias("midi")))).alias("out")))

    start = F.struct(F.lit(0).alias("now"), F.array().cast("array<struct<i:int,stop:int,midi:int>>").alias("out"))
    made = voices.withColumn("made", F.aggregate("notes", start, note)["out"])
    return made.select("piece", "voice", "copy", F.explode("made").alias("x")).select("piece", "voice", "copy", "x.i", "x.stop", "x.midi")


def compliance(placed: DataFrame, made: DataFrame) -> DataFrame:
    """(voice, tvd): distance between the step distributions inside phrases of the corpus and of its reconstruction."""
    from pyspark.sql import Window

    own = Window.partitionBy("piece", "voice", "copy").orderBy("i")
    drawn = made.join(placed.select("piece", "voice", "i", "first"), ["piece", "voice", "i"]).withColumn("d", F.col("midi") - F.lag("midi").over(own)).where("first = 0")
    both = placed.where("first = 0").selectExpr("voice", "midi - before AS d", "0 AS side").unionByName(drawn.selectExpr("voice", "d", "1 AS side"))
    counts = both.groupBy("voice", "d").agg(F.sum(1 - F.col("side")).alias("x"), F.sum("side").alias("y"))
    total = Window.partitionBy("voice")
    share = lambda c: F.col(c) / F.sum(c).over(total)
    return counts.withColumn("gap", F.abs(share("x") - share("y"))).groupBy("voice").agg((F.sum("gap") / 2).alias("tvd"))
