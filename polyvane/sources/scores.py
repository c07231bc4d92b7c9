"""Scores: notes from and to a plain subset of MusicXML (parts, measures, notes, rests, ties, fermatas), and measures with ties.

A file is one row of text and is parsed in Arrow batches; a file that can't be read goes to the rejects with the reason. Times are quarters.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NOTES = "piece string, part int, onset double, offset double, midi int, tied boolean, fermata boolean"
#: Semitones of the note letters; names of the twelve pitch classes as letter and alteration.
STEPS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
SPELLED = (("C", 0), ("C", 1), ("D", 0), ("E", -1), ("E", 0), ("F", 0), ("F", 1), ("G", 0), ("A", -1), ("A", 0), ("B", -1), ("B", 0))


def parse_score(text: str) -> list[tuple]:
    """(part, onset, offset, midi or None for a rest, tied to the next, fermata); of a chord the highest note counts, notes without length don't."""
    out = []
    for number, part in enumerate(ET.fromstring(text).iter("part")):
        now, unit = Fraction(0), 1
        for measure in part.iter("measure"):
            for item in measure:
                if item.tag == "attributes" and item.findtext("divisions"):
                    unit = int(item.findtext("divisions"))
                elif item.tag in ("backup", "forward"):
                    now += Fraction(int(item.findtext("duration")), unit) * (-1 if item.tag == "backup" else 1)
                elif item.tag == "note" and item.find("grace") is None:
                    size, pitch = Fraction(int(item.findtext("duration")), unit), item.find("pitch")
                    midi = None if pitch is None else STEPS[pitch.findtext("step")] + int(float(pitch.findtext("alter") or 0)) + 12 * (int(pitch.findtext("octave")) + 1)
                    tied = any(t.get("type") == "start" for t in item.iter("tie"))
                    fermata = next(item.iter("fermata"), None) is not None
                    if item.find("chord") is not None and out:
                        p, a, b, m, t, f = out.pop()
                        out.append((p, a, b, max(x for x in (m, midi) if x is not None), t or tied, f or fermata))
                    elif size:
                        out.append((number, float(now), float(now + size), midi, tied, fermata))
                        now += size
    return out


def read_scores(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(notes, rejects) of the MusicXML files under a path."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for piece, text in zip(batch["piece"], batch["value"], strict=True):
                try:
                    rows += [(piece, *n, None) for n in parse_score(text)]
                except (ET.ParseError, ValueError, KeyError, TypeError) as e:
                    rows.append((piece, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["piece", "part", "onset", "offset", "midi", "tied", "fermata", "reason"]).astype({"part": "Int32", "midi": "Int32"})

    files = spark.read.option("wholetext", True).text(path).withColumn("piece", F.input_file_name())
    every = files.mapInPandas(parse, f"{NOTES}, reason string")
    return every.where("reason is null").drop("reason"), every.where("reason is not null").select("piece", "reason")


def clipped(notes: DataFrame) -> DataFrame:
    """Parts cut at the piece's common end, and their gaps filled with rests: every part then covers the same time."""
    end = notes.groupBy("piece", "part").agg(F.max("offset").alias("e")).groupBy("piece").agg(F.min("e").alias("end"))
    rows = notes.join(end, "piece").where("onset < end").withColumn("offset", F.least("offset", "end"))
    own = Window.partitionBy("piece", "part").orderBy("onset")
    gaps = rows.withColumn("from", F.coalesce(F.lag("offset").over(own), F.lit(0.0))).where("onset - `from` > 1e-6").select(
        "piece", "part", F.col("from").alias("onset"), F.col("onset").alias("offset"), F.lit(None).cast("int").alias("midi"), F.lit(False).alias("tied"), F.lit(False).alias("fermata"))
    return rows.drop("end").unionByName(gaps)


def measures(notes: DataFrame, length: float = 4.0) -> DataFrame:
    """Notes cut at bar lines: measure number, tied to the next piece of the same note, tied from the one before."""
    bars = F.sequence(F.floor(F.col("onset") / length), F.floor((F.col("offset") - 1e-9) / length))
    cut = notes.withColumn("measure", F.explode(bars)).withColumn("a", F.greatest("onset", F.col("measure") * length)).withColumn("b", F.least("offset", (F.col("measure") + 1) * length))
    rest = F.col("midi").isNull()
    return cut.select("piece", "part", "measure", F.col("a").alias("onset"), F.col("b").alias("offset"), "midi", ((F.col("b") < F.col("offset")) & ~rest | F.col("tied")).alias("tied"),
                      ((F.col("a") > F.col("onset")) & ~rest).alias("tied_from"), (F.col("fermata") & (F.col("b") == F.col("offset"))).alias("fermata"))


def render_scores(notes: DataFrame, length: float = 4.0, divisions: int = 96) -> DataFrame:
    """(piece, xml): a MusicXML text for each piece."""
    def render(rows: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for part, own in rows.sort_values(["part", "measure", "onset"]).groupby("part"):
            body = []
            for number, bar in own.groupby("measure"):
                xml = [f"<attributes><divisions>{divisions}</divisions></attributes>"] if not body else []
                for r in bar.itertuples():
                    if pd.isna(r.midi):
                        pitch = "<rest/>"
                    else:
                        step, alter = SPELLED[int(r.midi) % 12]
                        pitch = f"<pitch><step>{step}</step>" + (f"<alter>{alter}</alter>" if alter else "") + f"<octave>{int(r.midi) // 12 - 1}</octave></pitch>"
                    ties = '<tie type="stop"/>' * bool(r.tied_from) + '<tie type="start"/>' * bool(r.tied)
                    hold = "<notations><fermata/></notations>" * bool(r.fermata)
                    xml.append(f"<note>{pitch}<duration>{round((r.offset - r.onset) * divisions)}</duration>{ties}{hold}</note>")
                body.append(f'<measure number="{int(number) + 1}">{"".join(xml)}</measure>')
            parts.append(f'<part id="P{int(part) + 1}">{"".join(body)}</part>')
        names = "".join(f'<score-part id="P{k + 1}"><part-name>{k + 1}</part-name></score-part>' for k in range(len(parts)))
        return pd.DataFrame({"piece": [rows["piece"].iloc[0]], "xml": [f'<score-partwise version="3.1"><part-list>{names}</part-list>{"".join(parts)}</score-partwise>']})

    return measures(notes, length).groupBy("piece").applyInPandas(render, "piece string, xml string")


def write_scores(notes: DataFrame, path: str, **options) -> None:
    """One text file a partition row: each piece's MusicXML on a line of its own."""
    render_scores(notes, **options).select(F.concat(F.lit('<?xml version="1.0"?>'), "xml").alias("value")).write.text(path)
