"""Sources, sinks and the streaming form of counts."""

import json

from polyvane.plans.queries import queries
from polyvane.sources.tables import NOTES, hash_split, merge_ties, read_notes, read_ratings, stratified_split, write_rules
from polyvane.streaming.counts import running_counts

SF = "/root/testdata/sf0.001"


def test_notes(spark, tmp_path):
    rows = [(1, v, 0.0, 1.0, 60, True, False) for v in "SATB"] + [(1, "S", 1.0, 2.0, 60, False, True), (1, "S", 2.0, 3.0, 62, False, False), (2, "S", 0.0, 1.0, 60, False, False), (1, "S", 5.0, 5.0, 60, False, False)]
    spark.createDataFrame(rows, NOTES).write.parquet(f"{tmp_path}/notes")
    notes, rejects = read_notes(spark, f"{tmp_path}/notes", transpose=2)
    assert {r.piece for r in rejects.collect()} == {2}
    s = sorted((r.onset, r.offset, r.midi, r.fermata) for r in merge_ties(notes).where("voice = 'S'").collect())
    assert s == [(0.0, 2.0, 62, True), (2.0, 3.0, 64, False)]


def test_splits(spark):
    pieces = spark.range(50).withColumnRenamed("id", "piece")
    split = hash_split(pieces, {"train": 16, "hold": 20}).collect()
    assert len({r.piece for r in split}) == 36 and sum(r.set_name == "train" for r in split) == 16
    kinds = spark.createDataFrame([(k % 3, k) for k in range(31)], "kind int, piece int")
    held = stratified_split(kinds, "kind", "piece", 0.3).groupBy("kind").agg({"held": "count"}).count()
    assert held == 3 and stratified_split(kinds, "kind", "piece", 0.3).where("held").count() == 9


def test_ratings_and_rules(spark, tmp_path):
    (tmp_path / "r.csv").write_text("rater,item,category\na,1,good\na,2,\n")
    assert {(r.item, r.category) for r in read_ratings(spark, str(tmp_path / "r.csv")).collect()} == {("1", "good"), ("2", "cannot judge")}
    write_rules(spark.createDataFrame([("Q", "b=7|sop=2/to/b=0|sop=0|slot=fin", "over")], "field string, cell string, polarity string"), f"{tmp_path}/rules")
    text = "".join(x.read_text() for x in (tmp_path / "rules").glob("part-*.json"))
    assert json.loads(text)["condition"] == {"0:b": "7", "1:sop": "2", "2:b": "0", "3:sop": "0", "4:slot": "fin"}


def test_stream_equals_table(spark, tmp_path):
    slices = queries()["slices"](spark, SF)
    slices.repartition(3).write.parquet(f"{tmp_path}/slices")
    stream = spark.readStream.schema(slices.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/slices")
    run = running_counts(stream).writeStream.outputMode("complete").format("memory").queryName("totals").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination(120)
    want = {(r.field, r.cell, r.n) for r in running_counts(slices).collect()}
    assert {(r.field, r.cell, r.n) for r in spark.table("totals").collect()} == want
    assert {(r.cell, r.n) for r in queries()["real_h"](spark, SF).collect()} == {(c, n) for f, c, n in want if f == "H"}
