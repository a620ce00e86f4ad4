"""What keeps a query's time in step with its tables."""

import glob
import os

from pyspark.sql import functions as F

SF = os.environ.get("TREMOR_TEST_SF", "/root/testdata/sf0.001")


def linked(folder, without):
    """The smallest tables under a folder of their own, without one of them."""
    for name in os.listdir(SF):
        if name != without:
            os.symlink(f"{SF}/{name}", f"{folder}/{name}")


def test_parts_of_the_maintained_scores_land_by_all_tasks(spark, folder, monkeypatch):
    """Each part lands in as many files as tasks read the events and is one
    batch; the scores are those of the batch job."""
    from tremor.plans import q_streaming as Q

    linked(folder, "events.parquet")
    spark.read.parquet(f"{SF}/events.parquet").repartition(4).write.parquet(f"{folder}/events.parquet")
    landing, landed = Q.ST.landing, []
    monkeypatch.setattr(Q.ST, "landing", lambda s, place, *a, **k: landed.append(place) or landing(s, place, *a, **k))

    f = Q.Fixture(spark, folder)
    got = Q._maintained(f).scores.read()
    assert len(glob.glob(f"{landed[0]}/*.parquet")) == 4 * Q.PARTS
    batches = [b for b in os.listdir(os.path.dirname(landed[0]) + "/checkpoint/commits") if b.isdigit()]
    assert len(batches) == Q.PARTS
    digits = lambda t: sorted(t.select("ticker", "date", F.round("score", 8), "n_clusters").collect())
    assert digits(got) == digits(f.daily)


def test_classifier_reads_stored_counts_not_texts(spark, monkeypatch):
    """Each text meets the keyword walk and the tokenizer once, however often
    the split and the fit pass over the rows."""
    from tremor.plans import q_evaluation as Q
    from tremor.plans.fixtures import Fixture

    seen = {}

    def watch(name):
        whole = getattr(Q.C, name)
        monkeypatch.setattr(Q.C, name, lambda rows, *a, **k: seen.setdefault(name, rows) is not None and whole(rows, *a, **k))

    watch("stratified_split")
    watch("fit_classifier")
    out = Q.n11(Fixture(spark, SF))
    assert out.where("beats_majority").count() == out.count() > 1
    assert set(seen) == {"stratified_split", "fit_classifier"}
    for rows in seen.values():
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "EvalPython" not in plan and "UDF" not in plan and "text" not in rows.columns


def test_hashed_counts_hold_every_token(spark):
    from tremor.functions import text as TX
    from tremor.operators import corpus as C

    docs = spark.createDataFrame([(1, "It's a b, A b-c 7"), (2, "")], "id int, text string")
    got = C.hashed_counts(docs, "text").select("id", F.size(TX.tokenize("text")).alias("n"), "features").collect()
    assert {r["id"]: (r["n"], int(r["features"].values.sum())) for r in got} == {1: (7, 7), 2: (0, 0)}
    one = next(r for r in got if r["id"] == 1)["features"]
    assert one.size == 1 << 16 and sorted(one.values) == [1, 1, 1, 2, 2]
