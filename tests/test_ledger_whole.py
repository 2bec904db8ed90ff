"""Every run of the query is finished, and the log picks the folders of a table."""

import datetime as dt

from pyspark.sql import functions as F

from pixelweft.operators import ledger
from pixelweft.plans import prepared
from tests.test_analysis import _created, _results

DATA = "/root/testdata/sf0.001"


def test_no_run_is_left_open(spark):
    """Before, seven of eight runs were created and never finished."""
    n = spark.read.parquet(f"{DATA}/orders.parquet").count()
    states = {r["status"]: r["count"] for r in prepared.run_documents(spark, DATA).groupBy("status").count().collect()}
    assert set(states) == {"complete", "failed"} and sum(states.values()) == n


def test_the_log_picks_folders(spark, tmp_path, monkeypatch):
    """The rows of a finish have one batch: a join on it would put them in one task."""
    folder = str(tmp_path / "ledger")
    _created(spark, folder, ["a", "b", "c"])
    assert ledger.read(spark, folder, "observations").count() == 0 and ledger.read(spark, folder, "runs").count() == 3
    ledger.finish_runs(_results(spark, ["a"]), folder)
    ledger.finish_runs(_results(spark, ["b"]), folder)
    ledger.append(ledger.results_tables(_results(spark, ["c"]))["observations"], folder, "observations", "bcrashed")
    for name, n in (("observations", 2), ("artifacts", 4), ("runs", 5)):
        short = ledger.read(spark, folder, name)
        assert "Join" not in short._jdf.queryExecution().executedPlan().toString(), name
        with monkeypatch.context() as m:
            m.setattr(ledger, "ENTRIES", 1)
            long = ledger.read(spark, folder, name)
        assert "Join" in long._jdf.queryExecution().executedPlan().toString(), name
        rows = sorted(map(str, short.collect()))
        assert len(rows) == n and rows == sorted(map(str, long.collect())), name
    assert ledger.latest(ledger.read(spark, folder, "runs")).where(F.col("finished_at") == dt.datetime(2024, 6, 1)).count() == 2
