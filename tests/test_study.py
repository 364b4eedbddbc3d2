"""The study end to end on the smallest given tables."""

import os
from datetime import date

import pytest

from ledgerloom.plans.study import StudyOptions, customer_study, write_study
from ledgerloom.sources.adapters import view

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_study_writes_every_table(spark, tmp_path):
    options = StudyOptions(
        ks=(2, 3, 4),
        starts=1,
        frequency_limit=15,
        monetary_limit=1_200_000.0,
        density_eps=0.5,
        validation=(date(2000, 8, 14), date(2000, 8, 20)),
    )
    study = customer_study(view(spark, FOLDER, "transactions"), options)
    write_study(study, str(tmp_path / "out"))
    names = {path.name for path in (tmp_path / "out").iterdir()}
    assert names == set(study) and len(names) >= 28
    best = spark.read.option("header", True).csv(str(tmp_path / "out" / "rfm_clusters_best"))
    assert sum(float(r.Percentage) for r in best.collect()) == pytest.approx(100, abs=0.05)
    assert study["forecast_comparison"].count() == 7
    assert study["validation_metrics"].first().ValidationPeriod == "2000-08-14 to 2000-08-20"
