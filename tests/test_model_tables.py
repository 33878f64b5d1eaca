from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from sensorloom.catalogue import c11_models
from sensorloom.catalogue.c06_features import KEYS, SPEC
from sensorloom.operators import features
from sensorloom.sources import warehouse as wh

LINES = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate date"


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("lines"))
    rows = [
        (n, 1, n % 7, n % 10, float(n * 7 % 50), float(n * 13 % 90), (n * 3 % 10) / 100, (n * 11 % 8) / 100, "ANR"[n * n % 7 % 3], date(2024, 1, 1) + timedelta(n))
        for n in range(300)
    ]
    spark.createDataFrame(rows, LINES).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def test_fits_write_the_columns_they_use_only(spark, lines, monkeypatch):
    written, write = {}, c11_models.stored

    def catch(rows, name):
        written[name] = set(rows.columns)
        return write(rows, name)

    monkeypatch.setattr(c11_models, "stored", catch)
    monkeypatch.setattr(c11_models.models, "train_boosted", lambda train, columns, settings: c11_models.models.train_logistic(train, columns, 1.0))
    expected = {"true_class", "label", "weight", *c11_models.RAW}
    for query in (c11_models.m01, c11_models.m02, c11_models.m05, c11_models.m06):
        written.clear()
        assert query(spark, lines).count() > 0
        assert written["train"] == expected and all(columns == expected for columns in written.values())


def test_features_beside_all_samples_equal_a_join(spark, lines):
    samples = wh.samples(spark, lines)
    more = [c for c in c11_models.GROUPS["D"] if c not in samples.columns]
    few = features.build_features(samples, SPEC, ["run_id"]).select(*KEYS, *more, "is_valid")
    joined = samples.join(few, KEYS, "left").select(*KEYS, *more, "is_valid")
    beside = features.build_features(samples, SPEC, ["run_id"], keep_warmup=True).select(*KEYS, *more, "is_valid")
    assert beside.count() == 300 and beside.filter(F.col("is_valid").isNull()).count() == 110
    assert beside.exceptAll(joined).count() == 0 and joined.exceptAll(beside).count() == 0
