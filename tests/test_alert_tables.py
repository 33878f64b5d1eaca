"""A search makes the table of each policy once, and its rows are numbered once."""

from sensorloom.functions import hysteresis as hy
from sensorloom.operators import alerts


def test_tables_of_a_policy_are_made_once_in_a_process(monkeypatch):
    made, make = [], hy.Table.__init__
    monkeypatch.setattr(hy.Table, "__init__", lambda self, *args: (made.append(args), make(self, *args))[1])
    policies = [hy.Policy(0.31, n, 0.29, 2) for n in (2, 3)]
    rows = [(0, True, False, True), (0, True, False, True), (1, False, True, True)]
    for _ in range(5):
        for policy in policies:
            hy.block_transfer(rows, 3, 1, policy)
            alerts._marks(3, 1, policy)
    assert len(made) == 2


def test_the_cohorts_are_numbered_once_for_two_evaluations(spark, tmp_path, monkeypatch):
    from sensorloom.catalogue import load

    load()  # relations of one module build on those of others
    from sensorloom.catalogue import c09_cohorts

    seen, number = [], c09_cohorts.cohort_rows
    monkeypatch.setattr(c09_cohorts, "cohort_rows", lambda *args: (seen.append(args), number(*args))[1])
    line = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp_ntz"
    rows = spark.range(600).selectExpr(
        "id l_orderkey", "1 l_linenumber", "1L l_partkey", "id % 12 l_suppkey", "double(id % 50) l_quantity", "double(id) l_extendedprice",
        "double(id % 7) / 100 l_discount", "double(id % 5) / 100 l_tax", "element_at(array('A', 'N', 'R'), int(id % 3 + 1)) l_returnflag",
        "timestamp_ntz'2020-01-01' + make_dt_interval(int(id)) l_shipdate",
    )
    assert set(rows.columns) == {part.split()[0] for part in line.split(", ")}
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(12).selectExpr("id s_suppkey", "'s' s_name", "1 s_nationkey", "double(id) s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    found = {(r["cohort"], r["metric"]) for r in c09_cohorts.j13(spark, str(tmp_path)).collect()}
    assert len(found) == 6 * len(c09_cohorts.COMPARED) and len(seen) == 1
