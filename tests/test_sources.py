import pytest

from tessera.sources import io
from tessera.sources.contracts import Col, Contract, ContractError

PANEL = Contract(
    "panel",
    [Col("id", "int"), Col("month", "string", pattern=r"\d{4}-\d{2}"), Col("cat", "string", values=["a", "b"], ordered=True), Col("share", "double", nullable=True, low=0, high=1)],
    key=["id", "month", "cat"],
    checks={"positive id": "id > 0"},
)


def rows(spark, *data):
    return spark.createDataFrame(list(data), "id int, month string, cat string, share double")


def test_valid_table_round_trip(spark, tmp_path):
    df = rows(spark, (1, "2024-01", "a", 0.5), (1, "2024-01", "b", None), (2, "2024-02", "a", 1.0 + 1e-10))
    io.write_table(df, str(tmp_path / "t"), PANEL)
    back = io.read_table(spark, str(tmp_path / "t"), PANEL)
    assert back.columns == ["id", "month", "cat", "share"] and back.count() == 3


def test_all_violations_in_one_error(spark):
    df = rows(spark, (0, "2024-1", "c", 2.0), (0, "2024-1", "c", 2.0), (None, "2024-01", "a", -1.0))
    with pytest.raises(ContractError) as e:
        PANEL.validate(df)
    text = str(e.value)
    for part in ("id: null in 1", "month: no match in 2", "cat: not allowed in 2", "share: above 1 in 2", "share: below 0 in 1", "rule positive id in 3", "repeat"):
        assert part in text
    assert any("missing" in v for v in PANEL.violations(df.drop("cat")))
    assert any("instead of" in v for v in PANEL.violations(df.withColumn("id", df.id.cast("long"))))


def test_strict_csv_and_digest(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a;b;c\n1;ND;x\n;2;y\n")
    df = io.read_strict_csv(spark, str(tmp_path / "x.csv"), ["a", "b"], null_codes=["ND"])
    assert sorted(map(tuple, df.collect()), key=repr) == [("1", None), (None, "2")]
    a, b = (io.content_digest(d).first() for d in (df, df.repartition(3)))
    assert a == b
    assert io.checksums(spark, str(tmp_path / "x.csv")).count() == 1


def test_controls(spark):
    df = spark.range(100).toDF("x")
    got = {r.name: r.ok for r in io.controls(df, {"n": ("count(*)", 100, "hard"), "s": ("sum(x)", 4951, "soft"), "m": ("max(x)", 98, "hard"), "i": ("min(x)", 5, "info")}).collect()}
    assert got == {"n": True, "s": True, "m": False, "i": True}
