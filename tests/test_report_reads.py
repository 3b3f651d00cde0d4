"""The report makes its titles once, whatever the number of its sections."""

import pytest
from pyspark.sql import functions as F

from salesprism import schema
from salesprism.plans import report
from salesprism.workload import pages, registry

TITLES = [
    (f"n{i}", f"p{i % 7}", f"g{i % 6}", 1995 + i % 6, "1990s" if i % 6 < 5 else "2000s", ("Low", "Mid", None)[i % 3],
     None if i % 4 == 0 else float(i % 10), None if i % 5 == 0 else float(i % 3 - 1), *[float(i % r) for r in (3, 5, 7, 2)], float(i % 11))
    for i in range(120)
]
SCHEMA = ", ".join(
    f"{c} {'int' if c == 'Year' else 'string' if c in ('Name', 'Publisher', 'Genre', 'Decade', 'Sales_Tier') else 'double'}" for c in pages.LINED
)


@pytest.mark.parametrize("name", ["report_table", "report_documents"])
def test_titles_are_made_once(spark, monkeypatch, name):
    made = spark.sparkContext.accumulator(0)

    def counted(x):
        made.add(1)
        return x

    t = spark.createDataFrame(TITLES, SCHEMA).coalesce(1)
    seen = t.withColumn("Global_Sales", F.udf(counted, "double")("Global_Sales"))
    monkeypatch.setattr(registry.view, "titles", lambda *_: seen)
    found = registry.QUERIES[name](spark, "").collect()
    assert made.value == len(TITLES)
    want = registry.rounded(report.report(t))
    if name == "report_table":
        assert sorted(map(str, found)) == sorted(map(str, want.collect()))
    else:
        labels = {}
        for r in sorted(want.collect(), key=lambda r: r["ord"]):
            labels.setdefault(r["section"], []).append(r["label"])
        assert {r["section"]: r["labels"] for r in found} == {s: "|".join(x) for s, x in labels.items()}


def test_the_report_reads_no_other_column(spark):
    t = spark.createDataFrame(TITLES, SCHEMA)
    assert set(pages.LINED) <= set(pages.REPORTED) and {*schema.REGIONS} < set(pages.LINED)
    assert report.report(t.limit(0)).count() > 0
