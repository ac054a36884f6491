"""The rows that feature selection looks at."""

from pyspark.sql import functions as F

from granary.operators import select


def test_subset_does_not_depend_on_partitions(spark, monkeypatch):
    kept, real = [], select.written
    monkeypatch.setattr(select, "written", lambda rows: kept.append(real(rows)) or kept[-1])
    rows = spark.range(4000).select(F.col("id").alias("k"), F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("y"))
    for parts in (1, 7):
        select.FeatureSelector(min_features_to_select=1, subset_size_mb=0.016).fit_transform(rows.repartition(parts), "y", "k")
    one, other = (sorted(r.a for r in k.collect()) for k in kept)
    assert one == other and 1800 < len(one) < 2200
