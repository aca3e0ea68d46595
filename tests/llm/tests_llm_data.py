"""Made-up texts for the tests."""

from pyspark.sql import functions as F


def prose(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}é" if r.random() < 0.1 else f"W{r.randrange(vocabulary)}" for _ in range(n))


def clashing(df):
    """Columns whose names operators use themselves."""
    for name in ("size", "shard", "slot", "id", "h1", "h2", "mark", "n", "target", "window", "key", "fp", "__id", "spans", "label", "c"):
        df = df.withColumn(name, F.lit("x"))
    return df
