import pandas as pd


def at(text: str) -> pd.Timestamp:
    return pd.Timestamp("2026-04-06 " + text)


def frame(spark, rows, schema):
    if not isinstance(rows, pd.DataFrame):
        rows = [tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in r) for r in rows]
    return spark.createDataFrame(rows, schema)


def rows(df, *order):
    pdf = df.toPandas()
    return pdf.sort_values(list(order)).reset_index(drop=True) if order else pdf


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
