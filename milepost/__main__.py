"""Command line: the training program and the two service calls as batch jobs.

python -m milepost train    --sources DIR --master DIR --models DIR [--records FILE]
python -m milepost forecast --master DIR --models DIR --out DIR
python -m milepost snapshot --forecast DIR --models DIR --dates 31-12-2027 [...] [--out DIR]
python -m milepost predict  --requests PATH --models DIR --out DIR [--as-of 2025-01-01]

``--sources`` holds one parquet folder per source table (see ``sources/tables.py``);
``--requests`` is JSON lines ``{"request_id": ..., "body": "{...}"}``.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


def _spark() -> SparkSession:
    from .session import JOB_CONF
    b = SparkSession.builder.appName("milepost")
    for k, v in JOB_CONF.items():
        b = b.config(k, v)
    return b.getOrCreate()


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="milepost")
    sub = p.add_subparsers(dest="cmd", required=True)
    t = sub.add_parser("train")
    t.add_argument("--sources", required=True)
    t.add_argument("--master", required=True)
    t.add_argument("--models", required=True)
    t.add_argument("--records", help="live digitalization payload (JSON)")
    t.add_argument("--with-objections", action="store_true")
    f = sub.add_parser("forecast")
    f.add_argument("--master", required=True)
    f.add_argument("--models", required=True)
    f.add_argument("--out", required=True)
    s = sub.add_parser("snapshot")
    s.add_argument("--forecast", required=True)
    s.add_argument("--models", required=True)
    s.add_argument("--dates", nargs="+", required=True)
    s.add_argument("--out")
    r = sub.add_parser("predict")
    r.add_argument("--requests", required=True)
    r.add_argument("--models", required=True)
    r.add_argument("--out", required=True)
    r.add_argument("--as-of")
    a = p.parse_args(argv)

    spark = _spark()
    from .plans import jobs
    if a.cmd == "train":
        from .operators.digitalization import read_records
        from .sources.tables import read_parquet_tables
        report = jobs.train_job(spark, read_parquet_tables(spark, a.sources), a.master, a.models,
                                with_objections=a.with_objections,
                                records=read_records(spark, a.records) if a.records else None)
        for row in report.collect():                               # six rows
            print(json.dumps(row.asDict()))
    elif a.cmd == "forecast":
        jobs.forecast_job(spark, a.master, a.models, a.out)
        print(json.dumps({"forecast": a.out, "published": True}))
    elif a.cmd == "snapshot":
        from .operators.models import ModelSet
        from .plans.service import pipeline_snapshot
        texts = spark.createDataFrame([(d,) for d in a.dates], "target_date string")
        out = pipeline_snapshot(None, texts, ModelSet.load(spark, a.models),
                                counts=jobs.stored_counts(spark, a.forecast))
        if a.out:
            out.write.mode("overwrite").json(a.out)
        else:
            for row in out.collect():                              # one row per given date
                print(row["response"])
    elif a.cmd == "predict":
        from .operators.models import ModelSet
        from .plans.service import predict_stages
        req = spark.read.schema("request_id long, body string").json(a.requests)
        predict_stages(req, ModelSet.load(spark, a.models), a.as_of) \
            .write.mode("overwrite").json(a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
