"""python -m rillwood FILE TARGET [--categoric A,B] [--trees N] [--depth N]: a forest from a CSV file, and its accuracy."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rillwood.operators.profile import CATEGORIC, NUMERIC
from rillwood.plans.estimator import learner_for, make_learner
from rillwood.sources.files import read_csv


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("file")
    p.add_argument("target")
    p.add_argument("--categoric", default="")
    p.add_argument("--trees", type=int, default=10)
    p.add_argument("--depth", type=int, default=10)
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    df = read_csv(spark, a.file, {c: CATEGORIC for c in a.categoric.split(",") if c})
    types = {f.name: f.metadata["attribute_type"] for f in df.schema}
    df = df.withColumn("_row", F.monotonically_increasing_id())
    features = [c for c in types if c != a.target]
    learner = make_learner(learner_for(types[a.target]), trees=a.trees, depth=a.depth)
    learner.fit(df, "_row", [c for c in features if types[c] == NUMERIC], [c for c in features if types[c] != NUMERIC], a.target)
    out = {"rows": df.count(), "types": types, "stats": learner.stats(df).first().asDict(), "importances": [r.asDict() for r in learner.importances(10).collect()]}
    print(json.dumps(out))
    return out


if __name__ == "__main__":
    main()
