"""T7 scaling check: the documents replicated x1 / x4 / x16 (ids re-keyed),
story postings computed and forced with the noop sink.  Prints one JSON line.

    python tools/scaling.py [sf_dir] [cpus]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    cpus = sys.argv[2] if len(sys.argv) > 2 else "8"
    from trendloom.operators.matching import story_postings
    from trendloom.plans import fixtures as fx
    from trendloom.session import build_session

    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                          conf={"spark.driver.memory": "16g"})
    from trendloom.operators.partitioning import spread
    docs = fx.read(spark, sf_dir, "documents")
    out = {}
    for k in (1, 4, 16):
        rep = (docs.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_copy"))
               .withColumn("doc_id", F.col("doc_id") * k + F.col("_copy")).drop("_copy"))
        stories = fx.doc_stories_of(spread(rep, "doc_id"))
        facts = story_postings(stories, fx.doc_dictionary())
        facts.write.format("noop").mode("overwrite").save()  # warm
        t0 = time.perf_counter()
        facts.write.format("noop").mode("overwrite").save()
        out[f"x{k}"] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "t7_scaling", "unit": "sec", "docs": docs.count(), "times": out}))
    spark.stop()


if __name__ == "__main__":
    main()
