"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Rates are measured on generated messages: rows a second of decoding alone, appending, watermark dedup, insert-only merge,
mirror merge and compaction. BENCH_ROWS sets how many (200,000 unless set).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from datetime import datetime

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ROWS = int(os.environ.get("BENCH_ROWS", 200_000))
HEADLINE = [
    "cdc_latest_change", "cdc_mirror_merge", "cow_merge", "mor_merge", "incremental_mirror", "cdc_parse_csv", "merge_insert_only", "affected_partitions", "partition_overwrite_dedup",
    "incremental_append", "rewrite_data_files", "bulk_append", "stream_dedup", "stream_merge", "stream_append", "proto_flatten", "avro_flatten", "json_decode", "orders_latest_status", "partition_transforms",
]


def rates(spark, folder: str) -> dict[str, float]:
    from pyspark.sql import functions as F

    from sluice.operators.maintenance import rewrite_data_files
    from sluice.plans.cdc import mirror_changes
    from sluice.plans.ingest import decode, employee_table
    from sluice.plans.queries import proto_value
    from sluice.schemas import MIRROR, MIRROR_SPEC
    from sluice.sources.generate import account_changes, employees
    from sluice.sources.log import append_messages, read_batch, read_stream
    from sluice.sources.snapshot_table import SnapshotTable
    from sluice.streaming.jobs import append_stream, merge_new, watermark_ingest

    now, out = datetime(2024, 1, 30, 12), {}

    def rate(name: str, job) -> None:
        began = time.time()
        job()
        out[name] = round(ROWS / (time.time() - began))
        print(name, out[name], "rows a second", file=sys.stderr, flush=True)

    log = f"{folder}/log"
    append_messages(employees(spark, ROWS, now), log, topic="employees", value=proto_value())
    decoded = lambda: decode(read_batch(spark, log), "protobuf")
    stream = lambda: decode(read_stream(spark, log), "protobuf")
    table = lambda name: employee_table(spark, f"{folder}/{name}", ["bucket(8, employee_id)"])
    rate("decode", lambda: decoded().write.format("noop").mode("overwrite").save())
    rate("append", lambda: append_stream(stream(), table("append"), name="append", checkpoint=f"{folder}/c1").awaitTermination())
    rate("watermark_dedup", lambda: watermark_ingest(stream(), table("dedup"), name="dedup", checkpoint=f"{folder}/c2").awaitTermination())
    recent = F.col("start_date") > F.lit(now) - F.expr("INTERVAL 1 HOUR")
    rate("insert_only_merge", lambda: merge_new(table("append"), decoded(), ["employee_id", "start_date"], target_filter=recent))
    mirror = SnapshotTable.create(spark, f"{folder}/mirror", MIRROR, MIRROR_SPEC)
    rate("mirror_merge", lambda: mirror_changes(account_changes(spark, ROWS, now, operations=("U", "I", "D")), mirror))
    table("append").append(decoded())
    rate("compaction", lambda: rewrite_data_files(table("append"), ["start_date"]))
    return out


def main() -> None:
    from sluice.plans.queries import QUERIES
    from sluice.session import Settings, session

    extra = {"spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"}
    spark = session(Settings(app="bench", master=f"local[{CPUS}]", shuffle_partitions=int(CPUS), extra=extra))
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    measured = rates(spark, tempfile.mkdtemp(prefix="spark-bench-"))
    line = {"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}
    print(json.dumps(line | {"cores": int(CPUS), "rows": ROWS, "rows_per_sec": measured}))
    spark.stop()


if __name__ == "__main__":
    main()
