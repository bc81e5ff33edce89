"""Times the headline queries; prints one JSON line."""

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from avrospark.functions import avro_decode, avro_encode
from avrospark.schema import from_spark_type
from avrospark.sources import read_avro, write_avro

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HERE = os.path.dirname(os.path.abspath(__file__))


def main() -> None:
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [HERE, os.environ.get("PYTHONPATH")]))
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    work = tempfile.mkdtemp()
    df = spark.read.parquet(f"{SF}/lineitem.parquet").repartition(int(CPUS)).cache()
    rows, schema = df.count(), from_spark_type(df.schema)
    encoded = df.select(avro_encode(F.struct(*df.columns), schema).alias("m")).cache()
    encoded.count()
    pruned = {"type": "record", "name": "topLevelRecord", "fields": [{"name": "l_quantity", "type": ["null", "double"]}, {"name": "l_returnflag", "type": ["null", "string"]}]}
    done = lambda frame: frame.write.format("noop").mode("overwrite").save()
    jobs = {
        "encode": lambda: done(df.select(avro_encode(F.struct(*df.columns), schema).alias("m"))),
        "decode": lambda: done(encoded.select(avro_decode(F.col("m"), schema).alias("r"))),
        "decode_pruned": lambda: done(encoded.select(avro_decode(F.col("m"), schema, pruned).alias("r"))),
    }
    for codec in ("null", "deflate", "snappy", "zstandard"):
        jobs[f"write_{codec}"] = lambda c=codec: write_avro(df, f"{work}/{c}", mode="overwrite", codec=c)
        jobs[f"read_{codec}"] = lambda c=codec: done(read_avro(spark, f"{work}/{c}"))
    jobs["flagship_q1"] = lambda: read_avro(spark, f"{work}/zstandard", {**pruned, "fields": [*pruned["fields"], {"name": "l_linestatus", "type": ["null", "string"]}]}).groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity"), F.count("*")).collect()
    times = {}
    for name, job in jobs.items():
        best = []
        for _ in range(2):
            at = time.time()
            job()
            best.append(time.time() - at)
        times[name] = round(min(best), 3)
    print(json.dumps({"metric": f"avro on lineitem, {rows} rows, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF, "rows": rows, "records_per_second": {k: round(rows / v) for k, v in times.items()}}))
    shutil.rmtree(work, ignore_errors=True)
    spark.stop()


if __name__ == "__main__":
    main()
