"""Executors of their own give the heap back that finished queries have left; the driver's JVM, its freed native memory too."""

import importlib.util
import os
import subprocess
import sys
from pathlib import Path

import pytest

CHILD = """
import time
import psutil
from pyspark.sql import SparkSession, functions as F
from tessaria.llm.common import release

conf = {"spark.master": "local-cluster[1,1,1100]", "spark.executor.memory": "1000m", "spark.ui.enabled": "false",
        "spark.driver.host": "127.0.0.1", "spark.executor.extraJavaOptions": "-XX:+UseG1GC"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
rows = spark.range(0, 3_000_000, 1, 1).repartition(1).selectExpr("count(distinct repeat(cast(id as string), 9))").first()[0]
assert rows == 3_000_000
own = [p for p in psutil.Process().children(recursive=True) if "CoarseGrainedExecutorBackend" in " ".join(p.cmdline())]
size = lambda: sum(p.memory_info().rss for p in own) / 1e6
before = size()
release(spark)
end = time.time() + 10
while size() > before - 150 and time.time() < end:
    time.sleep(0.2)
print("MB", len(own), before, size(), flush=True)
spark.stop()
"""


def test_executors_give_their_heap_back(tmp_path):
    pytest.importorskip("psutil")
    (tmp_path / "home/work").mkdir(parents=True)
    for p in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():  # executors' logs go to work in Spark's home
        if p.name != "work":
            (tmp_path / "home" / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(tmp_path / "home"), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYTHONPATH": str(Path(__file__).resolve().parents[2])}
    for name in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET", "PYSPARK_SUBMIT_ARGS"):
        env.pop(name, None)
    run = subprocess.run([sys.executable, "-c", CHILD], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=120)
    line = next((x for x in run.stdout.splitlines() if x.startswith("MB")), None)
    assert line, run.stderr[-2000:]
    n, before, after = map(float, line.split()[1:])
    assert n == 1 and before - after >= 150, line


@pytest.mark.parametrize("way", ["release", "materialize"])
def test_driver_gives_native_memory_back(spark, way):
    psutil = pytest.importorskip("psutil")
    from tessaria.llm.common import materialize, release

    jvm = spark.sparkContext._jvm
    own = next(p for p in psutil.Process().children(recursive=True) if "SparkSubmit" in " ".join(p.cmdline()))
    materialize(spark.range(3), "warm")
    field = jvm.Class.forName("sun.misc.Unsafe").getDeclaredField("theUnsafe")
    field.setAccessible(True)
    native = field.get(None)
    blocks = [native.allocateMemory(100_000) for _ in range(3000)]
    for x in blocks:
        native.setMemory(x, 100_000, 1)
    full = own.memory_info().rss / 1e6
    for k, x in enumerate(blocks):
        if k % 50:  # the others keep glibc from giving back what is freed between them
            native.freeMemory(x)
    kept = own.memory_info().rss / 1e6
    release(spark) if way == "release" else materialize(spark.range(3), "trimmed")
    after = own.memory_info().rss / 1e6
    for x in blocks[::50]:
        native.freeMemory(x)
    assert kept - after >= 120, (full, kept, after)
