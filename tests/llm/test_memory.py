"""What a step made an executor take goes back before the next one."""

import importlib.util
import os
import subprocess
import sys
from pathlib import Path

_RUN = """
import re, time
from pathlib import Path
import psutil
from pyspark.sql import SparkSession
from tessera.llm.common import released

def heap():
    p = next(p for p in psutil.Process().children(recursive=True) if "CoarseGrainedExecutorBackend" in " ".join(p.cmdline()))
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", Path(f"/proc/{p.pid}/smaps_rollup").read_text()))) // 1024

conf = {"spark.executor.memory": "1200m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.executor.extraJavaOptions": "-XX:ActiveProcessorCount=2"}
spark = SparkSession.builder.master("local-cluster[1,2,1500]").config(map=conf).getOrCreate()
spark.range(0, 2000000, 1, 2).selectExpr("id % 4 AS k", "repeat(cast(id AS string), 9) AS t").groupBy("k").agg({"t": "collect_list"}).selectExpr("size(`collect_list(t)`)").collect()
before = heap()
released(spark)
time.sleep(3)  # the JVM gives memory back in the background
print("HEAP", before, heap())
spark.stop()
"""


def test_executors_give_their_heap_back(tmp_path):
    home = Path(importlib.util.find_spec("pyspark").origin).parent
    (tmp_path / "home/work").mkdir(parents=True)
    for p in home.iterdir():  # executors log to work in Spark's home
        if p.name != "work":
            (tmp_path / "home" / p.name).symlink_to(p)
    root = str(Path(__file__).parents[2])
    env = os.environ | {"SPARK_HOME": str(tmp_path / "home"), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": str(tmp_path), "PYTHONPATH": root, "PYSPARK_PYTHON": sys.executable}
    env.pop("PYSPARK_GATEWAY_PORT", None)
    got = subprocess.run([sys.executable, "-c", _RUN], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=180)
    assert "HEAP" in got.stdout, got.stderr[-800:]
    before, after = map(int, got.stdout.split("HEAP")[1].split()[:2])
    assert after < 0.7 * before, (before, after)
