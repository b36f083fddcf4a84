"""Work folders: long runs cut into slices that are committed one by one.

A folder holds a manifest (what the run is), a table of inputs cut into slices, and a
table of outputs with one folder a slice. A slice is committed when Spark's writer has
put its success file there; a run that starts again on the same folder leaves committed
slices alone and overwrites what an interrupted one left. Slices are jobs of their own,
several in flight at a time, so a slow one holds up nothing but itself.
"""

from __future__ import annotations

import hashlib
import json
import logging
import threading
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from typing import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

log = logging.getLogger("tessera")

SUCCESS = "_SUCCESS"


def input_digest(spark: SparkSession, path: str) -> str:
    """Digest of the names, sizes and times of the input's files."""
    try:
        found = spark.read.format("binaryFile").load(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc):
            raise FileNotFoundError(f"{path}: nothing to read there") from exc
        raise
    files = found.select(
        F.col("_metadata.file_path").alias("f"), "length", F.col("modificationTime").cast("double").alias("t"))
    # One number for each file, added up: order and number of files don't matter.
    one = F.conv(F.substring(F.md5(F.concat_ws("|", "f", "length", "t").cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    told = files.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("size"), F.sum(one).alias("sum")).first()
    return hashlib.sha256(f"{told['n']}|{told['size']}|{told['sum']}".encode()).hexdigest()


class WorkDir:
    """A run's folder on a file system that Spark reaches. ``manifest`` says what the run
    is; a folder of another run is refused."""

    def __init__(self, spark: SparkSession, path: str | None, name: str, manifest: dict):
        self.spark = spark
        self.root = (path or scratch_path(spark, name)).rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        told = json.loads(json.dumps({"run": name, **manifest}, sort_keys=True, default=repr))
        known = self._read("manifest.json")
        if known is None:
            self._write("manifest.json", json.dumps(told, sort_keys=True))
        elif json.loads(known) != told:
            differ = sorted(k for k in told.keys() | json.loads(known).keys() if told.get(k) != json.loads(known).get(k))
            raise ValueError(f"{self.root} belongs to another run; these differ: {', '.join(differ)}")

    def path(self, *names) -> str:
        return "/".join([self.root, *map(str, names)])

    def _read(self, name: str) -> str | None:
        where = self._path(self.path(name))
        if not self._fs.exists(where):
            return None
        stream = self._fs.open(where)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        """A small file that is there whole or not at all."""
        part = self._path(self.path(f".{name}.part"))
        stream = self._fs.create(part, True)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
        self._fs.rename(part, self._path(self.path(name)))

    def has(self, *names) -> bool:
        """Is this table committed?"""
        return self._fs.exists(self._path(self.path(*names, SUCCESS)))

    def slices(self, name: str) -> list[int]:
        """The slices of a table, whether committed alone or with it."""
        where = self._path(self.path(name))
        if not self._fs.exists(where):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(where)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("slice=") and n.split("=")[1].isdigit())

    def write_inputs(self, name: str, make: Callable[[], DataFrame]) -> None:
        """Write a table with a ``slice`` column once; a committed one stays."""
        if not self.has(name):
            make().write.mode("overwrite").partitionBy("slice").parquet(self.path(name))

    def read(self, name: str, schema) -> DataFrame:
        """A table, without its slices' numbers."""
        return self.spark.read.schema(schema).parquet(self.path(name))

    def read_slice(self, name: str, k: int, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name, f"slice={k}"))

    def run(self, inputs: str, outputs: str, work: Callable[[int, int], tuple[DataFrame, list]], lanes: int = 2) -> None:
        """Make every slice of ``outputs`` that is not committed: ``work(slice, lane)`` gives
        its rows and the metrics to log, which Spark counts while it writes them. Each lane
        takes the next slice when it is done with one."""
        todo = [k for k in self.slices(inputs) if not self.has(outputs, f"slice={k}")]
        total, lock, stop = len(self.slices(inputs)), threading.Lock(), threading.Event()
        if len(todo) < total:
            log.info("%s: %d of %d slices are there already", self.root, total - len(todo), total)
        queue = iter(todo)

        def lane(i: int) -> None:
            while not stop.is_set():
                with lock:
                    k = next(queue, None)
                if k is None:
                    return
                try:
                    rows, metrics = work(k, i)
                    seen = Observation()
                    rows.observe(seen, F.count(F.lit(1)).alias("rows"), *metrics) \
                        .write.mode("overwrite").parquet(self.path(outputs, f"slice={k}"))
                    log.info("slice %d of %d: %s", k + 1, total, ", ".join(f"{v} {n}" for n, v in seen.get.items()))
                except BaseException:
                    stop.set()
                    raise

        lanes = max(1, min(lanes, len(todo)))
        if lanes == 1:
            return lane(0)
        with ThreadPoolExecutor(max_workers=lanes) as pool:
            jobs = [pool.submit(lane, i) for i in range(lanes)]
            wait(jobs, return_when=FIRST_EXCEPTION)
            for j in jobs:
                j.result()
