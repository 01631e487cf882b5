"""A run kept step by step in a folder, from which it can go on.

After every step the population is written below the folder, then a manifest of
one JSON line: the step, where its population is, what the run was asked, and the
step's report. A manifest appears by a rename, so a step is there as a whole or
not at all; what a broken step leaves behind is written over when it is done
again. Only the newest population is kept.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from murmuration.functions.slots import wide


def digest_of(**facts) -> str:
    return hashlib.sha256(json.dumps(facts, sort_keys=True, default=str).encode()).hexdigest()


def rows_digest(df: DataFrame, columns: Sequence[str]) -> list:
    """The number of rows and the sum of their hashes, in any order of the rows."""
    flags = [F.col(c).isNull() for c in columns]  # the hash passes over NULLs
    n, total = df.agg(F.count(F.lit(1)), F.sum(wide(F.xxhash64(*flags, *columns)))).first()
    return [n, str(total)]


class RunStore:
    """``asked`` is a digest of all that a run's result depends on, but for its
    observations; a folder of another run is refused."""

    def __init__(self, spark: SparkSession, folder: str, asked: str):
        self.spark, self.folder, self.asked = spark, folder.rstrip("/"), asked
        self.done = self._read()
        for manifest in self.done:
            if manifest["asked"] != asked:
                raise ValueError(f"{folder} holds a run of other particles or settings")

    @property
    def last(self) -> dict | None:
        return self.done[-1] if self.done else None

    def was_done(self, step: int, observed) -> bool:
        """Whether the step need not be run again; its observations must be the same."""
        for manifest in self.done:
            if manifest["step"] == step:
                if manifest["observed"] != observed:
                    raise ValueError(f"the observation of step {step} has changed since the run was kept")
                return True
        if self.done and step < self.done[-1]["step"]:
            raise ValueError(f"step {step} was not observed when the run was kept")
        return False

    def population(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self.last['population']}")

    def save(self, step: int, observed, rows: DataFrame, **facts) -> None:
        name = f"populations/{step:010d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{name}")
        before = self.last
        manifest = {"step": step, "observed": observed, "asked": self.asked, "population": name, **facts}
        self._commit(f"{step:010d}.json", json.dumps(manifest))
        self.done.append(manifest)
        if before:
            fs, path = self._at(before["population"])
            fs.delete(path, True)

    def _at(self, name: str):
        """The file system and the path of something in the folder."""
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(sc._jsc.hadoopConfiguration()), path

    def _read(self) -> list[dict]:
        fs, path = self._at("steps")
        if not fs.exists(path):
            return []
        # one line per step; names with an underscore are not read
        lines = self.spark.read.text(f"{self.folder}/steps").collect()
        return sorted((json.loads(r.value) for r in lines), key=lambda m: m["step"])

    def _commit(self, name: str, text: str) -> None:
        fs, path = self._at(f"steps/{name}")
        _, part = self._at(f"steps/_{uuid.uuid4().hex}")
        out = fs.create(part)
        try:
            out.write(text.encode())
        finally:
            out.close()
        if not fs.rename(part, path):
            raise RuntimeError(f"{path.toString()} could not be written; is another run using the folder?")
