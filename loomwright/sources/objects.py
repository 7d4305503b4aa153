"""Content-addressed object stores on any Hadoop file system, and journaled publication."""

from __future__ import annotations

import hashlib
import json
import os
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: States of a publication, in order.
STATES = ("assembling", "assembled", "publishing", "published")


def object_key(digest: str) -> str:
    """Fan-out path of a digest."""
    if len(digest) != 64 or set(digest) - set("0123456789abcdef"):
        raise ValueError(f"not a lower-case SHA-256: {digest!r}")
    return f"{digest[:2]}/{digest[2:4]}/{digest}"


@dataclass(frozen=True)
class Store:
    """Objects under a root, read and written through Hadoop's file systems (file:, hdfs:, s3a:)."""

    spark: SparkSession
    root: str

    def _at(self, digest: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root.rstrip('/')}/{object_key(digest)}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def size(self, digest: str) -> int | None:
        """Bytes of an object, None where it isn't there."""
        fs, path = self._at(digest)
        return fs.getFileStatus(path).getLen() if fs.exists(path) else None

    def publish(self, local: str, digest: str) -> str:
        """Copy a file in; an object that is there already is kept if its size fits, else it's an error."""
        with open(local, "rb") as f:
            if hashlib.file_digest(f, "sha256").hexdigest() != digest:
                raise ValueError(f"{local} isn't {digest}")
        fs, path = self._at(digest)
        there = self.size(digest)
        if there is not None:
            if there != os.path.getsize(local):
                raise ValueError(f"{path} has another size")
            return str(path)
        jvm = self.spark.sparkContext._jvm
        part = jvm.org.apache.hadoop.fs.Path(f"{path}.{os.getpid()}.part")
        fs.copyFromLocalFile(False, True, jvm.org.apache.hadoop.fs.Path(f"file://{os.path.abspath(local)}"), part)
        if not fs.rename(part, path) and self.size(digest) is None:
            raise OSError(f"can't install {path}")
        return str(path)

    def fetch(self, digest: str, local: str, expected: int | None = None) -> bool:
        """Copy an object out and check it; False where it isn't there, an error where it is broken."""
        fs, path = self._at(digest)
        if not fs.exists(path):
            return False
        part = f"{local}.{os.getpid()}.part"
        fs.copyToLocalFile(False, path, self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{os.path.abspath(part)}"), True)
        with open(part, "rb") as f:
            good = hashlib.file_digest(f, "sha256").hexdigest() == digest
        if not good or (expected is not None and os.path.getsize(part) != expected):
            os.remove(part)
            raise ValueError(f"{path} is broken")
        os.replace(part, local)
        return True


def fetch_any(stores: list[Store], digest: str, cache: str, expected: int | None = None) -> str:
    """A verified local copy: from the cache, else from the first mirror that has a good one."""
    local = os.path.join(cache, object_key(digest))
    if os.path.exists(local):
        with open(local, "rb") as f:
            if hashlib.file_digest(f, "sha256").hexdigest() == digest:
                return local
        os.remove(local)
    os.makedirs(os.path.dirname(local), exist_ok=True)
    wrong: list[str] = []
    for store in stores:
        try:
            if store.fetch(digest, local, expected):
                return local
            wrong.append(f"{store.root}: absent")
        except ValueError as e:
            wrong.append(str(e))
    raise FileNotFoundError(f"{digest}: {'; '.join(wrong)}")


def available(stores: list[Store], digests: list[tuple[str, int]], workers: int = 8) -> list[tuple[str, bool]]:
    """Whether some store has each object in its size."""
    with ThreadPoolExecutor(max(1, min(workers, 32))) as pool:
        return list(pool.map(lambda x: (x[0], any(s.size(x[0]) == x[1] for s in stores)), digests))


class Journal:
    """Progress of a publication in a file that is replaced whole, so that a rerun goes on where it stopped."""

    def __init__(self, path: str, plan: str):
        self.path, self.state = path, {"plan": plan, "state": STATES[0], "objects": {}}
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                held = json.load(f)
            if held.get("plan") != plan or held.get("state") not in STATES:
                raise ValueError(f"{path} belongs to another plan or is broken")
            self.state = held

    def write(self, state: str | None = None, **objects: str) -> None:
        if state is not None:
            if STATES.index(state) < STATES.index(self.state["state"]):
                raise ValueError(f"a publication doesn't go back to {state}")
            self.state["state"] = state
        self.state["objects"].update(objects)
        with open(f"{self.path}.part", "w", encoding="utf-8") as f:
            json.dump(self.state, f, sort_keys=True)
            f.flush()
            os.fsync(f.fileno())
        os.replace(f"{self.path}.part", self.path)


def publish_all(objects: list[tuple[str, str]], store: Store, journal: Journal, workers: int = 8) -> dict[str, str]:
    """Publish (local, digest) pairs that the journal doesn't have yet; only objects still listed stay in it."""
    listed = {digest for _, digest in objects}
    journal.state["objects"] = {d: u for d, u in journal.state["objects"].items() if d in listed}
    if journal.state["state"] != STATES[-1]:
        journal.write("publishing")
    todo = [(local, digest) for local, digest in objects if digest not in journal.state["objects"]]
    with ThreadPoolExecutor(max(1, min(workers, 32))) as pool:
        for digest, url in pool.map(lambda x: (x[1], store.publish(*x)), todo):
            journal.write(**{digest: url})
    journal.write("published")
    return journal.state["objects"]


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """Stored objects by path: (path, sha256, bytes), without reading their contents."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.select("path", F.regexp_extract("path", r"([0-9a-f]{64})$", 1).alias("sha256"), F.col("length").alias("bytes")).filter("sha256 <> ''")
