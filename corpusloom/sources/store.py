"""A content-addressed store of snapshots in Parquet.

``objects`` holds each content once, in folders by the first two digits of its hash; ``entries`` holds, for each snapshot, kind, label and
hash, in a folder of its own; ``snapshots`` is one small JSON file each, and ``HEAD`` names the newest. Data is written before the
manifest that names it, so a snapshot is either whole or not there. One writer at a time.
"""

from __future__ import annotations

import datetime
import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.predicates import check_snapshot_id
from corpusloom.sources.writers import write_text

VERSION = 1
OBJECTS = "sha256 string, data binary, stored_bytes bigint, shard string"
ENTRIES = "kind string, label string, sha256 string"


class StoreError(Exception):
    """A store that can't be used as asked."""


class SnapshotNotFound(StoreError):
    pass


class SnapshotExists(StoreError):
    pass


class CorruptedStore(StoreError):
    pass


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str | Path, clock=lambda: datetime.datetime.now(datetime.UTC).replace(tzinfo=None)):
        self.spark, self.root, self.clock = spark, Path(root), clock
        self.manifests = self.root / "snapshots"
        self.manifests.mkdir(parents=True, exist_ok=True)

    def objects(self) -> DataFrame:
        path = self.root / "objects"
        return self.spark.read.schema(OBJECTS).parquet(str(path)) if path.is_dir() else self.spark.createDataFrame([], OBJECTS)

    def entries(self, snapshot_id: str) -> DataFrame:
        """``(kind, label, sha256)`` of a snapshot."""
        return self.spark.read.schema(ENTRIES).parquet(str(self.root / "entries" / self.manifest(snapshot_id)["data"]))

    def files(self, snapshot_id: str) -> DataFrame:
        return self.entries(snapshot_id).where("kind = 'file'").select(F.col("label").alias("path"), "sha256")

    def contents(self) -> DataFrame:
        return self.objects().select("sha256", F.col("data").cast("string").alias("content"))

    def manifest(self, snapshot_id: str) -> dict:
        check_snapshot_id(snapshot_id)
        path = self.manifests / f"{snapshot_id}.json"
        if not path.is_file():
            raise SnapshotNotFound(snapshot_id)
        found = json.loads(path.read_text(encoding="utf-8"))
        if found.get("version", 0) > VERSION:
            raise StoreError(f"{snapshot_id} has version {found['version']}; {VERSION} is the newest that can be read")
        return found | {"version": VERSION}

    def list(self) -> list[dict]:
        """All readable manifests, newest first."""
        found = []
        for path in self.manifests.glob("*.json"):
            try:
                found.append(self.manifest(path.stem))
            except (StoreError, ValueError, OSError):
                continue
        return sorted(found, key=lambda m: (m["created"], m["id"]), reverse=True)

    def head(self) -> str | None:
        path = self.root / "HEAD"
        return path.read_text().strip() or None if path.is_file() else None

    def put(self, contents: DataFrame) -> None:
        """Append the contents ``(sha256, data)`` that aren't there yet, each once."""
        new = contents.dropDuplicates(["sha256"]).join(self.objects().select("sha256"), "sha256", "left_anti")
        made = new.select("sha256", "data", F.octet_length("data").cast("bigint").alias("stored_bytes"), F.substring("sha256", 1, 2).alias("shard"))
        made.write.mode("append").option("compression", "zstd").partitionBy("shard").parquet(str(self.root / "objects"))

    def get(self, sha256: str) -> bytes:
        """One content, checked against its hash."""
        row = self.objects().where((F.col("shard") == sha256[:2]) & (F.col("sha256") == sha256)).select("data", F.sha2("data", 256).alias("found")).first()
        if row is None:
            raise StoreError(f"no object {sha256}")
        if row.found != sha256:
            raise CorruptedStore(sha256)
        return bytes(row.data)

    def damaged(self) -> DataFrame:
        """Objects whose content isn't that of their hash."""
        return self.objects().where(F.sha2("data", 256) != F.col("sha256")).select("sha256")

    def _save(self, snapshot_id: str, rows: DataFrame, profile: dict, name: str | None) -> None:
        """``rows`` is ``(kind, label, content string)``."""
        from corpusloom.shared import stored

        hashed = stored(rows.select("kind", "label", F.sha2("content", 256).alias("sha256"), F.col("content").cast("binary").alias("data")), "snapshot")
        self.put(hashed.select("sha256", "data"))
        data = f"{snapshot_id}-{uuid.uuid4().hex[:8]}"
        hashed.select("kind", "label", "sha256").write.parquet(str(self.root / "entries" / data))
        created = self.clock().isoformat(timespec="microseconds")
        manifest = {"version": VERSION, "id": snapshot_id, "name": name, "created": created, "profile": profile, "data": data}
        write_text(self.manifests / f"{snapshot_id}.json", json.dumps(manifest, indent=2))
        write_text(self.root / "HEAD", snapshot_id)

    def create(self, rows: DataFrame, profile: dict | None = None, name: str | None = None) -> str:
        snapshot_id = name or self.clock().strftime("%Y%m%d-%H%M%S-%f")
        check_snapshot_id(snapshot_id)
        if (self.manifests / f"{snapshot_id}.json").exists():
            raise SnapshotExists(snapshot_id)
        self._save(snapshot_id, rows, profile or {}, name)
        return snapshot_id

    def update(self, snapshot_id: str, rows: DataFrame, profile: dict | None = None) -> str:
        old = self.manifest(snapshot_id)
        self._save(snapshot_id, rows, profile or old["profile"], old["name"])
        self._drop(old["data"])
        return snapshot_id

    def rename(self, old_id: str, new_id: str) -> str:
        check_snapshot_id(new_id)
        found = self.manifest(old_id)
        if (self.manifests / f"{new_id}.json").exists():
            raise SnapshotExists(new_id)
        write_text(self.manifests / f"{new_id}.json", json.dumps(found | {"id": new_id, "name": new_id}, indent=2))
        (self.manifests / f"{old_id}.json").unlink()
        if self.head() == old_id:
            write_text(self.root / "HEAD", new_id)
        return new_id

    def delete(self, snapshot_id: str) -> None:
        found = self.manifest(snapshot_id)
        (self.manifests / f"{snapshot_id}.json").unlink()
        self._drop(found["data"])
        if self.head() == snapshot_id:
            left = self.list()
            write_text(self.root / "HEAD", left[0]["id"] if left else "")

    def _drop(self, data: str) -> None:
        import shutil

        shutil.rmtree(self.root / "entries" / data, ignore_errors=True)

    def referenced(self) -> DataFrame:
        """``(sha256)`` of all snapshots."""
        found = self.spark.createDataFrame([], "sha256 string")
        paths = [str(self.root / "entries" / m["data"]) for m in self.list()]
        if paths:
            found = self.spark.read.schema(ENTRIES).parquet(*paths).select("sha256").distinct()
        return found

    def stats(self) -> dict:
        """``dedup_pct`` is the share of bytes that no snapshot refers to; ``logical_dedup_pct`` what sharing saves."""
        return store_stats(self.objects(), self._all_entries()).first().asDict() | {"snapshots": len(self.list())}

    def _all_entries(self) -> DataFrame:
        paths = [str(self.root / "entries" / m["data"]) for m in self.list()]
        return self.spark.read.schema(ENTRIES).parquet(*paths) if paths else self.spark.createDataFrame([], ENTRIES)

    def gc(self) -> dict:
        """Remove objects that no snapshot refers to. Only shards with such objects, of 256 at most, are rewritten and replaced, each by itself."""
        import shutil

        objects, new = self.objects(), self.root / "objects.new"
        by_shard = orphans(objects, self.referenced()).groupBy("shard").agg(F.count("*").alias("n"), F.sum("stored_bytes").alias("bytes")).collect()  # a row for each shard
        if by_shard:
            live = objects.where(F.col("shard").isin(*[r.shard for r in by_shard])).join(self.referenced(), "sha256", "left_semi")
            live.select("sha256", "data", "stored_bytes", "shard").write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(str(new))
            for r in by_shard:
                name = f"shard={r.shard}"
                (self.root / "objects" / name).rename(self.root / f"objects.old-{name}")
                if (new / name).is_dir():
                    (new / name).rename(self.root / "objects" / name)
                shutil.rmtree(self.root / f"objects.old-{name}")
            shutil.rmtree(new)
        return {"removed": sum(r.n for r in by_shard), "freed_bytes": sum(r.bytes for r in by_shard)}


def orphans(objects: DataFrame, referenced: DataFrame) -> DataFrame:
    return objects.join(referenced, "sha256", "left_anti")


def store_stats(objects: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: objects, bytes, bytes referred to, and shares. ``entries`` are those of all snapshots."""
    uses = entries.groupBy("sha256").agg(F.count("*").alias("uses"))
    used = objects.select("sha256", "stored_bytes").join(uses, "sha256", "left")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    sums = used.agg(F.count("*").alias("objects"), total("stored_bytes").alias("total_bytes"), total(F.when(F.col("uses") > 0, F.col("stored_bytes"))).alias("unique_bytes"), total(F.col("stored_bytes") * F.col("uses")).alias("logical_bytes"))
    share = lambda part, whole: F.when(F.col(whole) > 0, F.bround((1 - F.col(part) / F.col(whole)) * 100, 1)).otherwise(0.0)
    return sums.select("objects", "total_bytes", "unique_bytes", share("unique_bytes", "total_bytes").alias("dedup_pct"), share("unique_bytes", "logical_bytes").alias("logical_dedup_pct"))
