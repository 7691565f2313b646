"""Tables that change safely: a folder for each version, a manifest beside it, and a pointer that is swapped.

A version is written out of sight: its data, then a manifest with rows, sources, batches, schema and a digest of the
rows.  It becomes the table by one rename of a pointer file, which readers follow; so a run that dies before leaves
nothing visible, and going back is another rename.  An append shares the folders of the version before, and a batch that is in
the manifest is not appended again.  Paths go through Hadoop's file systems only."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rentgrid.functions import numbers as N
from rentgrid.operators import writes


class Conflict(RuntimeError):
    """Somebody else published in between, or a guard refused."""


class VersionedTable:
    """A table below ``root``; ``source`` is the column whose values the manifest counts."""

    def __init__(self, spark: SparkSession, root: str, source: str = "source_site"):
        self.spark, self.root, self.source = spark, root.rstrip("/"), source
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._fs = self._jvm.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- small files

    def _path(self, name: str):
        return self._jvm.Path(f"{self.root}/{name}")

    def _read(self, name: str) -> str | None:
        if not self._fs.exists(self._path(name)):
            return None
        stream = self._fs.open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _swap(self, name: str, text: str) -> None:
        """The file has the old text or the new one, whenever it is read."""
        draft = f"{name}-{uuid.uuid4().hex}"
        out = self._fs.create(self._path(draft), True)
        out.write(bytearray(text, "utf-8"))
        out.close()
        context = self._jvm.FileContext.getFileContext(self._path(name).toUri(), self.spark._jsc.hadoopConfiguration())
        over = self.spark.sparkContext._gateway.new_array(self._jvm.Options.Rename, 1)
        over[0] = self._jvm.Options.Rename.OVERWRITE
        context.rename(self._fs.makeQualified(self._path(draft)), self._fs.makeQualified(self._path(name)), over)

    # ---- versions

    def current(self) -> str | None:
        return self._read("CURRENT")

    def manifest(self, version: str | None = None) -> dict[str, Any] | None:
        name = version or self.current()
        text = self._read(f"{name}.json") if name else None
        return json.loads(text) if text else None

    def read(self, version: str | None = None) -> DataFrame:
        """The rows of a version, the current one if none is given."""
        m = self.manifest(version)
        if m is None:
            raise FileNotFoundError(f"no version at {self.root}")
        return self.spark.read.schema(m["ddl"]).parquet(*[f"{self.root}/{f}" for f in m["folders"]])

    def _figures(self, rows: DataFrame) -> dict[str, Any]:
        name = F.coalesce(F.col(self.source).cast("string"), F.lit("unknown")) if self.source in rows.columns else F.lit("unknown")
        digest = F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)"))  # whatever the order of the rows
        counted = rows.groupBy(name.alias("s")).agg(F.count("*").alias("n"), digest.alias("d")).collect()  # a row for each source
        return {"rows": sum(r.n for r in counted), "sources": {r.s: r.n for r in sorted(counted, key=lambda r: r.s)}, "digest": str(sum(int(r.d) for r in counted))}

    def _stage(self, rows: DataFrame, batch: str, kept: dict[str, Any] | None) -> str:
        version, folder = f"v-{uuid.uuid4().hex}", f"data-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{folder}")
        own = self._figures(self.spark.read.schema(rows.schema).parquet(f"{self.root}/{folder}"))
        old = kept or {"rows": 0, "sources": {}, "digest": "0", "folders": [], "batches": []}
        sources = {s: old["sources"].get(s, 0) + own["sources"].get(s, 0) for s in sorted({*old["sources"], *own["sources"]})}
        manifest = {
            "version": version, "parent": self.current(), "batches": [*old["batches"], batch], "folders": [*old["folders"], folder], "rows": old["rows"] + own["rows"], "sources": sources,
            "digest": str(int(old["digest"]) + int(own["digest"])), "ddl": rows.schema.toDDL(), "schema": writes.structure_hash(rows),
        }
        self._swap(f"{version}.json", json.dumps(manifest))
        return version

    def stage(self, rows: DataFrame, batch: str) -> str:
        """Write a version that replaces the table; nobody sees it before ``publish``."""
        return self._stage(rows, batch, None)

    def stage_append(self, rows: DataFrame, batch: str) -> str | None:
        """Write a version with a batch more; None if the table has that batch already."""
        now = self.manifest()
        if now and batch in now["batches"]:
            return None
        return self._stage(rows, batch, now)

    def verify(self, version: str) -> list[str]:
        """What is wrong with a version: its rows counted and digested again, its schema compared."""
        m = self.manifest(version)
        if m is None:
            return ["no manifest"]
        try:
            rows = self.read(version)
            found = self._figures(rows)
        except Exception as broken:  # noqa: BLE001  whatever keeps it from being read
            return [f"unreadable: {type(broken).__name__}"]
        return [f"{k} differ" for k in ("rows", "sources", "digest") if found[k] != m[k]] + (["schema differs"] if writes.structure_hash(rows) != m["schema"] else [])

    def publish(self, version: str, least: int = 0, critical: tuple[str, ...] = (), overall: float = 15.0, each: float = 35.0) -> None:
        """Make a staged version the table, behind guards: it is whole, has ``least`` rows, and neither the whole nor a
        critical source fell too far.  Refused if another version was published since it was staged."""
        m, now = self.manifest(version), self.manifest()
        errors = self.verify(version)
        if not errors and m and (now or {}).get("version") != m["parent"]:
            errors.append("published meanwhile")
        if m and m["rows"] < least:
            errors.append(f"{m['rows']} rows")
        drop = lambda a, b: (a - b) * 100.0 / a if a > 0 and a > b else 0.0
        if m and now:
            if drop(now["rows"], m["rows"]) > overall:
                errors.append(f"rows dropped from {now['rows']} to {m['rows']}")
            errors += [f"{s} dropped" for s in critical if drop(now["sources"].get(s, 0), m["sources"].get(s, 0)) > each]
        if errors:
            raise Conflict("; ".join(errors))
        self._swap("CURRENT", version)

    def append(self, rows: DataFrame, batch: str) -> str:
        """Append a batch once, however often it is asked for; the version that has it."""
        version = self.stage_append(rows, batch)
        if version:
            self.publish(version)
        return version or str(self.current())

    def roll_back(self, to: str | None = None, least: int = 0) -> str:
        """Point at the version before, or at a given one, if it is whole and has ``least`` rows."""
        now = self.manifest()
        target = to or (now or {}).get("parent")
        m = self.manifest(target) if target else None
        errors = self.verify(target) if target else ["no version before"]
        if m and m["rows"] < least:
            errors.append(f"{m['rows']} rows")
        if errors or not target:
            raise Conflict("; ".join(errors))
        self._swap("CURRENT", target)
        return target


RUN = "run_id string, source string, ran_at timestamp, statut string, n_rows long, structure_hash string, error string"


def logged_run(runs: VersionedTable, source: str, ran_at, load) -> DataFrame | None:
    """Load a batch and append how that went to the run log, errors too; the batch, or None after an error.

    ``load`` returns a frame.  A run is known by its source and time, so the repeated entry of one is not appended."""
    spark, batch, error = runs.spark, None, None
    n, digest = 0, None
    try:
        batch = load()
        n, digest = batch.count(), writes.structure_hash(batch)
    except Exception as failed:  # noqa: BLE001  any failure of a source is a run with an error
        batch, error = None, str(failed)[:500]
    statut = "error" if error is not None else "ok" if n else "empty"
    entry = spark.createDataFrame([(f"{source}@{ran_at.isoformat()}", source, ran_at, statut, n, digest if n else None, error)], RUN)
    runs.append(entry, f"{source}@{ran_at.isoformat()}")
    return batch


def manifest_figures(items: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(figure, key, n): the figures of a build's manifest: listings, shown ones, those with a photo and with several, by source."""
    source = F.coalesce(F.nullif(N.column(items, "source"), F.lit("")), F.nullif(N.column(items, "source_site"), F.lit("")), F.lit("unknown"))
    shown = ~F.coalesce(N.column(items, "display_canonical", "boolean") == F.lit(False), F.lit(False))
    photo = F.coalesce(N.column(items, "local_image_url") != "", F.lit(False))
    many = F.coalesce(F.size(N.column(items, "local_image_urls", "array<string>")) > 1, F.lit(False))
    flags: dict[str, Column] = {"listing_count": F.lit(True), "visible_listing_count": shown, "local_primary_photos": photo, "local_multi_galleries": many}
    each = items.groupBy(source.alias("key")).agg(*[F.count_if(c).alias(k) for k, c in flags.items()])
    one = each.select("key", F.explode(F.array(*[F.struct(F.lit(k).alias("figure"), F.col(k).alias("n")) for k in flags])).alias("f")).select("f.figure", "key", "f.n")
    total = one.groupBy("figure").agg(F.sum("n").alias("n")).select("figure", F.lit("").alias("key"), "n")
    out = total.unionByName(one.where("figure = 'listing_count'").withColumn("figure", F.lit("source_count")))
    return out if groups is None else out.unionByName(groups.agg(F.lit("dedup_group_count").alias("figure"), F.lit("").alias("key"), F.count("*").alias("n")))
