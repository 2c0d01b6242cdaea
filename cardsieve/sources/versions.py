"""Tables that change together: each version is a manifest that names their parts, and a new one takes effect in one step.

Below the root lie parts (folders that a load writes and nobody changes) and ``_versions/<number>.json``. A load writes its
part of silver, gold from all of silver, and only then the manifest: under another name first, then renamed. Readers take the
newest manifest or one they name. So a load that is killed anywhere leaves silver and gold of the version before, and parts
that ``vacuum`` removes. One writer at a time; a writer that finds its number taken raises.

Parts keep the columns they were written with. Reading gives all parts the columns of any, and a column whose types differ the
wider one (double for numbers, else text); nothing that is stored is rewritten for it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_NUMBERS = {"tinyint", "smallint", "int", "bigint", "float", "double"}
#: What a load counts, and its columns in the log.
COUNTS = ("read", "new", "updated", "skipped", "errors")


def _wider(a: str, b: str) -> str:
    return a if a == b else "double" if {a, b} <= _NUMBERS else "string"


class Versions:
    """The versions of the tables below ``root``, a URI that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs, self._base = pafs.FileSystem.from_uri(self.root if "://" in self.root else f"file://{self.root}")

    def numbers(self) -> list[int]:
        found = self._fs.get_file_info(pafs.FileSelector(f"{self._base}/_versions", allow_not_found=True))
        return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json") and f.base_name[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "tables": {name: [{"path", "schema"}]}}; of the newest version, or empty with version 0."""
        known = self.numbers()
        if not known and version is None:
            return {"version": 0, "tables": {}}
        with self._fs.open_input_file(f"{self._base}/_versions/{known[-1] if version is None else version}.json") as file:
            return json.loads(file.read())

    def write_part(self, df: DataFrame, name: str) -> dict:
        """Write the rows to a new folder; it belongs to no version until ``commit`` names it."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return {"path": path, "schema": df.schema.jsonValue()}

    def commit(self, tables: dict[str, list[dict]], before: int) -> int:
        """Version ``before`` + 1 with these parts; tables that aren't named stay as they were."""
        number, folder = before + 1, f"{self._base}/_versions"
        whole = {"version": number, "tables": {**self.manifest().get("tables", {}), **tables}}
        self._fs.create_dir(folder, recursive=True)
        trial = f"{folder}/.{uuid.uuid4().hex}"
        with self._fs.open_output_stream(trial) as out:
            out.write(json.dumps(whole).encode())
        if self._fs.get_file_info(f"{folder}/{number}.json").type != pafs.FileType.NotFound:
            raise RuntimeError(f"version {number} has been written by another load")
        self._fs.move(trial, f"{folder}/{number}.json")
        return number

    def parts(self, parts: Sequence[dict]) -> DataFrame:
        """All rows of some parts: those of one schema are one scan, the scans are aligned."""
        schemas: dict[str, list[str]] = {}
        for p in parts:
            schemas.setdefault(json.dumps(p["schema"]), []).append(p["path"])
        frames = [self.spark.read.schema(StructType.fromJson(json.loads(s))).parquet(*paths) for s, paths in schemas.items()]
        kinds: dict[str, str] = {}
        for frame in frames:
            for c, kind in frame.dtypes:
                kinds[c] = _wider(kinds.get(c, kind), kind)
        out = None
        for frame in frames:
            own = frame.withColumns({c: F.col(f"`{c}`").cast(kinds[c]) for c, kind in frame.dtypes if kind != kinds[c]})
            out = own if out is None else out.unionByName(own, allowMissingColumns=True)
        return out

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """The table as of a version (None: the newest), or None where that has no such table."""
        parts = self.manifest(version)["tables"].get(name)
        return self.parts(parts) if parts else None

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove manifests but the newest ``keep``, and parts that none of those names; returns their names."""
        known = self.numbers()
        used = {p["path"].rsplit("/", 1)[1] for v in known[-keep:] for parts in self.manifest(v)["tables"].values() for p in parts}
        gone = []
        for v in known[:-keep]:
            self._fs.delete_file(f"{self._base}/_versions/{v}.json")
        for f in self._fs.get_file_info(pafs.FileSelector(self._base, allow_not_found=True)):
            if f.type == pafs.FileType.Directory and f.base_name != "_versions" and f.base_name not in used:
                self._fs.delete_dir(f.path)
                gone.append(f.base_name)
        return gone


def latest(silver: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest row of each key: parts only grow, an update is a later row."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("load_number")))
    return silver.withColumn("__place", place).filter("__place = 1").drop("__place")


def row_state(df: DataFrame, keys: Sequence[str]) -> Column:
    """Hash of a row's columns besides the keys, by name; nulls don't count, so a new empty column changes no row."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns) if c not in keys])), 256)


def load(tables: Versions, new: DataFrame, keys: Sequence[str], to_gold: Callable[[DataFrame], DataFrame], valid: Column | None = None, order: str | None = None) -> dict:
    """Take a delivery into silver, rebuild gold from all of silver, and make both the next version.

    A row whose key isn't stored is new, one whose columns differ from what is stored is updated, one like it is skipped; of
    several rows of a key in the delivery the last by ``order`` (then by hash) counts and the others are skipped. Rows with a
    null key, or that aren't ``valid``, are errors and stay out. The counts are observed while the part is written: no second
    scan. Without new or updated rows the version stays. Returns the counts and the version."""
    spark, before = tables.spark, tables.manifest()
    fine = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    for k in keys:
        fine = fine & F.col(k).isNotNull()
    state = row_state(new, keys)
    own = new.withColumns({"row_state": state, "__fine": fine})
    last = [F.col(order).desc_nulls_last()] if order else []
    place = F.row_number().over(Window.partitionBy(*keys, F.when(~F.col("__fine"), F.xxhash64("row_state"))).orderBy(*last, "row_state"))
    own = own.withColumn("__place", place)
    parts = before["tables"].get("silver", [])
    if parts:
        stored = latest(tables.parts(parts), keys).select(*keys, F.col("row_state").alias("__stored"))
        own = own.join(stored, list(keys), "left")
    else:
        own = own.withColumn("__stored", F.lit(None).cast("string"))
    status = F.when(~F.col("__fine"), "errors").when((F.col("__place") > 1) | (F.col("__stored") == F.col("row_state")), "skipped").when(F.col("__stored").isNull(), "new").otherwise("updated")
    seen = Observation(f"load-{uuid.uuid4().hex}")
    marked = own.withColumn("__status", status).observe(seen, F.count(F.lit(1)).alias("read"), *[F.count(F.when(F.col("__status") == s, 1)).alias(s) for s in COUNTS[1:]])
    part = tables.write_part(marked.filter(F.col("__status").isin("new", "updated")).select(*new.columns, "row_state", F.lit(before["version"] + 1).alias("load_number")), "silver")
    counts = {c: int(seen.get[c] or 0) for c in COUNTS}
    if not counts["new"] + counts["updated"]:
        return {**counts, "version": before["version"]}
    silver = [*parts, part]
    whole = latest(tables.parts(silver), keys).drop("row_state", "load_number")
    gold = tables.write_part(to_gold(whole), "gold")
    return {**counts, "version": tables.commit({"silver": silver, "gold": [gold]}, before["version"])}


LOG = "run_id string, source string, read bigint, new bigint, updated bigint, skipped bigint, errors bigint, version bigint, seconds double, status string"


def logged_load(tables: Versions, log: str, source: str, run: Callable[[], dict]) -> dict:
    """Run a load and append its line to the log; a failure is logged with its cause and not raised."""
    began, counts, status = time.time(), {}, "ok"
    try:
        counts = run()
    except Exception as e:
        status = f"error: {type(e).__name__}: {str(e)[:200]}"
    line = {"run_id": uuid.uuid4().hex, "source": source, **{c: counts.get(c, 0) for c in COUNTS}, "version": counts.get("version", tables.manifest()["version"]), "seconds": time.time() - began, "status": status}
    tables.spark.createDataFrame([tuple(line.values())], LOG).coalesce(1).write.mode("append").parquet(log)
    return line
