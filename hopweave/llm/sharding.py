"""Size-tiered compaction of immutable shards under a versioned manifest.

A store is a folder with `shards/` (Parquet files that are never changed) and
`manifest/` (one text file of JSON lines for each version: the schema, then the live
shards with bytes, tier and arrival). An arrival is appended as small shards, one for
each task that wrote, and committed as a new version. Compaction groups live shards by
tier, the power of FAN in which their size falls; FAN or more shards of a tier are merged
in runs of at most the target size, each run read and written by one task without a
shuffle, and the merges of a wave are committed as one version.

A commit writes its file under a name of its own and gives it the name of the next
version by an operation that fails if that name exists (a hard link on a local file
system, a rename without overwriting elsewhere; a store needs a file system on which that
is atomic, such as HDFS). If another writer was first, the commit is tried again on top
of its version. Readers take the highest version, whose shards all exist, so they see
whole versions only; a job that dies before its commit leaves files that no version
lists. Nothing is deleted but by vacuum(), which keeps the shards of the newest versions
and everything that is not older than a time in which any running append has ended.

The schema of a version is the union of the schemas of all arrivals, by name; rows
without a column have null there, also after merges.

Only DataFrame operations touch rows. The driver handles file names and sizes, about 150
bytes a shard; a merge job takes WAVE runs at most, so its plan stays bounded.

Defined cases: nulls are stored as they are; an extra column, under any name, becomes a
column of the store; an arrival whose column has another type than the store's is
refused before anything is committed; an empty arrival adds a version without shards;
repeated rows stay repeated.
"""

from __future__ import annotations

import contextlib
import json
import math
import time
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopweave.llm.shared import folder

TARGET_BYTES = 128 * 1024 * 1024
FAN = 4
WAVE = 64
#: Versions that vacuum() leaves readable, and seconds after which files that no version lists are from a dead job.
KEEP, DEAD_AFTER = 10, 7 * 24 * 3600


def united(old: T.StructType | None, new: T.StructType) -> T.StructType:
    """The columns of old, then those that only new has; all may be null."""
    known = {f.name.lower(): f for f in (old.fields if old else [])}
    for f in new.fields:
        own = known.setdefault(f.name.lower(), T.StructField(f.name, f.dataType, True))
        if own.dataType != f.dataType:
            raise ValueError(f"column {f.name} is {f.dataType.simpleString()}, in the store {own.dataType.simpleString()}")
    return T.StructType(list(known.values()))


@contextlib.contextmanager
def one_file_each(spark: SparkSession):
    """Keeps a union of single partitions from becoming one partition, which Spark 4.1 does by default."""
    name = "spark.sql.unionOutputPartitioning"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class ShardStore:
    """Immutable shards of one table in a folder that all executors see."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, fan: int = FAN):
        self.spark, self.path, self.target, self.fan = spark, path.rstrip("/"), target_bytes, fan
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._write = lambda out, text: out.write(bytearray(text.encode()))
        for sub in ("shards", "manifest"):
            self._fs.mkdirs(self._path(f"{self.path}/{sub}"))

    # ---- versions

    def versions(self) -> list[int]:
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.path}/manifest"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def version(self) -> int:
        """The highest committed version; 0 before the first."""
        return max(self.versions(), default=0)

    def _lines(self, version: int) -> list[dict]:
        if not version:
            return []
        stream = self._fs.open(self._path(f"{self.path}/manifest/v{version:012d}.json"))
        try:
            return [json.loads(x) for x in self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()]
        finally:
            stream.close()

    def schema(self, version: int | None = None) -> T.StructType | None:
        """The columns of a version."""
        found = [x["schema"] for x in self._lines(self.version() if version is None else version) if "schema" in x]
        return T.StructType.fromJson(found[0]) if found else None

    def manifest(self, version: int | None = None) -> list[dict]:
        """Live shards of a version: file, bytes, tier, arrival."""
        lines = self._lines(self.version() if version is None else version)
        return sorted((x for x in lines if "file" in x), key=lambda x: x["file"])

    def _named(self, own, target) -> bool:
        """Whether the file own now has the name target, which no other file had."""
        if self._fs.getUri().getScheme() == "file":
            file = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
            try:
                self._jvm.java.nio.file.Files.createLink(file(target), file(own))
            except Py4JJavaError as e:
                if "FileAlreadyExists" in str(e.java_exception):
                    return False
                raise
            return True
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.toUri(), self._fs.getConf()).rename(own, target, none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    def _commit(self, change, schema: T.StructType | None = None) -> int:
        """change: from the live shards to the new ones, or None if there is nothing to do any more; schema: of new rows."""
        while True:
            v = self.version()
            new = change(self.manifest(v))
            if new is None:
                return v
            columns = united(self.schema(v), schema or T.StructType([]))
            own = self._path(f"{self.path}/manifest/.{uuid.uuid4().hex}")
            out = self._fs.create(own, False)
            lines = [{"schema": columns.jsonValue()}, *sorted(new, key=lambda x: x["file"])]
            self._write(out, "".join(json.dumps(x, sort_keys=True) + "\n" for x in lines))
            out.close()
            done = self._named(own, self._path(f"{self.path}/manifest/v{v + 1:012d}.json"))
            if self._fs.exists(own):
                self._fs.delete(own, False)
            if done:
                return v + 1

    # ---- shards

    def tier(self, size: int) -> int:
        """Tiers count down from the target: 0 is done, t is smaller than the target by fan ** t or more."""
        return 0 if 2 * size > self.target else max(1, math.ceil(math.log(self.target / max(1, size), self.fan)))

    def _added(self, where: str, arrival: str) -> list[dict]:
        found = []
        for s in self._fs.listStatus(self._path(f"{self.path}/shards/{where}")):
            name = s.getPath().getName()
            if name.endswith(".parquet"):
                size = int(s.getLen())
                found.append({"file": f"{where}/{name}", "bytes": size, "tier": self.tier(size), "arrival": arrival})
        return found

    def append(self, rows: DataFrame, arrival: str) -> int:
        """Writes an arrival as small shards and commits them; an arrival that is in a version already is not added again."""
        where = uuid.uuid4().hex
        if any(arrival in s["arrival"].split("+") for s in self.manifest()):
            return self.version()
        united(self.schema(), rows.schema)  # refuses before it writes
        rows.write.parquet(f"{self.path}/shards/{where}")
        new = self._added(where, arrival)
        taken = lambda live: any(arrival in x["arrival"].split("+") for x in live)
        return self._commit(lambda live: None if taken(live) else live + new, rows.schema)

    def runs(self, live: list[dict]) -> list[list[dict]]:
        """Runs to merge: of each tier but 0 with fan shards or more, shards of similar size up to the target."""
        out = []
        for t in sorted({s["tier"] for s in live} - {0}, reverse=True):
            some = sorted((s for s in live if s["tier"] == t), key=lambda s: (s["bytes"], s["file"]))
            if len(some) < self.fan:
                continue
            run: list[dict] = []
            for s in some:
                if run and sum(x["bytes"] for x in run) + s["bytes"] > self.target:
                    out.append(run)
                    run = []
                run.append(s)
            out.append(run)
        return [r for r in out if len(r) > 1]

    def compact(self) -> int:
        """Merges until no tier has fan shards that fit together; the version after it."""
        while runs := self.runs(self.manifest()):
            for at in range(0, len(runs), WAVE):
                self._merge(runs[at : at + WAVE])
        return self.version()

    def _merge(self, runs: list[list[dict]]) -> None:
        where = uuid.uuid4().hex
        files = lambda run: [f"{self.path}/shards/{s['file']}" for s in run]
        schema = self.schema()
        # one task a run: its files are read one after the other, and written as one
        parts = [self.spark.read.schema(schema).parquet(*files(run)).coalesce(1) for run in runs]
        with one_file_each(self.spark):
            reduce(DataFrame.unionAll, parts).write.parquet(f"{self.path}/shards/{where}")
        arrivals = sorted({a for r in runs for s in r for a in s["arrival"].split("+")})
        new, old = self._added(where, "+".join(arrivals)), {s["file"] for r in runs for s in r}

        def change(live):
            # another compaction may have taken one of the shards: then ours is void
            return [s for s in live if s["file"] not in old] + new if old <= {s["file"] for s in live} else None

        self._commit(change)

    def vacuum(self, keep: int = KEEP, dead_after: float = DEAD_AFTER) -> None:
        """Forgets all but the newest versions, and deletes shards that only forgotten ones list, and old files that none lists."""
        every = self.versions()
        kept = {x["file"] for v in every[-keep:] for x in self.manifest(v)}
        gone = {x["file"] for v in every[:-keep] for x in self.manifest(v)} - kept
        for v in every[:-keep]:
            self._fs.delete(self._path(f"{self.path}/manifest/v{v:012d}.json"), False)
        for file in sorted(gone):
            self._fs.delete(self._path(f"{self.path}/shards/{file}"), False)
        old = (time.time() - dead_after) * 1000
        used = {f.split("/")[0] for f in kept}
        for d in self._fs.listStatus(self._path(f"{self.path}/shards")):
            where = d.getPath().getName()
            left = [x for x in self._fs.listStatus(d.getPath()) if x.getPath().getName().endswith(".parquet")]
            emptied = where in {f.split("/")[0] for f in gone} and not left
            if where not in used and (emptied or d.getModificationTime() < old):
                self._fs.delete(d.getPath(), True)

    def ledger(self, version: int | None = None) -> DataFrame:
        """version, tier, file, n_bytes, n_rows, arrivals of the live shards of a version; rows are counted where they are read."""
        v = self.version() if version is None else version
        live = [(v, s["tier"], s["file"], s["bytes"], s["arrival"]) for s in self.manifest(v)]
        shards = self.spark.createDataFrame(live, "version long, tier int, file string, n_bytes long, arrivals string")
        if not live:
            return shards.withColumn("n_rows", F.lit(0).cast("long"))
        file = F.regexp_extract("_metadata.file_path", "([^/]+/[^/]+)$", 1).alias("file")
        counts = self.read(v).select(file).groupBy("file").agg(F.count("*").alias("n_rows"))
        out = shards.join(counts, "file", "left").select("version", "tier", "file", "n_bytes", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "arrivals")
        return out

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        live = self.manifest(version)
        if not live:
            raise ValueError("no shard has been committed")
        return self.spark.read.schema(self.schema(version)).parquet(*(f"{self.path}/shards/{s['file']}" for s in live))


#: Documents arrive in four batches by the first hexadecimal digit of their id's md5; later ones are smaller.
ARRIVALS = {"a": "01234567", "b": "89ab", "c": "cd", "d": "ef"}


def arrival_of(id_col: str):
    digit = F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 1)
    out = F.lit(None).cast("string")
    for name, digits in ARRIVALS.items():
        out = F.when(digit.isin(*digits), F.lit(name)).otherwise(out)
    return out


def filled(spark: SparkSession, sf_dir: str) -> ShardStore:
    """A store to which the documents were appended in four arrivals, with a compaction after each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = ShardStore(spark, f"{folder(spark)}/shards-{uuid.uuid4().hex}")
    for name in ARRIVALS:
        store.append(docs.where(arrival_of("doc_id") == name), name)
        store.compact()
        store.vacuum(keep=1)
    return store


def shard_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live shards of the documents: version, tier, file, n_bytes, n_rows (as they are read back), arrivals."""
    return filled(spark, sf_dir).ledger()


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends the documents in four arrivals, compacts, and reads back each document from the newest version."""
    rows = filled(spark, sf_dir).read()
    return rows.select(
        "doc_id",
        arrival_of("doc_id").alias("arrival"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.md5("text").alias("text_md5"),
        F.md5(F.concat_ws("|", F.coalesce("lang", F.lit("?")), F.coalesce("source", F.lit("?")), F.coalesce(F.col("n_chars").cast("string"), F.lit("?")))).alias("rest_md5"),
    )


_CASES = " ".join(f"WHEN substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 1) IN ({', '.join(repr(d) for d in ds)}) THEN '{n}'" for n, ds in ARRIVALS.items())

OP5_SQL = f"""
SELECT doc_id, CASE {_CASES} END AS arrival, CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS text_md5,
       md5(concat_ws('|', coalesce(lang, '?'), coalesce(source, '?'), coalesce(CAST(n_chars AS VARCHAR), '?'))) AS rest_md5
FROM documents
"""
