"""A catalog of datasets and artifacts: one JSON file per version of an entry.

A change reads an entry's last version and writes the next one under a name that only
one writer can take; a writer that comes second reads again and makes its change to what
the first has left, so none is lost. Entries are read as a DataFrame, of each id the last
version; data are Parquet, CSV, JSON or text in folders of their own. All file access goes through Spark's file systems, so the root may be any
path that Spark can open.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.functions import text as T
from hopweave.operators.merge import union_by_name
from hopweave.sources.readers import read_any, read_queries

ENTRY = "id string, name string, kind string, path string, format string, owner string, source string, created_at string, extra map<string,string>, version int, deleted boolean"
ARTIFACTS = ("json", "txt", "ttl")
#: Kind of the entries that say which dataset is active in a role; entries() leaves them out.
ROLE = "role"
#: Versions that a change tries to write before it gives up.
TRIES = 50
SUFFIX = {"parquet": "parquet", "csv": "csv", "json": "json", "jsonl": "json", "txt": "text", "ttl": "text"}


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/entries"))

    # ---- entries

    def _last(self) -> DataFrame:
        """The last version of each entry, deleted ones too."""
        if not self._fs.listStatus(self._path(f"{self.root}/entries")):
            return self.spark.createDataFrame([], ENTRY)
        rows = self.spark.read.schema(ENTRY).json(f"{self.root}/entries")
        return rows.groupBy("id").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "id")), "version").alias("e")).select("id", "e.*")

    def entries(self, kind: str | None = None) -> DataFrame:
        """All entries, newest first, of one kind if asked."""
        rows = self._last().where(~F.col("deleted") & (F.col("kind") != ROLE))
        rows = rows if kind is None else rows.where(F.col("kind") == kind)
        return rows.orderBy(F.desc("created_at"), "id")

    def find(self, kind: str | None = None, **equal: str) -> DataFrame:
        rows = self.entries(kind)
        for k, v in equal.items():
            rows = rows.where((F.col(k) if k in rows.columns else F.col("extra")[k]) == v)
        return rows

    def artifacts(self, kind: str | None = None) -> DataFrame:
        return self.entries(kind).where(F.col("format").isin(*ARTIFACTS))

    def counts(self) -> DataFrame:
        return self.entries().groupBy("kind").agg(F.count("*").alias("n"))

    def recent(self, kind: str, n: int = 5) -> DataFrame:
        return self.entries(kind).limit(n)

    def _entry(self, id_: str) -> dict | None:
        """The last version of an entry, from its own files."""
        found = self._fs.globStatus(self._path(f"{self.root}/entries/{id_}.v*.json"))
        last = max((str(f.getPath().toString()) for f in found), default=None)
        if last is None:
            return None
        row = self.spark.read.schema(ENTRY).json(last).first()
        return None if row is None or row["deleted"] else row.asDict(recursive=True)

    def entry(self, id_: str) -> dict:
        found = self._entry(id_)
        if found is None or found["kind"] == ROLE:
            raise KeyError(id_)
        return found

    def _put(self, entry: dict, version: int = 1) -> bool:
        """Writes a version of an entry; False if another writer has written it."""
        own = self._path(f"{self.root}/entries/{entry['id']}.v{version:08}.json")
        tmp = self._path(f"{self.root}/entries/.{uuid.uuid4().hex}")
        out = self._fs.create(tmp, True)
        out.write(bytearray((json.dumps({"deleted": False} | entry | {"version": version}, sort_keys=True) + "\n").encode()))
        out.close()
        try:
            return self._take(tmp, own)
        finally:
            self._fs.delete(tmp, False)

    def _take(self, new, name) -> bool:
        """Gives a whole file a name in one step, unless the name is taken."""
        from py4j.protocol import Py4JJavaError

        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        taken = "FileAlreadyExistsException"
        try:
            if self._fs.getUri().getScheme() == "file":
                path = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(path(name), path(new))
            else:
                options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._fs.getConf()).rename(new, name, options)
            return True
        except Py4JJavaError as e:
            if taken in str(e.java_exception.getClass().getName()):
                return False
            raise

    def _change(self, id_: str, change) -> None:
        """Writes change(entry) as the next version; where another writer was first, change is made again to what it has left."""
        for _ in range(TRIES):
            e = self._entry(id_)
            if e is None:
                raise KeyError(id_)
            if self._put(change(dict(e)), e["version"] + 1):
                return
        raise RuntimeError(f"{id_} is changed by others all the time")

    def _new(self, name: str, kind: str, fmt: str, owner: str | None, source: str | None, extra: dict | None) -> dict:
        id_ = f"{kind}_{uuid.uuid4().hex[:16]}"
        return {"id": id_, "name": name, "kind": kind, "format": fmt, "path": f"{self.root}/data/{id_}.{fmt}", "owner": owner, "source": source, "created_at": datetime.now(UTC).isoformat(), "extra": {k: str(v) for k, v in (extra or {}).items()}}

    # ---- data

    def save(self, df: DataFrame, name: str, kind: str, owner: str | None = None, source: str | None = None, extra: dict | None = None, fmt: str = "parquet") -> str:
        """Writes a dataset and its entry; the id."""
        e = self._new(name, kind, fmt, owner, source, extra)
        writer = df.write.option("header", True) if fmt == "csv" else df.write
        writer.format(SUFFIX[fmt]).save(e["path"])
        self._put(e)
        return e["id"]

    def save_unless_known(self, df: DataFrame, name: str, kind: str, order: list[str], **more) -> tuple[str, bool]:
        """Saves df unless an entry of the kind has the same content; the id and whether it is new."""
        mark = fingerprint(df, order)
        known = self.find(kind, fingerprint=mark).limit(1).collect()
        if known:
            return known[0].id, False
        more["extra"] = (more.get("extra") or {}) | {"fingerprint": mark}
        return self.save(df, name, kind, **more), True

    def save_json(self, value: dict | list, name: str, kind: str, owner: str | None = None, source: str | None = None, extra: dict | None = None) -> str:
        return self._save_text(json.dumps(value, sort_keys=True), name, kind, "json", owner, source, extra)

    def save_text(self, text: str, name: str, kind: str, ext: str = "txt", owner: str | None = None, source: str | None = None, extra: dict | None = None) -> str:
        return self._save_text(text, name, kind, ext, owner, source, extra)

    def _save_text(self, text, name, kind, fmt, owner, source, extra) -> str:
        e = self._new(name, kind, fmt, owner, source, extra)
        out = self._fs.create(self._path(e["path"]), False)
        out.write(bytearray(text.encode()))
        out.close()
        self._put(e)
        return e["id"]

    def load(self, id_: str) -> DataFrame:
        """The dataset of an entry."""
        e = self.entry(id_)
        reader = self.spark.read.option("header", True) if e["format"] == "csv" else self.spark.read
        return reader.format(SUFFIX[e["format"]]).load(e["path"])

    def load_any(self, id_or_path: str) -> DataFrame:
        """The dataset of an entry, whatever its format, or the table of a path by its ending."""
        found = self.entries().where(F.col("id") == id_or_path).limit(1).collect()
        if not found:
            return read_any(self.spark, id_or_path)
        return self.load(id_or_path) if found[0].format in ("parquet", "csv") else read_any(self.spark, found[0].path)

    def cached(self, mark: str, owner: str | None = None, kind: str = "processed") -> tuple[DataFrame, dict[str, str]] | None:
        """The newest dataset with a fingerprint, the owner's before anyone's, and its map of ids; None if there is none."""
        found = self.find(kind, fingerprint=mark, owner=owner).limit(1).collect() if owner else []
        found = found or self.find(kind, fingerprint=mark).limit(1).collect()
        if not found:
            return None
        ids = self.find("processed_id_map", source=found[0].id).limit(1).collect()
        return self.load(found[0].id), self.load_json(ids[0].id) if ids else {}

    def queries(self, path: str | None = None) -> DataFrame | None:
        """The newest query set of the catalog, else that of a file; None if there is neither."""
        found = self.entries("queries").limit(1).collect()
        if found:
            return read_queries(self.spark, found[0].path)
        return read_queries(self.spark, path) if path else None

    def load_text(self, id_: str) -> str:
        return self.spark.read.text(self.entry(id_)["path"], wholetext=True).first()[0]

    def load_json(self, id_: str):
        return json.loads(self.load_text(id_))

    def load_processed(self, ids: list[str], required: list[str], kinds: tuple[str, ...] = ("processed", "merged")) -> DataFrame:
        """The union by name of datasets of the right kinds, with blanks normalised in text columns; arrays stay arrays."""
        frames = [self.load(i) for i in ids if self.entry(i)["kind"] in kinds]
        if not frames:
            raise ValueError("no processed dataset")
        out = union_by_name(frames)
        missing = [c for c in required if c not in out.columns]
        if missing:
            raise ValueError(f"missing columns: {missing}")
        return out.withColumns({c: T.smart_blank(F.col(f"`{c}`")) for c, t in out.dtypes if t == "string"})

    def load_raw(self, ids: list[str]) -> DataFrame:
        """The raw datasets that entries name as `raw_id` or `source_id`."""
        extra = [self.entry(i)["extra"] or {} for i in ids]
        raw = [e.get("raw_id") or e.get("source_id") for e in extra]
        return union_by_name([self.load(r) for r in dict.fromkeys(raw) if r])

    # ---- changes

    def update(self, id_: str, **fields) -> None:
        """Replaces fields; `extra` is merged key by key."""
        more = {k: str(v) for k, v in (fields.pop("extra", None) or {}).items()}
        self.entry(id_)
        self._change(id_, lambda e: e | fields | {"extra": (e["extra"] or {}) | more})

    def rename(self, id_: str, name: str) -> None:
        self.update(id_, name=name)

    def delete(self, id_: str) -> None:
        """Marks an entry as deleted, then removes its data."""
        e = self.entry(id_)
        self._change(id_, lambda x: x | {"deleted": True})
        self._fs.delete(self._path(e["path"]), True)

    def activate(self, id_: str, role: str = "gazetteer") -> None:
        """Makes an entry the active one of a role; which one is, is kept in one place, so there is never more than one."""
        self.entry(id_)
        pointer = f"{ROLE}_{role}"
        if self._entry(pointer) is None:
            first = {"id": pointer, "name": role, "kind": ROLE, "format": "json", "path": "", "owner": None, "source": id_, "created_at": datetime.now(UTC).isoformat(), "extra": {}}
            if self._put(first):
                return
        self._change(pointer, lambda e: e | {"source": id_})

    def active(self, role: str = "gazetteer") -> str | None:
        """The active entry of a role; the newest of that kind where none was chosen or the chosen one is gone."""
        pointer = self._entry(f"{ROLE}_{role}")
        if pointer is not None and self._entry(pointer["source"]) is not None:
            return pointer["source"]
        found = self.entries(role).limit(1).collect()
        return found[0].id if found else None


def fingerprint(df: DataFrame, order: list[str]) -> str:
    """A digest of column names, types and rows in an order; each row is hashed where it is, and 64-bit hashes with ranks are summed."""
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in order)).alias("k"), F.xxhash64(*(F.coalesce(F.to_json(F.struct(F.col(f"`{c}`"))), F.lit("")) for c in df.columns)).alias("h"))
    sums = rows.agg(F.count("*"), F.sum(F.xxhash64(F.to_json("k"), "h").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("h", F.to_json("k")))).first()
    import hashlib

    return hashlib.sha256(json.dumps([df.dtypes, [str(x) for x in sums]]).encode()).hexdigest()


def with_overrides(entries: DataFrame, overrides: DataFrame) -> DataFrame:
    """Entries without those marked deleted, under their new names; overrides: id, name, deleted."""
    gone = overrides.where("deleted").select("id")
    names = overrides.where("name IS NOT NULL").select("id", F.col("name").alias("__name"))
    return entries.join(gone, "id", "left_anti").join(names, "id", "left").withColumn("name", F.coalesce("__name", "name")).drop("__name")


def history(entries: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """what, id, title, owner, created_at of the artifacts of some kinds; kinds: what is shown for each."""
    table = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    rows = entries.where(F.col("kind").isin(*kinds))
    return rows.select(table[F.col("kind")].alias("what"), "id", F.coalesce(F.col("extra")["title"], "name", "id").alias("title"), "owner", "created_at")
