"""Tables of a graph as layers of Parquet files, and one numbered version that names them all.

A table is a snapshot and changes on top of it, each in a folder of its own. A change to
a table with keys holds the new rows of the keys that it touches, and a mark for keys that are gone; a
change to a table of counts holds differences. Reading merges the layers: of each key the newest
counts, and counts are summed. So a batch writes what it changes and not the whole graph.

Layers are merged when they come to be of like size (``compact``): a layer always has at least twice
the bytes of those above it together, so there are logarithmically many, and a row is
rewritten logarithmically often.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.plans.schemas import COUNTS, KEYS, TABLES

VERSIONS = "_versions"


class Conflict(RuntimeError):
    """Another writer has changed a table since it was read."""


@dataclass(frozen=True)
class Version:
    """A number, the layers of each table from the lowest up, and small values (``meta``) that change with them."""

    number: int = -1
    tables: dict[str, list[str]] = field(default_factory=dict)
    meta: dict[str, int] = field(default_factory=dict)


class Store:
    """A folder with a folder for each layer of each table. Version files, numbered upwards, say which
    layers of each table hold; the greatest number counts. A version appears at once after all its
    layers are written, so a write that fails at any point leaves all tables as they were, and tables saved
    together change together. Writers may compete: a version is only made once, and who comes late tries the next number
    if the tables it writes are still as it read them, else gets a Conflict. The folder may be in any store that Spark writes to."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        found = jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), found

    def _numbers(self) -> list[int]:
        fs, path = self._fs(f"{self.folder}/{VERSIONS}")
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _read(self, number: int) -> Version:
        fs, path = self._fs(f"{self.folder}/{VERSIONS}/{number:012d}")
        stream = fs.open(path)
        try:
            return Version(number, **json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def current(self) -> Version:
        numbers = self._numbers()
        return self._read(numbers[-1]) if numbers else Version()

    def exists(self, table: str) -> bool:
        return table in self.current().tables

    def load(self, table: str, version: Version | None = None) -> DataFrame:
        """The table as it is now, or was at a version; empty where it was never written."""
        names = (version or self.current()).tables.get(table)
        return self.merged(table, names) if names else self.spark.createDataFrame([], TABLES[table])

    def layer(self, table: str, name: str) -> DataFrame:
        """One layer, with ``_gone`` for keys that it removes."""
        found = self.spark.read.parquet(f"{self.folder}/{table}/{name}")
        return found if "_gone" in found.columns else found.withColumn("_gone", F.lit(False))

    def merged(self, table: str, names: list[str], keep_gone: bool = False) -> DataFrame:
        """The rows of layers, from the lowest up; keep_gone: with ``_gone`` rows, for a layer that lies on others."""
        parts = [self.layer(table, n) for n in names]
        columns = [c for c in parts[0].columns if not c.startswith("_")]
        if table in COUNTS:
            key, count = COUNTS[table]
            if len(parts) == 1:
                return parts[0].select(key, count)
            every = parts[0].select(key, count)
            for part in parts[1:]:
                every = every.unionByName(part.select(key, count))
            return every.groupBy(key).agg(F.sum(count).alias(count)).where(F.col(count) != 0)
        keys, out = KEYS.get(table, []), [*columns, "_gone"]
        rows = parts[0].select(*out)
        if len(parts) > 1:  # the changes are small beside what lies below them
            changes = None
            for n, part in enumerate(parts[1:]):
                part = part.select(*out, F.lit(n).alias("_n"))
                changes = part if changes is None else changes.unionByName(part)
            newest = changes.groupBy(*keys).agg(F.max("_n").alias("_n"))
            rows = rows.join(newest.select(*keys), keys, "left_anti").select(*out).unionByName(changes.join(newest, [*keys, "_n"]).select(*out))
        return rows if keep_gone else rows.where("NOT _gone").select(*columns)

    def stage(self, table: str, df: DataFrame) -> str:
        """Writes a layer that no reader sees before ``commit``, and gives its name."""
        name = f"layer-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{table}/{name}")
        return name

    def size(self, table: str, name: str) -> int:
        fs, path = self._fs(f"{self.folder}/{table}/{name}")
        return fs.getContentSummary(path).getLength()

    def discard(self, names: dict[str, str]) -> None:
        """Deletes staged layers that won't be committed."""
        for table, name in names.items():
            fs, path = self._fs(f"{self.folder}/{table}/{name}")
            fs.delete(path, True)

    def _publish(self, number: int, text: str) -> bool:
        """Makes a version file, whole and only if there is none of that number."""
        fs, draft = self._fs(f"{self.folder}/{VERSIONS}/.{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        _, target = self._fs(f"{self.folder}/{VERSIONS}/{number:012d}")
        if fs.getScheme() == "file":  # here a rename would replace what is there, a link doesn't
            nio = self.spark.sparkContext._jvm.java.nio.file
            place = lambda p: nio.Paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.java.lang.String, 0))
            try:
                nio.Files.createLink(place(target), place(draft))
                made = True
            except Exception as error:
                if "FileAlreadyExists" not in str(error):
                    raise
                made = False
            fs.delete(draft, False)
            return made
        made = not fs.exists(target) and fs.rename(draft, target)
        if not made:
            fs.delete(draft, False)
        return made

    def commit(self, names: dict[str, str] | None = None, added: dict[str, str] | None = None, merged: dict[str, tuple[list[str], str]] | None = None, meta: dict[str, int] | None = None, seen: Version | None = None) -> Version:
        """Makes staged layers current, all at once. names: whole new tables; added: changes on top; merged: layers that one
        stands for. seen: the version that the writer read; if another has changed one of its tables since, Conflict."""
        names, added, merged = names or {}, added or {}, merged or {}
        while True:
            now = self.current()
            if seen is not None:
                for table in {*names, *added, *(merged if not names and not added else ())}:
                    if now.tables.get(table) != seen.tables.get(table):
                        raise Conflict(f"{table} of {self.folder} has changed since version {seen.number}")
            tables = {t: list(layers) for t, layers in now.tables.items()} | {t: [n] for t, n in names.items()}
            for table, name in added.items():
                tables.setdefault(table, []).append(name)
            for table, (old, name) in merged.items():
                at = tables[table].index(old[0])
                if tables[table][at : at + len(old)] != old:
                    raise Conflict(f"layers of {table} have been merged by another")
                tables[table][at : at + len(old)] = [name]
            version = Version(now.number + 1, tables, now.meta | (meta or {}))
            if self._publish(version.number, json.dumps({"tables": version.tables, "meta": version.meta}, sort_keys=True)):
                return version

    def save(self, table: str, df: DataFrame, dry_run: bool = False, seen: Version | None = None) -> int | None:
        """Writes one whole table as a version of its own; a dry run only counts the rows."""
        if dry_run:
            return df.count()
        self.commit({table: self.stage(table, df)}, seen=seen)
        return None

    def update(self, table: str, change, tries: int = 20) -> DataFrame:
        """Saves change(table as it is); where another writer was faster, the change is made again on what that one left."""
        for _ in range(tries):
            seen = self.current()
            name = self.stage(table, change(self.load(table, seen)))
            try:
                return self.load(table, self.commit({table: name}, seen=seen))
            except Conflict:
                self.discard({table: name})
        raise Conflict(f"{table} of {self.folder} changed {tries} times")

    def compact(self, tables: list[str] | None = None) -> int:
        """Merges the upper layers of each table that are less than twice as large as those above them together; gives the bytes written."""
        written = 0
        for table in tables or [*KEYS, *COUNTS]:
            seen = self.current()
            layers = seen.tables.get(table, [])
            sizes = [self.size(table, n) for n in layers]
            at, total = len(layers) - 1, sizes[-1] if sizes else 0
            while at > 0 and sizes[at - 1] < 2 * total:
                at -= 1
                total += sizes[at]
            if len(layers) - at < 2:
                continue
            name = self.stage(table, self.merged(table, layers[at:], keep_gone=at > 0))
            written += self.size(table, name)
            try:
                self.commit(merged={table: (layers[at:], name)})
            except Conflict:
                self.discard({table: name})
        return written

    def clean(self, keep: int = 2) -> int:
        """Deletes layers and versions older than the last ``keep`` versions, for times when nobody reads them or
        writes; gives the number of layers deleted."""
        if keep < 1:
            raise ValueError("the current version has to stay")
        numbers = self._numbers()
        named = lambda part: {(t, n) for number in part for t, layers in self._read(number).tables.items() for n in layers}
        gone = named(numbers[:-keep]) - named(numbers[-keep:])
        for table, name in gone:
            self.discard({table: name})
        for number in numbers[:-keep]:
            fs, path = self._fs(f"{self.folder}/{VERSIONS}/{number:012d}")
            fs.delete(path, False)
        return len(gone)

    def load_graph(self) -> dict[str, DataFrame]:
        return {t: self.load(t) for t in ("records", "edges")}


def index(store: Store, incoming: DataFrame, as_of: str, vocabulary=None, dry_run: bool = False) -> dict:
    """Classifies incoming records, upserts them, makes edges near them again, and counts tokens by difference.

    Rows without an ingest_ordinal get the next ones in order of arrival. What is written grows with the
    batch. A dry run computes the same counts over staged layers that it deletes; the store stays as it was."""
    from quillgraph.operators.classify import classify
    from quillgraph.operators.lifecycle import changed
    from quillgraph.plans.schemas import as_records

    seen = store.current()
    records = store.load("records", seen)
    known = store.load("token_df", seen) if "token_df" in seen.tables else None
    following = seen.meta.get("next_ordinal", 0)
    classified = as_records(classify(incoming, vocabulary, known))
    classified = classified.withColumn("ingest_ordinal", F.coalesce("ingest_ordinal", F.lit(following) + F.monotonically_increasing_id()))
    # Written and read back: later steps see each row, and its ordinal, once made.
    arrived = {"arrived": store.stage("arrived", classified)}
    try:
        own = store.layer("arrived", arrived["arrived"]).drop("_gone")
        fresh = changed(records.join(own.select("id").distinct(), "id", "left_semi"), own, as_of)
        last = own.agg(F.max("ingest_ordinal")).first()[0]
        name = store.stage("records", fresh.withColumn("_gone", F.lit(False)))
        lost = own.select("id").join(store.layer("records", name), "id", "left_anti").join(records, "id", "left_anti").count()
        if lost:
            store.discard({"records": name})
            raise RuntimeError(f"{lost} incoming records would be lost")
        return _put(store, seen, name, as_of, dry_run, max(following, (last if last is not None else -1) + 1))
    finally:
        store.discard(arrived)


def remove(store: Store, ids: DataFrame, as_of: str, dry_run: bool = False) -> dict:
    """Deletes the records of ``ids`` (id) with their edges and counts; not_found: how many there are not."""
    seen = store.current()
    records = store.load("records", seen)
    wanted = ids.select("id").distinct()
    name = store.stage("records", records.join(wanted, "id", "left_semi").withColumn("_gone", F.lit(True)))
    return _put(store, seen, name, as_of, dry_run) | {"not_found": wanted.join(records, "id", "left_anti").count()}


def archive(store: Store, ids: DataFrame, as_of: str, archived: bool = True, dry_run: bool = False) -> dict:
    """Sets or clears the mark of the records of ``ids`` (id); edges and counts stay."""
    seen = store.current()
    records = store.load("records", seen)
    wanted = ids.select("id").distinct()
    touched = records.join(wanted, "id", "left_semi").where(F.coalesce("archived", F.lit(False)) != archived)
    name = store.stage("records", touched.withColumns({"archived": F.lit(archived), "_gone": F.lit(False)}))
    n = store.layer("records", name).count()
    if dry_run or not n:
        store.discard({"records": name})
    else:
        store.commit(added={"records": name}, seen=seen)
        store.compact(["records"])
    return {"changed": n, "not_found": wanted.join(records, "id", "left_anti").count(), "dry_run": dry_run}


def _put(store: Store, seen: Version, name: str, as_of: str, dry_run: bool, following: int | None = None) -> dict:
    """Commits a staged change of records together with what it changes of edges, meeting keys and token counts."""
    from quillgraph.operators.learning import frequency_change
    from quillgraph.operators.relations import KEY, edges_near, meeting_keys

    records, edges = store.load("records", seen), store.load("edges", seen)
    delta = store.layer("records", name)
    fresh, touched = delta.where("NOT _gone").select(*records.columns), delta.select("id")
    names = {"records": name}
    try:
        names["token_df"] = store.stage("token_df", frequency_change(records.join(touched, "id", "left_semi"), fresh))
        gone = delta.where("_gone").select("id", F.lit("").alias("k"), F.lit(True).alias("_gone"))
        keys = meeting_keys(fresh).withColumn("_gone", F.lit(False))
        # a record that has no keys now must not keep those it had
        bare = fresh.select("id", F.lit("").alias("k"), F.lit(False).alias("_gone"))
        names["meeting"] = store.stage("meeting", keys.unionByName(bare).unionByName(gone))
        after = records.join(touched, "id", "left_anti").unionByName(fresh)
        kept = store.merged("meeting", [*seen.tables.get("meeting", []), names["meeting"]]).where("k != ''")
        near = edges_near(edges, after, touched, as_of, kept=kept)
        was = edges.join(touched.withColumnRenamed("id", "source"), "source", "left_semi").select(*KEY).union(edges.join(touched.withColumnRenamed("id", "target"), "target", "left_semi").select(*KEY)).distinct()
        both = near.withColumn("_new", F.lit(True)).join(was.withColumn("_old", F.lit(True)), KEY, "full_outer").withColumn("_gone", F.col("_new").isNull())
        names["edges"] = store.stage("edges", both.select(*edges.columns, "_gone", "_old"))
        own = store.layer("edges", names["edges"]).agg(F.count_if(F.col("_old").isNull()).alias("more"), F.count_if("_gone").alias("less")).first()
        held = delta.join(records.select("id"), "id", "left_semi").count()
        count = delta.agg(F.count_if(~F.col("_gone")).alias("live"), F.count_if("_gone").alias("gone")).first()
        meta = {"records": seen.meta.get("records", 0) + count["live"] - (held - count["gone"]) - count["gone"], "edges": seen.meta.get("edges", 0) + own["more"] - own["less"]}
        if following is not None:
            meta["next_ordinal"] = following
        result = {"records": meta["records"], "edges": meta["edges"], "dry_run": dry_run}
        if not dry_run:
            store.commit(added=names, meta=meta, seen=seen)
    except BaseException:
        store.discard(names)
        raise
    if dry_run:
        store.discard(names)
    else:
        store.compact()
    return result


def learn(store: Store) -> int:
    """A full mining pass over the stored records; adds unseen proposals as pending and gives their number."""
    from quillgraph.operators.learning import full_pass, unseen_proposals

    known = store.load("proposals")
    fresh = unseen_proposals(full_pass(store.load("records"))["proposals"], known)
    rows = fresh.select(F.lit("pending").alias("status"), "value", "source", F.lit(None).cast("string").alias("field"), "confidence")
    n = rows.count()
    if n:
        store.save("proposals", known.unionByName(rows))
    return n
