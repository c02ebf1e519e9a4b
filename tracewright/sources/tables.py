"""Table scans with explicit schemas where Parquet does not carry one, and archive and package readers."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ignored_entry, modality

COMPONENT = "fresh_id string, project_id string, slug string, title string, role string, license string, release_kind string, version_id string, version_number string, jar_filename string, relative_path string, modality string, size_bytes long, compressed_size_bytes long, component_sha256 string"


class Tables:
    """The Parquet tables of one folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header (and possibly a byte-order mark), by explicit schema."""
    return spark.read.csv(path, header=True, schema=schema, encoding="UTF-8", enforceSchema=True)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema)


def read_clone_pairs(spark: SparkSession, path: str) -> DataFrame:
    """XML clone reports: one row a ``clone`` element, its sources as an array."""
    source = "array<struct<_file:string,_startline:long,_endline:long>>"
    return spark.read.format("xml").option("rowTag", "clone").schema(f"_similarity int, _nlines int, source {source}").load(path)


#: Bytes of payload that one batch of archive entries holds, beyond a single entry.
ENTRY_BATCH = 8 << 20
_ENTRY_COLUMNS = ["archive", "entry", "size_bytes", "compressed_size_bytes", "component_sha256", "payload"]
_ENTRY_SCHEMA = "archive string, entry string, size_bytes long, compressed_size_bytes long, component_sha256 string, payload binary"


def _entry_rows(path: str, content: bytes, wanted: set[str] | None = None):
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for entry in archive.infolist():
            if not entry.is_dir() and (wanted is None or entry.filename in wanted):
                data = archive.read(entry)
                yield path, entry.filename, entry.file_size, entry.compress_size, hashlib.sha256(data).hexdigest(), data


def _batched(rows):
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= ENTRY_BATCH:
            yield pd.DataFrame(held, columns=_ENTRY_COLUMNS)
            held, size = [], 0
    yield pd.DataFrame(held, columns=_ENTRY_COLUMNS)


def _entries(frames):
    for frame in frames:
        yield from _batched(row for path, content in zip(frame["path"], frame["content"]) for row in _entry_rows(path, content))


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def entries_of(archives: DataFrame) -> DataFrame:
    """A row for each entry of each zip archive (path, content), opened once."""
    return archives.select("path", "content").mapInPandas(_entries, _ENTRY_SCHEMA)


def read_archives(spark: SparkSession, path: str, pattern: str = "*.jar") -> DataFrame:
    return entries_of(_files(spark, path, pattern))


def component_entries(entries: DataFrame) -> DataFrame:
    """Entries that are components: of a known modality, and no packaging or file-system noise."""
    kept = entries.where(~ignored_entry(F.col("entry"))).withColumn("modality", modality(F.col("entry")))
    return kept.where("modality is not null")


def read_entries(archives: DataFrame, wanted: DataFrame) -> DataFrame:
    """The entries of ``wanted`` (archive, entry), each archive (path, content) being opened once for all of
    its own; what is not there has no row."""
    lists = wanted.groupBy(F.col("archive").alias("path")).agg(F.collect_set("entry").alias("entries"))  # of one archive

    def run(frames):
        for frame in frames:
            yield from _batched(row for path, content, names in zip(frame["path"], frame["content"], frame["entries"]) for row in _entry_rows(path, content, set(names)))

    return archives.join(lists, "path").select("path", "content", "entries").mapInPandas(run, _ENTRY_SCHEMA)


def packages_of(archives: DataFrame, components: int = 7) -> DataFrame:
    """Query packages: the manifest of each zip (path, content) with its components' payload hashes, and in
    ``problem`` why a package is not as it should be: its name is not its query, components are not as many
    as there should be, or a payload is missing."""
    entries = entries_of(archives)
    schema = "query_id string, components array<struct<node_id:string,modality:string,payload_relpath:string>>"
    manifest = entries.where("entry = 'manifest.json'").select("archive", F.from_json(F.col("payload").cast("string"), schema).alias("m"))
    n = F.coalesce(F.size("m.components"), F.lit(0))
    named = F.regexp_extract("archive", "([^/]*)[.]zip$", 1)
    problem = F.when(F.col("m.query_id").isNull() | (named != F.col("m.query_id")), "QUERY_ID").when(n != components, "COMPONENTS")
    nodes = manifest.select("archive", F.col("m.query_id").alias("query_id"), problem.alias("problem"), F.inline_outer("m.components"))
    payload = entries.select("archive", F.col("entry").alias("payload_relpath"), "component_sha256", "size_bytes")
    joined = nodes.join(payload, ["archive", "payload_relpath"], "left")
    return joined.withColumn("problem", F.coalesce("problem", F.when(F.col("component_sha256").isNull(), "PAYLOAD")))


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    return packages_of(_files(spark, path, "*.zip"))


def build_packages(components: DataFrame) -> DataFrame:
    """(path, content) of a zip a query, from rows (query_id, node_id, modality, payload): the payloads and a
    manifest.  Equal rows give equal bytes."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group, out = group.sort_values("node_id"), io.BytesIO()
        query = str(group["query_id"].iloc[0])
        listed = [{"node_id": str(n), "modality": m, "payload_relpath": f"payloads/{n}"} for n, m in zip(group["node_id"], group["modality"])]
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for name, data in (("manifest.json", json.dumps({"query_id": query, "components": listed}).encode()), *((c["payload_relpath"], p) for c, p in zip(listed, group["payload"]))):
                archive.writestr(zipfile.ZipInfo(name), data)
        return pd.DataFrame({"path": [f"{query}.zip"], "content": [out.getvalue()]})

    rows = components.select(F.col("query_id").cast("string").alias("query_id"), F.col("node_id").cast("string").alias("node_id"), "modality", "payload")
    return rows.groupBy("query_id").applyInPandas(build, "path string, content binary")  # a package's components


def write_payloads(components: DataFrame, path: str) -> DataFrame:
    """Payloads as a table of (component_sha256, payload), written, read back and hashed again; a payload
    that is not what its hash says is an error."""
    components.select("component_sha256", "payload").dropDuplicates(["component_sha256"]).write.mode("overwrite").parquet(path)
    back = components.sparkSession.read.parquet(path)
    wrong = back.where(F.sha2("payload", 256) != F.col("component_sha256")).select("component_sha256").first()
    if wrong:
        raise ValueError(f"payload is not {wrong[0]}")
    return back


def located(wanted: DataFrame, listing: DataFrame, roots: list[str]) -> DataFrame:
    """The file of each wanted component (id, name, sha, size) in a listing (path, size, sha): one of that
    name, size and hash, under the earliest of the roots, then by path; null if there is none."""
    root = F.lit(len(roots))
    for k, r in reversed(list(enumerate(roots))):
        root = F.when(F.col("path").startswith(r.rstrip("/") + "/"), k).otherwise(root)
    files = listing.select("path", F.substring_index("path", "/", -1).alias("name"), "size", "sha", root.alias("root"))
    found = wanted.join(files, ["name", "size", "sha"], "left").groupBy("id").agg(F.min(F.when(F.col("path").isNotNull(), F.struct("root", "path"))).alias("best"))
    return found.select("id", F.col("best.path").alias("path"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _write_file(spark: SparkSession, path: str, data: bytes) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_report_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a byte-order mark: for reports, whose rows the driver holds."""
    _write_file(df.sparkSession, path, df.toPandas().to_csv(index=False).encode("utf-8-sig"))


def write_json_document(spark: SparkSession, document, path: str) -> None:
    _write_file(spark, path, json.dumps(document, indent=2, ensure_ascii=False).encode())


def read_json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON document (an object, or a row an element of an array)."""
    return spark.read.json(path, multiLine=True, schema=schema)


def read_listing(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(mode, type, object, path) of a source tree listing, a line an entry (``mode type object<tab>path``, as
    ``git ls-tree -r`` prints); only paths with one of the suffixes, if any are given; other lines go."""
    line = r"^(\d+) (\w+) ([0-9a-f]+)(?: +[-\d]+)?\t(.+)$"
    one = lambda k: F.regexp_extract("value", line, k)
    out = spark.read.text(path).where(F.col("value").rlike(line)).select(one(1).alias("mode"), one(2).alias("type"), one(3).alias("object"), one(4).alias("path"))
    return out.where(F.substring_index(F.lower("path"), ".", -1).isin(*[s.lstrip(".").lower() for s in suffixes])) if suffixes else out
