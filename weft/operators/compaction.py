"""Far too many small files: consolidation into few, sorted, well-sized ones.

The files are parsed on their workers, repeats within a batch removed there, and the records staged in the
shared folder with those that cannot be used and why. Records are range-partitioned by (entity, id) at boundaries sampled from the staged
records, into as many parts as the bytes of each entity ask for, which also brings all
copies of a record together, sorted and written to a new folder. The records read, set aside and written and a checksum of their fields
are reconciled before the folder takes the place of the old one.
"""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from weft.operators.rejects import ENTITY_COLUMNS
from weft.session import hadoop_fs, scratch_path, stage

RECORDS_DDL = "entity string, id bigint, fields map<string,string>, path string, written_at bigint, bytes bigint, copies bigint, reason string"
_FIELDS = pa.map_(pa.string(), pa.string())
#: Bytes of record text that a data file shall hold.
TARGET_BYTES = 128 << 20


def records_of(body: str, names: tuple[str, ...]) -> Iterator[dict[str, str] | None]:
    """The records of a file's body, by column name; None for one with another number of fields.

    A first line made of the entity's column names, in any order and case, gives the columns' order; otherwise it is that of
    ``names``. A byte order mark and blank lines are passed over.
    """
    rows = csv.reader(io.StringIO(body.removeprefix("\ufeff"), newline=""), delimiter="|", quotechar='"', doublequote=True)
    known = {n.lower(): n for n in names}
    columns = list(names)
    first = True
    for row in rows:
        if not row or row == [""]:
            continue
        if first and sorted(f.strip().lower() for f in row) == sorted(known):
            columns = [known[f.strip().lower()] for f in row]
        else:
            yield dict(zip(columns, row, strict=True)) if len(row) == len(names) else None
        first = False


def _bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def _parse(path: str | None, body: str | None) -> Iterator[tuple[str | None, int | None, dict[str, str], str | None]]:
    """Entity, id, other fields and the reason it is set aside, of each record."""
    parts = (path or "").split("/")
    entity = parts[2] if len(parts) > 2 else None
    names = ENTITY_COLUMNS.get(entity or "")
    if not body:
        return
    if names is None:
        yield entity, None, {}, "entity"
        return
    for record in records_of(body, names):
        if record is None:
            yield entity, None, {}, "columns"
            continue
        vid = record.pop("id")
        if vid.isascii() and vid.isdigit() and int(vid) < 1 << 63:
            yield entity, int(vid), record, None
        else:
            yield entity, None, {"id": vid} | record, "value"


def parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    csv.field_size_limit(2**62)
    for batch in batches:
        best: dict[tuple, list] = {}
        aside: list[tuple] = []
        for path, written, body in zip(*(batch.column(c).to_pylist() for c in ("path", "written_us", "body")), strict=True):
            at = written if written is not None else -1
            for entity, vid, record, reason in _parse(path, body):
                if reason:
                    aside.append((entity, None, record, path, at, 0, 1, reason))
                    continue
                old = best.get((entity, vid))
                if old is None or old[0] < (at, path):
                    best[entity, vid] = [(at, path), [record], 1 + (old[2] if old else 0)]
                else:
                    old[2] += 1
                    # copies as new as each other stay for the ranking over all files to choose
                    if old[0] == (at, path) and record not in old[1]:
                        old[1].append(record)
        rows = [(e, k, r, v[1], v[0], sum(_bytes(x) + 1 for x in r.values()) + 20, 0 if i else n, None) for (e, k), (v, kept, n) in best.items() for i, r in enumerate(kept)] + aside
        columns = list(zip(*rows, strict=True)) if rows else [()] * 8
        types = (pa.string(), pa.int64(), _FIELDS, pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        names = ["entity", "id", "fields", "path", "written_at", "bytes", "copies", "reason"]
        yield pa.RecordBatch.from_arrays([pa.array([list(x.items()) for x in c] if n == "fields" else c, t) for n, c, t in zip(names, columns, types, strict=True)], names=names)


def read_part_files(files: DataFrame) -> DataFrame:
    """entity, id, fields, path, written_at (epoch microseconds), bytes, copies, reason of the records of ``files`` (path, written_at, body).

    The entity is the third part of path. Within a batch of files the last written copy of a record is kept and ``copies`` tells how many there were;
    ``bytes`` are those of its text in UTF-8. A record that cannot be used has no id and its reason: ``columns`` (another number of fields), ``value`` (no
    usable id), ``entity`` (a file of no known entity, as one record). Empty or null bodies give no row.
    """
    epoch = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(written_at as timestamp_ntz))")
    return files.select("path", epoch.alias("written_us"), "body").mapInArrow(parse_files, RECORDS_DDL)


def _mark() -> Column:
    """A checksum of a record's fields, whatever their order."""
    return F.xxhash64(F.array_sort(F.map_entries("fields")))


def consolidate(files: DataFrame, out: str, target_bytes: int = TARGET_BYTES) -> dict[str, int]:
    """Write the records of ``files``, each once, below ``out`` in a folder per entity; returns the reconciled counts.

    ``read`` records are ``repeats`` of others, ``rejected`` or ``records`` written. Of several copies of a record the last written is kept, of those the
    greatest path, of those the one whose fields have the greatest hash. An entity gets a part for each ``target_bytes`` begun. A run that fails leaves
    ``out`` as it was; an existing ``out`` is replaced only after the new folder agrees with the records read, fields included.
    No record at all writes an empty data set.
    """
    spark = files.sparkSession
    staged = stage(read_part_files(files), "records")
    good = staged.filter(F.col("reason").isNull())
    # a row for each known entity
    sizes = staged.groupBy("entity").agg(F.sum("copies").alias("n"), F.sum(F.when(F.col("reason").isNotNull(), F.col("copies")).otherwise(0)).alias("rejected"), F.sum("bytes").alias("bytes"))
    sizes = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("rejected"), F.lit(0)), F.coalesce(F.sum(F.ceil(F.col("bytes") / target_bytes)), F.lit(0))).first()
    read, rejected, parts = int(sizes[0]), int(sizes[1]), max(1, int(sizes[2]))
    last = Window.partitionBy("entity", "id").orderBy(F.col("written_at").desc(), F.col("path").desc(), F.col("mark").desc())
    ranged = good.select("entity", "id", "fields", "written_at", "path").repartitionByRange(parts, "entity", "id").withColumn("mark", _mark())
    once = ranged.withColumn("__rank", F.row_number().over(last)).filter(F.col("__rank") == 1)
    new, seen = f"{out}.new-{uuid.uuid4().hex[:8]}", Observation()
    once.sortWithinPartitions("entity", "id").observe(seen, _total().alias("mark")).select("entity", "id", "fields").write.partitionBy("entity").parquet(new)
    records = _reconcile(spark, good, seen.get["mark"], new)
    _swap(spark, new, out)
    return {"read": read, "rejected": rejected, "repeats": read - rejected - records, "records": records, "parts": parts}


def read_consolidated(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("id bigint, fields map<string,string>, entity string").parquet(out)


def _total() -> Column:
    return F.sum(F.xxhash64("entity", "id", "mark").cast("decimal(38,0)"))


def _reconcile(spark: SparkSession, good: DataFrame, chosen, new: str) -> int:
    """Compare the folder with the keys that were read and with the checksum of the records chosen, fields included; raises if they differ.

    The keys are found by aggregation, apart from the ranking that chose the records.
    """
    keys = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("entity", "id").cast("decimal(38,0)")).alias("keys"))
    want = keys(good.groupBy("entity", "id").agg(F.lit(1))).first()
    got = read_consolidated(spark, new).withColumn("mark", _mark()).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("entity", "id").cast("decimal(38,0)")).alias("keys"), _total().alias("mark")).first()
    if (want["n"], want["keys"], chosen) != (got["n"], got["keys"], got["mark"]):
        raise RuntimeError(f"consolidation lost, doubled or changed records: {want['n']} to be kept, {got['n']} written")
    return int(got["n"])


def _swap(spark: SparkSession, new: str, out: str) -> None:
    fs, target = hadoop_fs(spark, out)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    old = path(f"{out}.old-{uuid.uuid4().hex[:8]}")
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise RuntimeError(f"cannot move {out} aside")
    if not fs.rename(path(new), target):
        if had:
            fs.rename(old, target)
        raise RuntimeError(f"cannot move {new} to {out}")
    if had:
        fs.delete(old, True)


def consolidated(files: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Consolidate into a new folder of the shared scratch space and read it."""
    out = scratch_path(files.sparkSession, "consolidated")
    consolidate(files, out, target_bytes)
    return read_consolidated(files.sparkSession, out)
