"""Rows that fail to parse: typed vertex rows from snapshot lines, bad lines with their reason.

Every Arrow batch of lines is read on its worker by DuckDB's CSV reader with a reject table. A batch is
written to an anonymous in-memory file for each entity, every line led by its ordinal and ended by a full stop as a further field (the reader
forgives empty fields at the end of a line), so that accepted rows carry the ordinal and rejected ones are found by byte position. An unclosed quote makes a CSV reader
swallow the lines after it; those are fed again without the culprit until every line is accounted for.
No shuffle takes place, so neither a huge file nor a million tiny ones matter.

What the reader is more lenient about than RFC 4180 (a quote inside an unquoted field) and than the value
rules (signs, blanks, decimals in numbers) is checked in SQL on the same batch.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns of the snapshot files by entity.
ENTITY_COLUMNS = {
    "Person": ("id", "creationDate", "firstName", "lastName"),
    "Post": ("id", "creationDate", "content", "personId"),
    "Comment": ("id", "creationDate", "content", "personId", "replyOf"),
    "Forum": ("id", "title", "creationDate"),
}
MAX_ID = 9223372036854775807
MIN_DATE, END_DATE = 946684800000, 4102444800000  # 2000-01-01 and 2100-01-01 in epoch milliseconds

PARSED = pa.schema(
    [
        ("entity", pa.string()),
        ("file_name", pa.string()),
        ("line_no", pa.int64()),
        ("reason", pa.string()),
        ("detail", pa.string()),
        ("line", pa.string()),
        ("id", pa.int64()),
        ("creationDate", pa.int64()),
        ("props", pa.map_(pa.string(), pa.string())),
    ]
)
PARSED_DDL = "entity string, file_name string, line_no bigint, reason string, detail string, line string, id bigint, creationDate bigint, props map<string,string>"

# A record of RFC 4180 with | for the comma.
_RECORD = r'([^"|]*|"([^"]|"")*")(\|([^"|]*|"([^"]|"")*"))*'

# Line ends inside a line would cut it; private-use characters stand for them while it is read.
_HIDE = str.maketrans("\n\r", "\ue00a\ue00d")
_SHOW = str.maketrans("\ue00a\ue00d", "\n\r")


class LineReader:
    """DuckDB's CSV reader over the lines of one entity, with reject tables."""

    def __init__(self) -> None:
        import duckdb

        self.con = duckdb.connect(config={"threads": 1})

    def _scan(self, lines: list[str], at: np.ndarray, names: tuple[str, ...]) -> tuple[list[tuple], dict[int, tuple[str, str]], set[int]]:
        """Accepted rows, {ordinal: (kind, message)} of rejected lines, the ordinals of all lines that began a record."""
        parts = [f"{k}|{lines[k]}|.\n".encode() for k in at]
        starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        fd = os.memfd_create("lines")
        try:
            with os.fdopen(os.dup(fd), "wb") as f:
                f.write(b"".join(parts))
            longest = max(len(p) for p in parts)
            columns = ", ".join(f"'{c}': 'VARCHAR'" for c in ("weft_k", *names, "weft_end"))
            rows = self.con.execute(
                f"""SELECT * FROM read_csv('/proc/{os.getpid()}/fd/{fd}', columns = {{{columns}}}, delim = '|', quote = '"', escape = '"',
                    header = false, auto_detect = false, null_padding = false, strict_mode = true, new_line = '\\n', parallel = false,
                    max_line_size = {max(2_097_152, int(starts[-1]) + longest)}, store_rejects = true, rejects_limit = 0,
                    rejects_table = 'weft_errors', rejects_scan = 'weft_scans')"""
            ).fetchall()
            errors = self.con.execute("SELECT line_byte_position, error_type::VARCHAR, csv_line, error_message FROM weft_errors").fetchall()
            self.con.execute("DROP TABLE IF EXISTS weft_errors; DROP TABLE IF EXISTS weft_scans")
        finally:
            os.close(fd)
        good, bad, begun = [], {}, set()
        for row in rows:
            k = int(row[0])
            begun.add(k)
            if any(v is not None and "\n" in v for v in row):
                bad[k] = ("quoting", "a quoted field is not closed on its line")
            else:
                good.append(row)
        for position, kind, text, message in errors:
            k = int(at[np.searchsorted(starts, position - 1, side="right") - 1])
            begun.add(k)
            if kind == "UNQUOTED VALUE" or "\n" in (text or "").rstrip("\n"):
                bad[k] = ("quoting", message)
            else:
                bad.setdefault(k, ("columns" if "COLUMNS" in kind else "value", message))
        return good, bad, begun

    def read(self, lines: list[str], names: tuple[str, ...]) -> tuple[list[tuple], dict[int, tuple[str, str]]]:
        """Accepted rows (ordinal as text first) and {ordinal: (reason, message)} of the others.

        Lines without a quote cannot swallow others and are read at once. Of the others those with an even number of quotes come before those with an odd
        one, which always break the layout, so that few lines are swallowed and fed again.
        """
        good: list[tuple] = []
        bad: dict[int, tuple[str, str]] = {}
        quotes = np.array([s.count('"') for s in lines], dtype=np.int64)
        for at in (np.flatnonzero(quotes == 0), np.flatnonzero((quotes > 0) & (quotes % 2 == 0)), np.flatnonzero(quotes % 2 == 1)):
            while len(at):
                rows, errors, begun = self._scan(lines, at, names)
                good += rows
                bad |= errors
                if not begun:  # the first line opened a field that no line after it closes, and only that line is to blame
                    begun = {int(at[0])}
                    bad[int(at[0])] = ("quoting", "a quoted field is not closed")
                at = at[~np.isin(at, np.fromiter(begun, dtype=np.int64))]
        return good, bad

    def lenient(self, lines: list[str]) -> set[int]:
        """Ordinals of the lines with a quote that break RFC 4180."""
        quoted = [k for k, s in enumerate(lines) if '"' in s]
        if not quoted:
            return set()
        self.con.register("weft_lines", pa.table({"k": pa.array(quoted, pa.int64()), "s": pa.array([lines[k] for k in quoted], pa.string())}))
        return {k for (k,) in self.con.execute("SELECT k FROM weft_lines WHERE NOT regexp_full_match(s, ?)", [_RECORD]).fetchall()}

    def typed(self, rows: list[tuple], names: tuple[str, ...]) -> dict[int, tuple[int | None, int | None]]:
        """{ordinal: (id, creationDate)}, None where the field is not a usable number."""
        if not rows:
            return {}
        i, d = 1 + names.index("id"), 1 + names.index("creationDate")
        self.con.register("weft_lines", pa.table({"k": pa.array([int(r[0]) for r in rows], pa.int64()), "i": pa.array([r[i] for r in rows], pa.string()), "d": pa.array([r[d] for r in rows], pa.string())}))
        number = "CASE WHEN regexp_full_match({0}, '0*[0-9]{{1,19}}') THEN TRY_CAST({0} AS BIGINT) END"
        return {
            k: (a, b if b is not None and MIN_DATE <= b < END_DATE else None)
            for k, a, b in self.con.execute(f"SELECT k, {number.format('i')}, {number.format('d')} FROM weft_lines").fetchall()
        }


def _clean(line: str) -> str:
    return line.removeprefix("\ufeff").removesuffix("\r")


def _is_record(line: str, names: tuple[str, ...] | None) -> bool:
    return bool(line.strip()) and (names is None or [f[1:-1] if len(f) > 1 and f[0] == f[-1] == '"' else f for f in line.split("|")] != list(names))


def parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = LineReader()
    for batch in batches:
        files, numbers, raw = (batch.column(c).to_pylist() for c in ("file_name", "line_no", "line"))
        groups: dict[str | None, list[int]] = {}
        entity_of = {f: (f.split("/")[2] if f is not None and f.count("/") >= 2 else None) for f in set(files)}
        for j, f in enumerate(files):
            if raw[j] is not None:
                groups.setdefault(entity_of[f], []).append(j)
        out: list[tuple] = []
        for entity, members in groups.items():
            names = ENTITY_COLUMNS.get(entity or "")
            kept = [(j, s) for j in members if _is_record(s := _clean(raw[j]), names)]
            if names is None:
                out += [(entity, files[j], numbers[j], "entity", "no layout is known for the file", raw[j], None, None, None) for j, _ in kept]
                continue
            lines = [s.translate(_HIDE) if "\n" in s or "\r" in s else s for _, s in kept]
            rows, bad = reader.read(lines, names)
            bad |= {k: ("quoting", bad.get(k, ("", "a quote stands in a field that is not quoted"))[1]) for k in reader.lenient(lines) if bad.get(k, ("",))[0] != "quoting"}
            numbers_of = reader.typed(rows, names)
            for row in rows:
                k = int(row[0])
                if k in bad:
                    continue
                vid, date = numbers_of[k]
                j = kept[k][0]
                if vid is None or date is None:
                    bad[k] = ("value", "id is not usable" if vid is None else "creationDate is not usable")
                else:
                    hidden = lines[k] is not kept[k][1]
                    props = [(n, v.translate(_SHOW) if hidden else v) for n, v in zip(names, row[1:-1], strict=True) if n not in ("id", "creationDate") and v is not None]
                    out.append((entity, files[j], numbers[j], None, None, raw[j], vid, date, props))
            out += [(entity, files[kept[k][0]], numbers[kept[k][0]], reason, message, raw[kept[k][0]], None, None, None) for k, (reason, message) in bad.items()]
        columns = list(zip(*out, strict=True)) if out else [()] * len(PARSED)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PARSED.types, strict=True)], schema=PARSED)


def parse_snapshot(raw: DataFrame) -> DataFrame:
    """Every record line of ``raw`` (file_name, line_no, line), typed or with the reason it is bad.

    The entity is the third part of file_name. Good rows have reason null, id, creationDate and the other
    fields as props (empty unquoted fields are absent); bad rows have reason ``quoting``, ``columns`` or ``value`` (first that
    applies) and the reader's message in detail. A file of no known entity gives reason ``entity``.
    Null and blank lines and header lines give no row; repeated rows stay repeated; an empty table gives an empty
    result; further columns of ``raw`` are ignored; lines may be of any length.
    """
    return raw.select("file_name", "line_no", "line").mapInArrow(parse_batches, PARSED_DDL)


def vertices(parsed: DataFrame) -> DataFrame:
    """Typed vertex rows: vid, labels, props with creationDate, as the graph model has them."""
    labels: Column = F.when(F.col("entity").isin("Post", "Comment"), F.array(F.col("entity"), F.lit("Message"))).otherwise(F.array(F.col("entity")))
    return parsed.filter(F.col("reason").isNull()).select(
        F.col("id").alias("vid"), labels.alias("labels"), F.map_concat(F.col("props"), F.create_map(F.lit("creationDate"), F.col("creationDate").cast("string"))).alias("props"), "file_name", "line_no"
    )


def bad_lines(parsed: DataFrame) -> DataFrame:
    """file_name, line_no, reason of each bad line, once."""
    return parsed.filter(F.col("reason").isNotNull()).select("file_name", "line_no", "reason").distinct()
