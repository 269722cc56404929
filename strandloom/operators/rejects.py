"""Loading of delimited text records with typed rows on one side and rejected lines with their reasons on the other."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.dna import bind

#: The fields of the two kinds of record.
FIELDS = {
    "read": ["read_id", "comment", "seq", "qual", "is_fastq"],
    "layout": ["id", "seq", "expected_length", "type", "class", "whitelist", "flags"],
}

#: Value rules in DuckDB SQL; a record failing any of them is rejected as 'value'.
RULES = {
    "read": """regexp_full_match(seq, '[ACGTNacgtn]+') AND (
        (is_fastq = 'false' AND qual = '')
        OR (is_fastq = 'true' AND length(qual) = length(seq) AND regexp_full_match(qual, '[!-~]+')))""",
    "layout": """(expected_length = '' OR regexp_full_match(expected_length, '0*[1-9][0-9]*(-0*[1-9][0-9]*)?'))
        AND type IN ('static', 'variable') AND regexp_full_match(seq, '[ACGTN]*')""",
}

#: A record whose quoting is in order. Possessive, so that it runs in linear time.
_FIELD = r'(?:"(?:[^"]|"")*+"|[^",]*+)'
_RECORD = re.compile(rf"{_FIELD}(?:,{_FIELD})*+")
_CUT = re.compile(r'"((?:[^"]|"")*+)"|([^",]*+)')

#: Stand-ins for line breaks within a record while it lies in a file of one line each (private-use characters).
_LF, _CR = "\ue00a", "\ue00d"

#: Lines longer than this are judged by the grammar alone; the reader needs a buffer of several such lines.
LONG_LINE = 1 << 20

#: Types by which the reader itself tells a bad value; all other fields are text.
TYPED = {"is_fastq": "ENUM('true', 'false')", "type": "ENUM('static', 'variable')"}
#: The reader's kinds of error and the reasons they stand for, the first that applies to a line counts.
ERRORS = {"UNQUOTED VALUE": "quoting", "MISSING COLUMNS": "columns", "TOO MANY COLUMNS": "columns", "CAST": "value"}
#: Fixed value: a last field of every line, so that an empty field too many is one.
_END = "E"

SCHEMA = (
    "line_id bigint, kind string, reason string, judge string, raw string, read_id string, comment string, seq string, qual string, "
    "is_fastq boolean, element string, expected_length string, min_length bigint, max_length bigint, type string, "
    "class string, whitelist string, flags string"
)


def split_record(line: str) -> list[str] | None:
    """Fields of one record by the exact grammar, or None where its quoting is broken."""
    if not _RECORD.fullmatch(line):
        return None
    out, at = [], 0
    while True:
        m = _CUT.match(line, at)
        out.append(m[2] if m[1] is None else m[1].replace('""', '"'))
        at = m.end()
        if at >= len(line):
            return out
        at += 1


def _bare(line: str) -> str:
    line = line[1:] if line.startswith("\ufeff") else line
    return line[:-1] if line.endswith("\r") else line


def field_of(line: Column, at: int) -> Column:
    """One field of a record by the exact grammar, as an expression; null where there is none or the quoting is broken."""
    one = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
    bare = F.regexp_replace(F.regexp_replace(line, "^\ufeff", ""), "\r$", "")
    plain = lambda x: F.when(F.startswith(x, F.lit('"')), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)
    found = lambda b: bind(F.regexp_extract(b, rf"^(?:{one},){{{at}}}+({one})(?:,|\z)", 1), plain)
    return bind(bare, lambda b: F.when(b.rlike(rf"^{one}(?:,{one})*+\z") & b.rlike(rf"^(?:{one},){{{at}}}+"), found(b)))


def _read_files(con, files: list[list[int]], lines: dict[int, str], kind: str) -> tuple[dict[int, list[str]], dict[int, str], set[int]]:
    """Read lines as CSV files with reject tables: returned rows by position, reasons of rejected ones, and refused lines.

    A file that the reader gives up as a whole is halved until the line at fault stands alone, which is refused.
    """
    columns = ", ".join(f"'{n}': '{t}'" for n, t in [("pos", "BIGINT"), *((f, TYPED.get(f, "VARCHAR").replace("'", "''")) for f in FIELDS[kind]), ("end", "VARCHAR")])
    rows: dict[int, list[str]] = {}
    reasons: dict[int, str] = {}
    refused: set[int] = set()
    todo = [files]
    with tempfile.TemporaryDirectory() as scratch:  # of this task alone; nothing else reads it
        while todo:
            group = [f for f in todo.pop() if f]
            if not group:
                continue
            paths = {}
            for i, positions in enumerate(group):
                paths[at := os.path.join(scratch, f"{i}.csv")] = positions
                with open(at, "w", encoding="utf-8", errors="surrogatepass", newline="") as out:
                    out.writelines(f"{p},{lines[p]},{_END}\n" for p in positions)
            con.execute("DROP TABLE IF EXISTS reject_scans; DROP TABLE IF EXISTS reject_errors")
            try:
                found = con.execute(
                    f"""SELECT * FROM read_csv({list(paths)!r}, auto_detect=false, header=false, delim=',', quote='"', escape='"',
                    columns={{{columns}}}, store_rejects=true, strict_mode=true, parallel=false, new_line='\\n',
                    max_line_size={4 * LONG_LINE}, buffer_size={64 * LONG_LINE})"""
                ).fetchall()
                # line-level errors meet their raw records by file and line
                errors = con.execute("SELECT file_path, line, error_type FROM reject_errors JOIN reject_scans USING (scan_id, file_id)").fetchall()
            except Exception as e:  # noqa: BLE001
                if "CSV" not in str(e) and "Invalid" not in type(e).__name__:
                    raise
                if len(group) > 1:
                    todo += [group[: len(group) // 2], group[len(group) // 2 :]]
                elif len(group[0]) > 1:
                    todo += [[group[0][: len(group[0]) // 2]], [group[0][len(group[0]) // 2 :]]]
                else:
                    refused.add(group[0][0])
                continue
            rank = list(ERRORS.values())
            for path, n, error in errors:
                if 0 < n <= len(paths[path]):
                    at, why = paths[path][n - 1], ERRORS.get(error, "columns")
                    reasons[at] = min(reasons.get(at, why), why, key=rank.index)
            for pos, *fields, end in found:
                if pos in lines and end == _END:
                    rows[pos] = ["" if f is None else f for f in fields]
    return rows, reasons, refused


def _load_batch(con, pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for kind, part in pdf.groupby("kind", dropna=False):
        raw = part["line"].tolist()
        ids = part["line_id"].tolist()
        if kind not in FIELDS:
            out.append(pd.DataFrame({"line_id": ids, "kind": kind, "reason": "kind", "judge": "grammar", "raw": raw}))
            continue
        bare = [None if x is None else _bare(x) for x in raw]
        plain = {
            i: x.replace("\n", _LF).replace("\r", _CR)
            for i, x in enumerate(bare)
            if x is not None and len(x) <= LONG_LINE and "\0" not in x and _LF not in x and _CR not in x
        }
        # a line whose quoting may be broken stands in a file of its own, so that an open quote takes no neighbours along
        alone = [i for i, x in plain.items() if '"' in x and not _RECORD.fullmatch(x)]
        apart = set(alone)
        rows, why, refused = _read_files(con, [[i for i in plain if i not in apart]], plain, kind)
        for at in range(0, len(alone), 500):
            more, errors, others = _read_files(con, [[i] for i in alone[at : at + 500]], plain, kind)
            rows, why, refused = rows | more, why | errors, refused | others
        reason: dict[int, str] = {}
        judge: dict[int, str] = {}
        for i, x in enumerate(bare):
            if i in apart:
                # rejected, or never finished; what was returned all the same has a quote where the reader allows it
                reason[i], judge[i] = "quoting", "reader" if why.get(i) == "quoting" or not (i in rows or i in why or i in refused) else "grammar"
                rows.pop(i, None)
            elif i in why:
                reason[i], judge[i] = why[i], "reader"
                rows.pop(i, None)
            elif i in rows:
                rows[i] = [f.replace(_LF, "\n").replace(_CR, "\r") for f in rows[i]]
            elif i in plain and i not in refused:
                raise RuntimeError(f"the reader neither returned nor rejected line {ids[i]}")
            else:  # null, too long or with characters the reader can't take
                fields = None if x is None else split_record(x)
                judge[i] = "grammar"
                if x is not None and fields is None:
                    reason[i] = "quoting"
                elif fields is None or len(fields) != len(FIELDS[kind]):
                    reason[i] = "columns"
                else:
                    rows[i] = fields
        order = sorted(rows)
        typed = pd.DataFrame([rows[i] for i in order], columns=FIELDS[kind], dtype="object")
        typed.insert(0, "pos", order)
        con.register("typed", typed)
        ok = {p for (p,) in con.execute(f"SELECT pos FROM typed WHERE {RULES[kind]}").fetchall()} if order else set()
        con.unregister("typed")
        typed = typed.set_index("pos")
        full = pd.DataFrame({"line_id": ids, "kind": kind, "raw": raw})
        full["reason"] = [reason.get(i) or (None if i in ok else "value") for i in range(len(raw))]
        full["judge"] = [judge[i] if i in reason else None if i in ok else "rule" for i in range(len(raw))]
        typed = typed.loc[[i for i in order if i in ok]]
        if kind == "read":
            typed["is_fastq"] = typed["is_fastq"].eq("true")
        else:
            typed = typed.rename(columns={"id": "element"})
            ends = [[int(n) for n in x.split("-")] if x else [] for x in typed["expected_length"]]
            fits = [all(n < 2**63 for n in e) for e in ends]
            typed["min_length"] = pd.array([min(e) if e and f else None for e, f in zip(ends, fits)], dtype="Int64")
            typed["max_length"] = pd.array([max(e) if e and f else None for e, f in zip(ends, fits)], dtype="Int64")
        out.append(full.join(typed))
    return pd.concat(out, ignore_index=True) if out else pdf.iloc[:0]


def load_records(lines: DataFrame, line_id: str = "line_id", kind: str = "kind", line: str = "line") -> DataFrame:
    """Parse one record per row; every input row comes out once, typed (``reason`` null) or rejected (``reason`` set).

    Runs DuckDB's CSV reader with typed columns and reject tables over files of up to one Arrow batch on the workers and
    joins its line-level errors to the raw records; its rows are the typed rows and its errors the reasons. ``judge`` says
    who rejected a line: 'reader'; 'rule' for what no type of the reader tells (letters of seq, length of qual, lengths);
    'grammar' for a quote within an unquoted field, which the reader lets pass, and for lines it can't take (null, longer
    than LONG_LINE, with NUL or the two stand-ins).
    Reasons, first that applies: 'kind' (neither read nor layout, or null), 'quoting', 'columns', 'value'. A null line is
    rejected as 'columns'; so is an empty one. A BOM before and a carriage return after a record don't count. Repeated
    lines give repeated rows. Lengths beyond a 64-bit integer keep their text and a null ``min_length``/``max_length``.
    There is no shuffle: a file holding a third of all lines is worked on batch by batch. Other columns are ignored.
    """
    kinds = dict(f.split() for f in SCHEMA.split(", "))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import duckdb

        con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
        for pdf in batches:
            if len(pdf):
                out = _load_batch(con, pdf)
                for n, kind in kinds.items():  # a batch of one kind lacks the other's fields
                    if n not in out:
                        out[n] = pd.Series([None] * len(out), dtype="Int64" if kind == "bigint" else "object", index=out.index)
                    elif kind != "bigint":
                        out[n] = out[n].astype("object").where(out[n].notna(), None)
                yield out[list(kinds)]
        con.close()

    src = lines.select(F.col(line_id).cast("bigint").alias("line_id"), F.col(kind).alias("kind"), F.col(line).alias("line"))
    return src.mapInPandas(run, SCHEMA)


def rejected(loaded: DataFrame) -> DataFrame:
    return loaded.where(F.col("reason").isNotNull()).select("line_id", "kind", "reason", "judge", "raw")


def typed_reads(loaded: DataFrame) -> DataFrame:
    return loaded.where("reason is null and kind = 'read'").select("line_id", "read_id", "comment", "seq", "qual", "is_fastq")


def typed_layout(loaded: DataFrame) -> DataFrame:
    return loaded.where("reason is null and kind = 'layout'").select(
        "line_id", "element", "seq", "expected_length", "min_length", "max_length", "type", "class", "whitelist", "flags"
    )
