"""Delimited lines as typed rows, with the lines that do not parse set apart and the reason named."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.flat import slices

FIELDS = ("name", "seq", "qual", "len", "nbasenum")
MAX_LEN = 1023
_FIELD = r'(?:[^",]*|"(?:[^"]|"")*")'
_QUOTING = rf"\A{_FIELD}(?:,{_FIELD})*\z"
_BLOCK = 16 << 20


def _stand_in(arr: pa.Array, taken: str) -> str:
    """A private-use character that occurs nowhere in the batch."""
    for c in map(chr, range(0xE000, 0xF8FF)):
        if c not in taken and not pc.any(pc.match_substring(arr, c)).as_py():
            return c
    raise ValueError("no private-use character is free")


def _read(lines: pa.Array) -> tuple[pa.Table, np.ndarray]:
    """Fields (all strings) of well-quoted lines, with the number of the line; the rest has another count of fields."""
    n = len(lines)
    schema = ["_at", *FIELDS]
    if not n:
        return pa.table({c: pa.array([], pa.string()) for c in schema}), np.zeros(0, bool)
    lf = _stand_in(lines, "")
    cr = _stand_in(lines, lf)
    whole = pc.replace_substring(pc.replace_substring(lines, "\n", lf), "\r", cr)
    at = pa.array(np.arange(n)).cast(pa.string())
    numbered = pc.binary_join_element_wise(at, whole, ",")
    text = pc.binary_join(pa.ListArray.from_arrays([0, n], numbered), "\n")[0].as_buffer()
    odd: list[int] = []

    def handler(row: pv.InvalidRow) -> str:
        odd.append(int(row.text.partition(",")[0]))
        return "skip"

    got = pv.read_csv(
        pa.BufferReader(text),
        read_options=pv.ReadOptions(column_names=schema, block_size=text.size + 1, use_threads=False),
        parse_options=pv.ParseOptions(delimiter=",", quote_char='"', double_quote=True, newlines_in_values=False, ignore_empty_lines=False, invalid_row_handler=handler),
        convert_options=pv.ConvertOptions(column_types={c: pa.string() for c in schema}, strings_can_be_null=False, check_utf8=False),
    )
    cols = {c: pc.replace_substring(pc.replace_substring(got.column(c).combine_chunks(), lf, "\n"), cr, "\r") for c in FIELDS}
    bad = np.zeros(n, bool)
    bad[odd] = True
    return pa.table({"_at": got.column("_at").combine_chunks(), **cols}), bad


def _number(x: pa.Array) -> tuple[pa.Array, pa.Array]:
    ok = pc.match_substring_regex(x, r"\A[0-9]{1,9}\z")
    return ok, pc.cast(pc.if_else(ok, x, "-1"), pa.int32())


def _label(t: pa.Table) -> pa.Table:
    """Typed columns and the first reason of each row whose fields are all there."""
    seq, qual = t.column("seq").combine_chunks(), t.column("qual").combine_chunks()
    size = pc.cast(pc.utf8_length(seq), pa.int32())
    bad_seq = pc.invert(pc.match_substring_regex(seq, r"\A[ACGTacgtNn.]+\z"))
    bad_qual = pc.and_(pc.not_equal(qual, ""), pc.or_(pc.not_equal(pc.cast(pc.utf8_length(qual), pa.int32()), size), pc.invert(pc.match_substring_regex(qual, r"\A[!-~]*\z"))))
    is_len, n_len = _number(t.column("len").combine_chunks())
    bad_len = pc.or_(pc.or_(pc.invert(is_len), pc.not_equal(n_len, size)), pc.greater(n_len, MAX_LEN))
    is_n, n_n = _number(t.column("nbasenum").combine_chunks())
    bad_n = pc.or_(pc.invert(is_n), pc.not_equal(n_n, pc.cast(pc.count_substring_regex(seq, "[Nn.]"), pa.int32())))
    none = pa.nulls(t.num_rows, pa.string())
    reason = pc.if_else(bad_seq, "seq", pc.if_else(bad_qual, "qual", pc.if_else(bad_len, "len", pc.if_else(bad_n, "nbasenum", none))))
    good = pc.is_null(reason)
    keep = {"name": t.column("name").combine_chunks(), "seq": seq, "qual": pc.if_else(pc.equal(qual, ""), none, qual), "len": n_len, "nbasenum": n_n}
    return pa.table({"_at": pc.cast(t.column("_at"), pa.int64()), "reason": reason, **{c: pc.if_else(good, v, pa.nulls(t.num_rows, v.type)) for c, v in keep.items()}})


_TYPES = {"name": pa.string(), "seq": pa.string(), "qual": pa.string(), "len": pa.int32(), "nbasenum": pa.int32()}


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "line", _BLOCK):
        line = b.column("line").cast(pa.string())
        quoted = pc.fill_null(pc.match_substring_regex(line, _QUOTING), True).to_numpy(zero_copy_only=False)
        fit = np.flatnonzero(quoted & line.is_valid().to_numpy(zero_copy_only=False))
        fields, odd = _read(line.take(pa.array(fit)))
        typed = _label(fields)
        reason = np.where(quoted, "columns", "quoting").astype(object)
        got = fit[typed.column("_at").to_numpy()]
        place = np.full(b.num_rows, -1, np.int64)
        place[got] = np.arange(got.size)
        take = pa.array(place, mask=place < 0)
        reason[got] = typed.column("reason").combine_chunks().to_numpy(zero_copy_only=False)
        cols = [typed.column(c).combine_chunks().take(take) for c in FIELDS]
        yield pa.RecordBatch.from_arrays([b.column("line_no"), b.column("line"), pa.array(reason, pa.string()), *cols], ["line_no", "line", "reason", *FIELDS])


def parse_lines(df: DataFrame, line_no: str = "line_no", line: str = "line") -> DataFrame:
    """Lines of five comma-separated fields (name, seq, qual, len, nbasenum) -> line_no, line, reason and the typed fields.

    reason is null for a row that parses; else the first that applies of `quoting`, `columns`, `seq`, `qual`, `len`,
    `nbasenum`, and the typed fields are null. Lines are taken as stored (trailing blanks count, a quoted field may hold
    commas and line breaks). A null line has no fields: `columns`; so has an empty one. An empty qual is null in the typed
    row. Every row gives one row, repeated lines and null line numbers too; further columns are ignored; lines of any
    length are read whole.
    """
    rows = df.select(F.col(line_no).cast("bigint").alias("line_no"), F.col(line).alias("line"))
    return rows.mapInArrow(_parse, "line_no bigint, line string, reason string, name string, seq string, qual string, len int, nbasenum int")


def rejects(df: DataFrame, line_no: str = "line_no", line: str = "line") -> DataFrame:
    return parse_lines(df, line_no, line).where("reason is not null").select("line_no", "reason")


def typed_rows(df: DataFrame, line_no: str = "line_no", line: str = "line") -> DataFrame:
    return parse_lines(df, line_no, line).where("reason is null").select("line_no", *FIELDS)
