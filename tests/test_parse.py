import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from loomseq.operators.parse import FIELDS, parse_lines


def brute(line):
    fields = cut(line)
    return fields if isinstance(fields, str) else judge(fields)


def cut(line):
    if line is None:
        return "columns"
    fields, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            i, out = i + 1, ""
            while True:
                if i >= n:
                    return "quoting"
                if line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        out, i = out + '"', i + 2
                        continue
                    i += 1
                    break
                out, i = out + line[i], i + 1
            if i < n and line[i] != ",":
                return "quoting"
        else:
            j = i
            while j < n and line[j] != ",":
                j += 1
            out, i = line[i:j], j
            if '"' in out:
                return "quoting"
        fields.append(out)
        if i >= n:
            break
        i += 1
    return fields


def judge(fields):
    if len(fields) != 5:
        return "columns"
    _, seq, qual, size, nb = fields
    if not seq or set(seq) - set("ACGTacgtNn."):
        return "seq"
    if qual and (len(qual) != len(seq) or any(not "!" <= c <= "~" for c in qual)):
        return "qual"
    if not re.fullmatch("[0-9]{1,9}", size) or int(size) != len(seq) or int(size) > 1023:
        return "len"
    if not re.fullmatch("[0-9]{1,9}", nb) or int(nb) != sum(c in "Nn." for c in seq):
        return "nbasenum"
    return None


def check(spark, lines):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_no bigint, line string")
    got = {r.line_no: r for r in parse_lines(df).collect()}
    assert len(got) == len(lines)
    for i, x in enumerate(lines):
        assert got[i].reason == brute(x), (x, got[i].reason)
        if got[i].reason is None:
            name, seq, qual, size, nb = cut(x)
            assert (got[i].name, got[i].seq, got[i].qual, got[i].len, got[i].nbasenum) == (name, seq, qual or None, int(size), int(nb))


CASES = [
    "r,ACGT,IIII,4,0",
    '"r, 1",ACGT,IIII,4,0',
    '"r ""x""",ACgN,IIII,4,1',
    '"a\nb",AC,,2,0',
    "a\nb,AC,,2,0",
    "r,ACGT,IIII,4,0\n",
    "r,ACGT,IIII,4,0 ",
    "r,ACGT,IIII,4",
    "r,ACGT,IIII,4,0,",
    'r"x,ACGT,IIII,4,0',
    '"r"x,ACGT,IIII,4,0',
    '"r,ACGT,IIII,4,0',
    'r,ACGT,"II""I",4,0',
    "r,ACXT,IIII,4,0",
    "r,,IIII,4,0",
    "r,ACGT,III,4,0",
    "r,ACGT,II I,4,0",
    "r,ACGT,IIII,04,0",
    "r,ACGT,IIII,+4,0",
    "r,ACGT,IIII,4.0,0",
    "r,ACGT,IIII,0000000004,0",
    "r,AC.N,IIII,4,1",
    "r,AC.N,IIII,4,2",
    "r," + "A" * 1024 + ",,1024,0",
    "r," + "A" * 1023 + ",,1023,0",
    "",
    ",,,,",
    None,
    "r,ACGT,IIII,٤,0",
    "﻿r,ACGT,IIII,4,0",
    "r\x00,ACGT,IIII,4,0",
    "r\r,ACGT,IIII,4,0\r",
    "\n,AC,,2,0",
    "x" * 200_000 + ",ACGT,IIII,4,0",
]


def test_cases(spark):
    check(spark, CASES)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet='AC,"\n\r4 I0N', max_size=14), max_size=40))
def test_any_text(spark, lines):
    check(spark, [*lines, "r,ACGT,IIII,4,0"])


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], "line_no bigint, line string, reason string")
    assert parse_lines(df).count() == 0
    df = spark.createDataFrame([Row(line_no=None, line="r,ACGT,,4,0", reason="x", seq="y")], "line_no bigint, line string, reason string, seq string")
    (r,) = parse_lines(df).collect()
    assert r.line_no is None and r.reason is None and r.seq == "ACGT"
    assert parse_lines(df).columns == ["line_no", "line", "reason", *FIELDS]
