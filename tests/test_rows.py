import datetime
import re

import pytest
from pyspark.sql import functions as F

from vazante.operators import rows as R

LINES = [
    'a,b,2016-02-29,c,,l', 'a,b,2015-02-29,c,,l', '"a","b ""x"", y\nz","",c,"",l', 'a,b,c', '', None, 'a,"b,2016-01-01,c,,l', 'a,b,2016-01-01,c,,l,m',
    'a,b\x07,2016-01-01,c,,l', 'a,"b�",2016-01-01,c,,l', 'a,b\x07,2016-13-01,c,,l', 'a,b, 2016-01-01,c,,l', 'a,b,0000-01-01,c,,l', '"a" ,b,,c,,l', 'a,b\r,,c,,l',
    'a\x01,b,2000-02-29,c,,l', 'a,b,1900-02-29,c,,l', ',,,,,', '"","","","","",""', 'a,b,2016-01-01,c,,l', 'a,"' + 'x""y,\n' * 40_000 + '",2016-12-31,c,,l', 'a' * 300_000 + ',b,,c,,l',
]


def parse(line):
    out, at = [], 0
    while True:
        if line[at : at + 1] == '"':
            value, at = "", at + 1
            while True:
                end = line.find('"', at)
                if end < 0:
                    return None
                value += line[at:end]
                at = end + 1
                if line[at : at + 1] != '"':
                    break
                value, at = value + '"', at + 1
        else:
            end = min((k for k in (line.find(",", at), len(line)) if k >= 0))
            value, at = line[at:end], end
            if re.search('["\r\n]', value):
                return None
        out.append(value)
        if at == len(line):
            return out
        if line[at] != ",":
            return None
        at += 1


def reason(line):
    fields = parse(line) if line is not None else None
    if fields is None:
        return "quoting"
    if len(fields) != 6:
        return "columns"
    if fields[2]:
        try:
            assert re.fullmatch("[0-9]{4}-[0-9]{2}-[0-9]{2}", fields[2])
            datetime.date.fromisoformat(fields[2])
        except (AssertionError, ValueError):
            return "date"
    return "text" if re.search("[�\x7f\x00-\x08\x0b\x0c\x0e-\x1f]", fields[1]) else None


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(k, line, "clash") for k, line in enumerate(LINES)], "n long, raw string, title string")


def test_reasons(frame):
    got = {r.n: r.reason for r in R.rejected_rows(frame, "raw", R.ARTICLE_ROW).collect()}
    assert got == {k: reason(x) for k, x in enumerate(LINES) if reason(x)}


def test_values_and_clashing_columns(frame):
    good = {r.n: r for r in R.valid_rows(frame, "raw", R.ARTICLE_ROW).collect()}
    assert set(good) == {k for k, x in enumerate(LINES) if reason(x) is None}
    for k, r in good.items():
        assert [r[c] for c in ("title", "text", "date", "category", "subcategory", "link")] == [v or None for v in parse(LINES[k])]
        assert r.input_title == "clash"


def test_broken_field(frame):
    got = {r.n: r.broken_field for r in R.rejected_rows(frame, "raw", R.ARTICLE_ROW).collect()}
    assert got[1] == 3 and got[3] == 3 and got[5] == 1 and got[6] == 2 and got[7] == 7 and got[8] == 2 and got[10] == 2


def test_calendar(spark):
    first = datetime.date(1599, 1, 1)
    days = [(first + datetime.timedelta(k)).isoformat() for k in range(366 * 402)]
    near = ["2015-02-30", "2016-04-31", "2016-00-10", "2016-10-00", "2016-1-01", "2016-01-01 ", "٢٠١٦-01-01", ""]
    df = spark.createDataFrame([(d,) for d in days + near], "d string")
    assert df.filter(F.col("d").rlike(f"\\A{R.CALENDAR_DAY}\\z")).count() == len(days)


def test_empty_table(spark):
    df = spark.createDataFrame([], "raw string")
    assert R.rejected_rows(df, "raw", R.ARTICLE_ROW).count() == 0 and R.valid_rows(df, "raw", R.ARTICLE_ROW).count() == 0


def test_clashing_names_and_all_fields(spark):
    lines = ['a,b,2015-01-01,c,d,e', ',,,,,', '"x ""y"", z",t,,"","q\r\nr",', '"a"b,,,,,', None]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(lines)], "line_id long, raw string, __fields int, __why int")
    got = {r.line_id: tuple(r[f.name] for f in R.ARTICLE_ROW.fields) for r in R.valid_rows(df, "raw", R.ARTICLE_ROW).collect()}
    assert got == {0: ("a", "b", "2015-01-01", "c", "d", "e"), 1: (None,) * 6, 2: ('x "y", z', "t", None, None, "q\r\nr", None)}
    assert {r.line_id: r["__why"] for r in R.rejected_rows(df, "raw", R.ARTICLE_ROW).collect()} == {3: 2, 4: 2}
