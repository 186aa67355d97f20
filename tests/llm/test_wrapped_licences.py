"""Licence texts wrapped over lines, in comments and above code, against the SQL and by hand."""

import textwrap

import duckdb
import pytest

from quarterline.llm import licences

BY = {k: [t for name, t in licences.TEMPLATES if name == k] for k in dict(licences.TEMPLATES)}
CODE = "\n\nint main() {\n  return 0;\n}\n" * 3


def comment(text: str, mark: str, width: int = 76) -> str:
    return "\n".join(f"{mark} {line}" for line in textwrap.wrap(text, width))


def rows() -> list[tuple]:
    grant = max((t for t in BY["MIT"] if t.startswith("Permission")), key=len)
    notice = max(BY["Apache-2.0"], key=len)
    out = [
        (1, comment(grant, "#") + CODE, {"MIT"}),
        (2, "/*\n" + comment(notice, " *") + "\n *\n" + comment(BY["Apache-2.0"][1], " *") + "\n */" + CODE, {"Apache-2.0"}),
        (3, "Some program.\n" + comment(BY["GPL-3.0"][1], "//", 60) + "\n//\n" + comment(BY["GPL-3.0"][2], "//", 60) + CODE, {"GPL-3.0"}),
        (4, "\n\n".join(textwrap.fill(t, 50) for t in BY["MIT"][2:5]), {"MIT"}),
        (5, textwrap.fill(BY["ISC"][1], 40) + "\n\nwords that follow\n", {"ISC"}),
        (6, comment(BY["MPL-2.0"][0], "--", 30), {"MPL-2.0"}),
        (7, CODE, set()),
        (8, textwrap.fill(grant[:200], 30) + CODE, set()),
        (9, None, set()),
        (10, "", set()),
        (10, "", set()),
        (None, "Released under\nthe MIT License.", {"MIT"}),
    ]
    return out


def test_wrapped_texts_are_found(spark):
    table = spark.createDataFrame([(d, t, 1, 2, "x") for d, t, _ in rows()], "doc_id long, text string, size int, number int, licence string")
    got: dict = {}
    for r in licences.scan(table).collect():
        got.setdefault(r.doc_id, set()).add(r.licence)
    for d, _, want in rows():
        assert got.get(d, set()) >= want and (want or d not in got), d
    assert got[1] == {"MIT"} and got[3] == {"GPL-3.0"}


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(d, t) for d, t, _ in rows()])
    want = con.execute(licences.op1_sql()).fetchall()
    table = spark.createDataFrame([(d, t) for d, t, _ in rows()], "doc_id long, text string")
    got = [tuple(r) for r in licences.scan(table).collect()]
    rounded = lambda some: sorted(((d, name, n, round(x, 9), w) for d, name, n, x, w in some), key=str)
    assert rounded(got) == rounded(want) and len(got) == 7


@pytest.mark.parametrize("licence", ["MIT", "BSD-2-Clause", "GPL-2.0", "Zlib"])
def test_every_template_is_found_as_written(spark, licence):
    table = spark.createDataFrame(list(enumerate(BY[licence])), "doc_id long, text string")
    found = {r.doc_id for r in licences.scan(table).where(f"dice = 1 and licence = '{licence}'").collect()}
    assert found == set(range(len(BY[licence])))
