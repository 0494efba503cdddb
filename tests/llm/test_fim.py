"""Fill-in-the-middle against a plain version, in all forms, and on odd rows."""

import hashlib
import random
import re

import duckdb
import pytest

from lumenrank.llm import fim, queries

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    h = sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, None)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, len(units), form, len(p), len(m), sha(out), sha(text)


def odd_rows():
    draw = random.Random(3)
    texts = [None, "", " ", "\n\t ", "one", " one", "one ", "a b", "<", "<P", "x <P", "x <P> y", "<S>", "a<M>", "P>", "<P >", "é 日本　x \x85 \x1c y", "\U0001f642 \U0001f642\n\n", "x" * 300_000, "w " * 200_000, " " * 100_000, " " * 50_000 + "x"]
    texts += ["".join(draw.choices("<PSM> ab\n", k=draw.randint(1, 40))) for _ in range(300)]
    rows = [(i * 7 - 40, t) for i, t in enumerate(texts)]
    return rows + [(None, "no id but words"), (None, None), rows[20], rows[40], (rows[40][0], "another text of that id")]


def test_against_a_plain_version(spark, tmp_path):
    rows = odd_rows()
    at = str(tmp_path)
    spark.createDataFrame([(*r, 1, "e", "d", 2) for r in rows], "doc_id long, text string, n long, form string, fim string, units int").repartition(3).write.parquet(f"{at}/documents.parquet")
    found = queries.op12_fill_in_middle(spark, at)
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    got = sorted(map(tuple, found.collect()), key=repr)
    wanted = sorted((plain(*r) for r in rows), key=repr)
    assert got == wanted
    assert {r[2] for r in wanted} == {"plain", "spm", "psm"}
    with duckdb.connect() as duck:
        duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet/*.parquet'")
        theirs = duck.execute(queries.ORACLE_SQL["op12_fill_in_middle"]).fetchall()
    assert sorted(theirs, key=repr) == wanted


def test_columns_of_clashing_names_stay(spark):
    df = spark.createDataFrame([(1, "a b c", "kept", 4)], "doc_id long, text string, example string, units int")
    out = fim.fill_in_middle(df, rate=100)
    assert out.columns == ["doc_id", "text", "example", "units", "fim"]
    row = out.first()
    assert (row.example, row.units, row.fim.units) == ("kept", 4, 3)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    out = fim.fill_in_middle(df)
    assert out.collect() == [] and out.select(fim.restore(out["fim.example"], out["fim.form"])).collect() == []


@pytest.mark.parametrize("form", ["spm", "psm"])
def test_every_cut_is_found_again(form):
    marks, draw = fim.Marks(), random.Random(form)
    for _ in range(3000):
        text = "".join(draw.choices(["<", "P", ">", "<P", "S>", "<M", " ", "x", "é"], k=draw.randint(1, 12)))
        units, found, a, m, example = fim.cut(text, str(draw.random()), 1, 100, 100 if form == "spm" else 0, marks)
        assert found == ("plain" if re.search("<[PSM]>", text) else form)
        assert fim.rebuilt(example, found, marks) == text and units == len(UNIT.findall(text))


def test_marks_that_could_be_mistaken():
    for marks in (fim.Marks("a", "ab", "c"), fim.Marks("aa", "b", "c"), fim.Marks("", "b", "c"), fim.Marks("a", "a", "c"), fim.Marks("<p", "x<", "y")):
        with pytest.raises(ValueError):
            fim._checked(marks)
    with pytest.raises(ValueError):
        fim.rebuilt("no marks", "spm", fim.Marks())
