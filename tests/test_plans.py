"""Shapes of plans, files in and out, and every query against its SQL."""

import decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from glyphflow.functions import scripts
from glyphflow.operators import lexicon, reader
from glyphflow.plans import catalog
from glyphflow.sources import files

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
catalog.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def shown(rows):
    def one(x):
        if x is None or x != x:
            return "-"
        return f"{float(x):.4f}" if isinstance(x, float | decimal.Decimal) else str(x)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_against_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(catalog.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert shown(df.select(columns).collect()) == shown([tuple(r[i] for i in at) for r in found.fetchall()])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def plan(df, mode="formatted"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def test_transforms_stay_in_the_engine(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select(scripts.todo_to_translit(scripts.translit_to_todo(F.col("text"))).alias("x"))
    text = plan(df)
    assert "Python" not in text and "Exchange" not in text and "ReadSchema: struct<text:string>" in text


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(event_id), EqualTo(event_id,42)]" in plan(catalog.QUERIES["io10_point_lookup"](spark, SF))


def test_no_nested_loops(spark):
    for name in ("j10_interval_join", "j11_nearest_box", "j12_prefix_join", "j06_skeleton_candidates", "j05_prefix_semi", "j14_noise_words"):
        text = plan(catalog.QUERIES[name](spark, SF))
        assert "NestedLoop" not in text and "Cartesian" not in text, name


def test_components_of_a_chain(spark):
    pairs = spark.createDataFrame([(f"a{i:03}", f"b{(i + d) // 2:03}") for i in range(100) for d in (0, 1)] + [("x", "y")], "a string, b string")
    got = {r.component for r in lexicon.components(pairs, "a", "b").collect()}
    assert got == {"a:a000", "a:x"}


def test_common_prefix(spark):
    rows = spark.createDataFrame([("abc", "abd", 2), ("abc", "abc", 3), ("a", "abc", 1), ("", "x", 0), ("x", "y", 0)], "a string, b string, n int")
    assert rows.where(reader.common_prefix(F.col("a"), F.col("b")) != F.col("n")).count() == 0


def test_files(spark, tmp_path):
    words = spark.createDataFrame([("b", 3), ("a", 3), ("c", 9)], "word string, freq long")
    files.write_lexicon(words, str(tmp_path / "lex"))
    assert [tuple(r) for r in files.frequencies(spark, str(tmp_path / "lex")).collect()] == [("c", 9), ("a", 3), ("b", 3)]
    spark.createDataFrame([("x", 1, "d"), ("y", 2, "r")], files.VOCAB).write.csv(str(tmp_path / "vocab"), sep="\t")
    assert files.vocabulary(spark, str(tmp_path / "vocab"))["d"].first().word == "x"
    spark.createDataFrame([("w", "k", 0.5)], files.TAGGED).write.csv(str(tmp_path / "tag"), sep="\t")
    assert files.tagged(spark, str(tmp_path / "tag"))["w"].first().val == 0.5
    files.write_export(words.limit(0), str(tmp_path / "export"))
    files.write_report(words, str(tmp_path / "report"))
    assert files.table(spark, str(tmp_path / "report")).count() == 3
    files.append_lines(words, str(tmp_path / "log"))
    files.append_lines(words, str(tmp_path / "log"))
    assert files.json_lines(spark, str(tmp_path / "log"), "event string, word string").count() == 6
    with pytest.raises(ValueError):
        files.pair_sheet(spark, str(tmp_path / "report"))
    (tmp_path / "c.jsonl").write_text('{"book_id":"1","text":"a","ocr_suspect":false}\n{"book_id":"2","text":"b","ocr_suspect":true}\n{"book_id":"3","text":"c"}\n')
    assert [r.text for r in files.corpus(spark, str(tmp_path / "c.jsonl"), ("3",)).collect()] == ["a"]


def test_image_headers(spark, tmp_path):
    png = bytes.fromhex("89504e470d0a1a0a0000000d49484452") + (9000).to_bytes(4, "big") + (8000).to_bytes(4, "big") + b"\x08\x02\0\0\0"
    (tmp_path / "big.png").write_bytes(png)
    (tmp_path / "x.txt").write_text("no")
    row = files.images(spark, str(tmp_path)).collect()
    assert [(r.kind, r.width, r.height, r.too_large) for r in row] == [("png", 9000, 8000, True)]


def test_whole_texts_are_folded(spark, tmp_path):
    """Phrases, lines and windows behind the 60th word."""
    text = "and the of " * 5000 + "last, in the end."
    spark.createDataFrame([(1, text, "en", "a"), (2, None, "en", "a"), (3, "", "en", "a")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = catalog.QUERIES["j09_phrases"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.phrases for r in rows}[1].split("|") == ["and the of"] * 5000 + ["last", "in the", "end"]
    for name in ("a31_wrap", "a30_windows"):
        parts = {}
        for r in catalog.QUERIES[name](spark, str(tmp_path)).collect():
            parts.setdefault(r.doc_id, []).append(r.text)
        words = "and the of " * 5000 + ("last in the end" if name == "a31_wrap" else "last, in the end.")
        assert set(parts) == {1} and " ".join(parts[1]) == words, name
