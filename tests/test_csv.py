"""Texts leave the CSV sink and come back as they are."""

from jobstrata.sources import readers, writers

ODD = ["", " ", "\n", "\n\n", " lead", "trail ", "\ttab\t", " nb ", "a\rb", "a\r\nb", "\r", "ends\r", "\rbegins", "\x01", "\x1f", "nul\x00x", "a\\",
       'a\\"b', '"', '""', '"q" x', 'x","y', 'x"\n"y', ",", "null", "\\N", "#c", "﻿bom", "'", "last\n", None]


def test_odd_texts_pass_through_csv(spark, tmp_path):
    rows = [(i, text, last) for i, text in enumerate(ODD) for last in ("x", None, "", " ")]
    path = str(tmp_path / "csv")
    writers.write_csv(spark.createDataFrame(rows, "id int, text string, last string").repartition(3), path)
    back = readers.read_csv_table(spark, path, "id int, text string, last string").collect()
    assert sorted(map(tuple, back), key=repr) == sorted(rows, key=repr)


def test_foreign_csv(spark, tmp_path):
    """A file with other line ends, as the csv module writes it: empty fields are null."""
    (tmp_path / "a.csv").write_bytes('a,b,c\r\n1,,"x\ny"\r\n2,"",z\r\n,q,\r\n'.encode())
    back = readers.read_csv_table(spark, str(tmp_path / "a.csv"), "a string, b string, c string").collect()
    assert [tuple(r) for r in back] == [("1", None, "x\ny"), ("2", "", "z"), (None, "q", None)]
