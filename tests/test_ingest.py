"""CSV scans: quoted line ends, quotes in quotes, row numbers as a spreadsheet shows them, and files that cannot be read."""

from veriframe.sources import ingest


def test_numbers_and_quoted_line_ends(spark, tmp_path):
    for name in "abc":
        rows = "".join(f'{name}{i},"line one\nline ""two"" {i}"\n' for i in range(1, 40))
        (tmp_path / f"{name}.csv").write_text("serial_number,brand_name\n" + rows)
    df = ingest.read_declared_csv(spark, str(tmp_path), ["serial_number", "brand_name"])
    sound, errors = ingest.csv_file_errors(df)
    assert errors.count() == 0
    got = ingest.row_numbers(sound).collect()
    assert sorted((r.serial_number, r.row_number) for r in got) == sorted((f"{n}{i}", i + 1) for n in "abc" for i in range(1, 40))
    assert {r.brand_name for r in got if r.serial_number == "b7"} == {'line one\nline "two" 7'}


def test_a_malformed_file_is_one_error(spark, tmp_path):
    (tmp_path / "good.csv").write_text("serial_number,brand_name\n1,a\n2,b\n")
    (tmp_path / "bad.csv").write_text("serial_number,brand_name\n1,a,c,d\n2,b\n")
    sound, errors = ingest.csv_file_errors(ingest.read_declared_csv(spark, str(tmp_path), ["serial_number", "brand_name"]))
    assert [r.kind for r in errors.collect()] == ["malformed_csv"] and errors.first().file.endswith("bad.csv")
    assert sorted((r.serial_number, r.row_number) for r in ingest.row_numbers(sound).collect()) == [("1", 2), ("2", 3)]
