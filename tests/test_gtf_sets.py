"""Sets of GTF files by library table: files and folders, lines that can't be read, null and missing paths."""

import pytest

from spanloom.sources.formats import read_libraries

GOOD = 'chr1\tt\texon\t11\t20\t.\t+\t.\tgene_id "g"; transcript_id "{}";'


def libraries(spark, rows):
    return spark.createDataFrame(rows, "gtf_file string, sample_id string, library_id string")


def test_files_and_folders(spark, tmp_path):
    (tmp_path / "a.gtf").write_text("# comment\n\n" + GOOD.format("a") + "\nchr1\tt\texon\t20\t11\t.\t+\t.\tx\n")
    (tmp_path / "b c").mkdir()
    (tmp_path / "b c" / "1.gtf").write_text(GOOD.format("b1") + "\nshort line\n")
    (tmp_path / "b c" / "2.gtf").write_text(GOOD.format("b2").replace("11", "x") + "\n" + GOOD.format("b3"))
    table = libraries(spark, [(str(tmp_path / "a.gtf"), "s1", "A"), (f"file://{tmp_path}/b c", "s2", "B"), (None, "s3", "C")])
    features, bad = read_libraries(spark, table)
    assert sorted((r["library_id"], r["sample_id"], r["attrs"]["transcript_id"], r["s"], r["e"]) for r in features.collect()) == [("A", "s1", "a", 10, 20), ("B", "s2", "b1", 10, 20), ("B", "s2", "b3", 10, 20)]
    assert sorted((r["library_id"], r["value"][:10], r["file"][-5:]) for r in bad.collect()) == [("A", "chr1\tt\texo", "a.gtf"), ("B", "chr1\tt\texo", "2.gtf"), ("B", "short line", "1.gtf")]


def test_no_libraries_and_missing_files(spark, tmp_path):
    features, bad = read_libraries(spark, libraries(spark, [(None, "s", "A")]))
    assert features.collect() == bad.collect() == []
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_libraries(spark, libraries(spark, [(str(tmp_path / "none.gtf"), "s", "A")]))
