import pytest

from tallymark import operators as ops
from tallymark import sources


def test_csv_keeps_line_breaks_and_quotes(spark, tmp_path):
    file = tmp_path / "r.csv"
    file.write_text('VolumeName,report_text\nv1,"two\nlines, with ""quotes"""\nv2, padded \nv3,None\nv4,\nv5,"n/a"\n')
    df = sources.read_reports(spark, str(file))
    got = [(r["_ord"], r["VolumeName"], r["report_text"]) for r in df.orderBy("_ord").collect()]
    assert got == [
        (0, "v1", 'two\nlines, with "quotes"'),
        (1, "v2", " padded "),
        (2, "v3", None),
        (3, "v4", None),
        (4, "v5", None),
    ]
    assert sources.read_reports(spark, str(file), ["VolumeName"]).columns == ["VolumeName", "_ord"]


def test_csv_round_trip(spark, tmp_path, rows):
    texts = ['a "b" \\ c', "x\r\ny", " lead", "\ttab\t", "comma, line\n", "\\", 'ends with \\"']
    df = spark.createDataFrame(list(enumerate(texts)), "i string, t string")
    sources.write_table(df, str(tmp_path / "out"), "csv")
    back = sources.read_reports(spark, str(tmp_path / "out"))
    assert rows(back, "i", "t") == rows(df)


def test_metric_files_are_stacked_by_name(spark, tmp_path, rows):
    header = "label,precision,recall,f1,accuracy,tp,fp,fn,tn"
    (tmp_path / "a").mkdir()
    (tmp_path / "b c").mkdir()
    (tmp_path / "a" / "m.csv").write_text(f"{header}\nx,0.5,0.5,0.5,0.5,1,1,1,1\n")
    (tmp_path / "b c" / "m.csv").write_text("precision,label,recall,f1,accuracy,tp,fp,fn,tn,extra\n0.7,x,0.5,0.5,0.5,3,1,1,1,e\n")
    (tmp_path / "b c" / "other.txt").write_text("no csv")
    stacked = sources.read_metrics(spark, glob=f"{tmp_path}/**/*.csv")
    assert stacked.select("_source").distinct().count() == 2
    got = ops.metrics_mean_std(stacked).first()
    assert (got["precision_mean"], got["precision_std"], got["tp_mean"]) == (0.6, 0.1, 2.0)
    path = str(tmp_path / "a" / "m.csv")
    assert sources.read_metrics(spark, [path, path]).count() == 1
    with pytest.raises(ValueError):
        sources.read_metrics(spark)


def test_label_tables(spark, tmp_path):
    path = str(tmp_path / "run")
    df = spark.createDataFrame([("v", 1)], "VolumeName string, L int")
    sources.write_labels(df, path)
    sources.append_labels(df, path)
    assert sources.read_table(spark, path, ["L"]).columns == ["L", "_ord"]
    assert sources.read_table(spark, path).count() == 2
    sources.write_labels(df, path)
    assert sources.read_table(spark, path).count() == 1


def test_materialise_computes_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    df = spark.range(5).mapInPandas(count, "id bigint")
    for done in (sources.materialise(df), sources.materialise(df, str(tmp_path / "t"))):
        assert done.count() == 5 and done.count() == 5
    assert seen.value == 10
