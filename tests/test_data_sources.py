import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import product
from weftline.sources import mtx, mtx_source, stored, words


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("field,symmetry", [("real", "general"), ("integer", "symmetric"), ("pattern", "general"), ("pattern", "symmetric")])
def test_mtx_written_and_read_in_any_split(spark, tmp_path, coo, field, symmetry):
    m = coo([(i, (i * 7) % 50, i % 9 - 4) for i in range(50)] + [(i, i, 3) for i in range(0, 50, 5) if (i * 7) % 50 != i])
    spark.dataSource.register(mtx_source.MtxSource)
    path = str(tmp_path / "m")
    m.repartition(3).write.format("mtx").options(rows=50, columns=50, field=field, symmetry=symmetry).mode("append").save(path)
    expected = rows(mtx.read_mtx(spark, path), "i", "j", "v")
    assert expected
    for split in (7, 64, 1 << 20):
        assert rows(spark.read.format("mtx").option("split_bytes", split).load(path), "i", "j", "v") == expected
    assert mtx_source.counted(spark, path).first().fits
    with pytest.raises(Exception, match="m"):
        m.write.format("mtx").options(rows=50, columns=50).mode("errorifexists").save(path)


def test_odd_mtx_files(spark, tmp_path):
    spark.dataSource.register(mtx_source.MtxSource)
    text = "%%MatrixMarket matrix coordinate real general\n% a comment\n\n% one more\n3 3 4\n1 1 2.5\n  2   3  -1e3 \n\n1 1 4\n3 3 0"
    path = tmp_path / "one.mtx"
    path.write_text(text)
    for split in (1, 5, 1000):
        got = spark.read.format("mtx").option("split_bytes", split).load(str(path))
        assert rows(got, "i", "j", "v") == [(0, 0, 2.5), (0, 0, 4.0), (1, 2, -1000.0), (2, 2, 0.0)]
        # equal coordinates keep the order of the file
        assert [r.v for r in got.where("i = 0").orderBy("i", "j", "at").collect()] == [2.5, 4.0]
        assert [r.at for r in got.orderBy("at").collect()] == [text.index(x) for x in ("1 1 2.5", "  2   3", "1 1 4", "3 3 0")]
    short = tmp_path / "short.mtx"
    short.write_text(text.replace("3 3 4", "3 3 5"))
    outside = tmp_path / "outside.mtx"
    outside.write_text(text.replace("3 3 4", "2 2 4"))
    assert mtx_source.counted(spark, str(path)).first().fits
    assert not mtx_source.counted(spark, str(short)).first().fits
    assert not mtx_source.counted(spark, str(outside)).first().fits
    for bad in ("%%MatrixMarket matrix array real general\n1 1\n", "no banner\n", "%%MatrixMarket matrix coordinate complex general\n1 1 1\n1 1 1 1\n"):
        path.write_text(bad)
        with pytest.raises(Exception, match="banner|unsupported"):
            spark.read.format("mtx").load(str(path)).collect()


def test_words_are_the_packed_file(spark, tmp_path, monkeypatch):
    n = 5000
    values = [(k * 2654435761) % (1 << 32) for k in range(n)]
    table = spark.createDataFrame(list(enumerate(values)), "word long, value long").orderBy(F.rand(1))
    path = str(tmp_path / "w")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        words.write_words(table, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "w").iterdir())
    assert len(parts) > 1 and b"".join(p.read_bytes() for p in parts) == np.array(values, "<u4").tobytes()
    monkeypatch.setattr(words, "SPLIT_BYTES", 512)
    assert rows(words.read_words(spark, path), "word", "value") == list(enumerate(values))


def test_float_words_and_gaps(spark, tmp_path):
    path = str(tmp_path / "f")
    words.write_words(spark.createDataFrame([(0, 1.5), (1, -2.25), (2, 0.0)], "word long, value double"), path, "f4")
    assert rows(words.read_words(spark, path, "f4"), "word", "value") == [(0, 1.5), (1, -2.25), (2, 0.0)]
    for bad in ([(0, 1), (2, 1)], [(0, 1), (0, 2)], [(1, 1)]):
        with pytest.raises(Exception, match="word"):
            words.write_words(spark.createDataFrame(bad, "word long, value long").coalesce(1), str(tmp_path / f"bad{bad}"))


def test_records_as_words(spark, tmp_path):
    records = spark.createDataFrame([(b, w, 10 * b + w) for b in range(5) for w in range(3 + b)], "blk long, word long, value long")
    offsets = spark.createDataFrame([(b, sum(3 + x for x in range(b))) for b in range(5)], "blk long, ptr long")
    words.write_records(records, offsets, str(tmp_path / "r"))
    assert rows(words.read_records(spark, str(tmp_path / "r")), "blk", "word", "value") == rows(records, "blk", "word", "value")


def test_a_stored_product_needs_no_exchange_by_key(spark, coo, tmp_path):
    a, b = coo([(i, k, i + k) for i in range(20) for k in range(i % 7)]), coo([(k, j, k - j) for k in range(7) for j in range(0, 30, k + 1)])
    held = stored.store(a, "a_by_column", "j", 4, str(tmp_path / "a")), stored.store(b, "b_by_row", "i", 4, str(tmp_path / "b"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = product.partials(*held)
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and "Join" in plan
    assert rows(product.product(*held), "i", "j", "v") == rows(product.product(a, b), "i", "j", "v")
