import struct

import pytest
from pyspark.sql import functions as F

from weftline.functions import bits
from weftline.operators import blocks, layout, product, splits
from weftline.sources import mtx, records, result, words
from weftline.sources.folders import shared_folder
from weftline.streaming.append_product import append_product


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def write(path, text):
    path.write_text(text)
    return str(path)


def test_symmetric_pattern(spark, tmp_path):
    path = write(tmp_path / "m.mtx", "%%MatrixMarket matrix coordinate pattern symmetric\n% comment\n3 3 3\n1 1\n2 1\n3 2\n")
    assert rows(mtx.read_mtx(spark, path)) == sorted((i, j, 0.1234) for i, j in [(0, 0), (1, 0), (0, 1), (2, 1), (1, 2)])


def test_entries_that_look_like_the_size_line(spark, tmp_path):
    path = write(tmp_path / "m.mtx", "%%MatrixMarket matrix coordinate integer general\n3 3 3\n3 3 3\n1 2 -7\n3 3 3\n")
    assert rows(mtx.read_mtx(spark, path)) == [(0, 1, -7.0), (2, 2, 3.0), (2, 2, 3.0)]


@pytest.mark.parametrize("banner", ["%%MatrixMarket matrix array real general", "%%MatrixMarket matrix coordinate complex general", "%%MatrixMarket matrix coordinate real skew-symmetric"])
def test_unsupported_kinds(spark, tmp_path, banner):
    with pytest.raises(ValueError, match="unsupported"):
        mtx.read_mtx(spark, write(tmp_path / "m.mtx", f"{banner}\n1 1 0\n"))


def test_missing_path(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        mtx.read_mtx(spark, str(tmp_path / "none.mtx"))


def test_round_trip_in_parts(spark, coo, tmp_path):
    m = coo([(i, j, i - j / 4) for i in range(20) for j in range(0, 20, 3)]).repartition(3)
    mtx.write_mtx(m, str(tmp_path / "out"), 20, 20)
    assert rows(mtx.read_mtx(spark, str(tmp_path / "out"))) == rows(m)
    assert mtx.read_header(spark, str(tmp_path / "out")).entries == 140


def test_record_files(spark, coo, tmp_path):
    a, b = coo([(i, k, 1) for i in range(4) for k in range(5)]), coo([(k, j, 1) for k in range(5) for j in range(k + 1)])
    cuts = layout.block_cuts(layout.row_spans(a, b), 8)
    made = splits.partition_records(layout.record_openings(a, cuts), splits.split(a, b, cuts, 8), a, blocks.carries(a, b, 8)).cache()
    records.write_records(made, str(tmp_path / "records"))
    assert rows(records.read_records(spark, str(tmp_path / "records"))) == rows(made)
    offsets = layout.record_offsets(layout.record_openings(a, cuts))
    records.export_words(made, offsets, str(tmp_path / "words"))
    assert rows(records.import_words(spark, str(tmp_path / "words"))) == rows(made)
    packed = spark.read.parquet(str(tmp_path / "words")).orderBy("blk").collect()
    raw = b"".join(r.words for r in packed)
    assert len(raw) == 4 * made.count()
    assert [struct.unpack_from("<I", raw, 4 * r.ptr)[0] for r in packed] == [r.value for r in made.where("word = 0").orderBy("blk").collect()]
    lines = records.split_lines(cuts, offsets.select("blk", offsets.ptr.alias("off"))).collect()
    assert len(lines) == cuts.count() and all(len(x.value.split()) == 4 for x in lines)


def test_result_tables(spark, coo, tmp_path):
    m = coo([(i, j, i + j / 2) for i in (7, 2, 5) for j in (9, 1, 4)])
    result.write_csr(m, str(tmp_path / "c"))
    assert rows(result.read_csr(spark, str(tmp_path / "c"))) == [(*x, n) for n, x in enumerate(rows(m))]
    result.write_csr(m.limit(0), str(tmp_path / "none"))
    assert rows(result.read_csr(spark, str(tmp_path / "none"))) == []


def test_result_files_are_written_and_read_unshuffled(spark, coo, tmp_path, monkeypatch):
    m, path = coo([(i * 3, j, i + j / 2) for i in range(40) for j in range(i % 7 + 1)]), str(tmp_path / "f")
    result.write_files(m, path)
    for read in (result.read_csr(spark, f"{path}/tables"), result.read_files(spark, path)):
        plan = read._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hash" not in plan and "Sort" not in plan
    wanted = [(i // 3, n, j, v) for n, (i, j, v) in enumerate(rows(m))]
    assert rows(result.read_files(spark, path)) == wanted
    monkeypatch.setattr(words, "PORTION", 16)
    monkeypatch.setattr(words, "SPLIT_BYTES", 200)
    reader = words.CsrReader(path)
    assert len(reader.partitions()) > 2
    assert [tuple(x.values()) for piece in reader.partitions() for batch in reader.read(piece) for x in batch.to_pylist()] == wanted
    result.write_files(m.limit(0), f"{path}0")
    assert rows(result.read_files(spark, f"{path}0")) == []


@pytest.mark.parametrize("field,want", [("real", 2.5), ("integer", 2.0), ("pattern", 0.1234)])
def test_written_kinds(spark, coo, tmp_path, field, want):
    m = coo([(0, 0, 2.5), (2, 1, 2.5), (1, 2, 9)])
    mtx.write_mtx(m, str(tmp_path / "m"), 3, 3, field, "symmetric", "a comment")
    assert rows(mtx.read_mtx(spark, str(tmp_path / "m"))) == [(0, 0, want), (1, 2, want), (2, 1, want)]


def test_a_cluster_without_a_shared_folder(spark):
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(Session)


def test_bits(spark):
    n = spark.range(1, 70).select("id", bits.next_power(F.col("id")).alias("p"), bits.bit_width(F.col("id")).alias("w"))
    for r in n.collect():
        assert r.p == 1 << (r.id - 1).bit_length() and r.w == r.id.bit_length()


def test_stream_of_entries_adds_up(spark, coo, tmp_path):
    b = coo([(k, j, k + j) for k in range(4) for j in range(3)])
    a_rows = [(i, k, i + 1) for i in range(5) for k in range(4)]
    for n in range(2):
        coo(a_rows[n::2]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("i long, j long, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = append_product(stream, b, str(tmp_path / "out"), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    total = spark.read.parquet(str(tmp_path / "out")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    assert rows(total) == rows(product.product(coo(a_rows), b))
