"""vecs files, generated data, the command line and streams."""

import numpy as np
import pytest

from vecmill import cli
from vecmill.sources import generate as G
from vecmill.sources import vecs as X
from vecmill.streaming.scoring import StreamingKMeans, assign_stream


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    spark.dataSource.register(X.VecsDataSource)


def rows(df):
    return [list(r["embedding"]) for r in df.orderBy("vec_id").collect()]


@pytest.mark.parametrize("kind", ["float", "int", "byte"])
def test_round_trip(spark, tmp_path, kind):
    values = np.random.default_rng(1).integers(0, 256, (50, 7))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(values)], "vec_id long, embedding array<double>")
    X.write_vecs(df, f"{tmp_path}/x", kind)
    got = spark.read.format("vecs").option("elementType", kind).load(f"{tmp_path}/x")
    assert rows(got) == values.tolist() and rows(X.read_vecs(spark, f"{tmp_path}/x", kind)) == values.tolist()
    assert [r["vec_id"] for r in got.orderBy("vec_id").collect()] == list(range(50))


def test_splits_and_ragged_files(spark, tmp_path, monkeypatch):
    X.write_matrix(np.arange(40).reshape(10, 4), f"{tmp_path}/even")
    monkeypatch.setattr(X, "SPLIT_BYTES", 60)
    assert len(X.VecsReader({"path": f"{tmp_path}/even"}).partitions()) == 4
    (tmp_path / "ragged").write_bytes(X.encode([[1.0], [2.0, 3.0], []]))
    assert rows(spark.read.format("vecs").load(f"{tmp_path}/ragged")) == [[1.0], [2.0, 3.0], []]
    monkeypatch.setattr(X, "SPLIT_BYTES", 8)
    (tmp_path / "uneven").write_bytes(X.encode([[1.0], [2.0, 3.0, 4.0], [5.0]]))  # as long as four records of one
    with pytest.raises(ValueError, match="split false"):
        reader = X.VecsReader({"path": f"{tmp_path}/uneven"})
        [r for p in reader.partitions() for r in reader.read(p)]
    assert rows(spark.read.format("vecs").option("split", "false").load(f"{tmp_path}/uneven")) == [[1.0], [2.0, 3.0, 4.0], [5.0]]
    with pytest.raises(Exception, match="absent"):
        spark.read.format("vecs").load(f"{tmp_path}/absent").collect()
    (tmp_path / "empty").write_bytes(b"")
    assert rows(spark.read.format("vecs").load(f"{tmp_path}/empty")) == []


@pytest.mark.parametrize("cut", [2, 9])
def test_truncated_file_fails(spark, tmp_path, cut):
    (tmp_path / "cut").write_bytes(X.encode([[1.0, 2.0], [3.0, 4.0]])[: 12 + cut])
    with pytest.raises(Exception, match="truncated"):
        spark.read.format("vecs").load(f"{tmp_path}/cut").collect()
    with pytest.raises(ValueError):
        X.encode([[1.0]], "double")


def test_generated_data(spark, tmp_path):
    made = G.generate(spark, str(tmp_path), dim=20, n=200, queries=5, k=3)
    base, query = np.array(rows(made["base"])), np.array(rows(made["query"]))
    truth = rows(spark.read.format("vecs").option("elementType", "int").load(f"{tmp_path}/groundtruth.ivecs"))
    for q, near in zip(query, truth, strict=True):
        d = ((base - q) ** 2).sum(1)
        assert near == np.lexsort((np.arange(200), d))[:3].tolist()
    assert np.allclose(rows(spark.read.format("vecs").load(f"{tmp_path}/centroids.fvecs"))[0], base.mean(0), atol=1e-4)
    assert base.min() >= 0 and base.max() <= 255 and len(np.unique(base)) > 200


def test_cli(spark, tmp_path):
    X.write_matrix(np.random.default_rng(0).random((300, 8)), f"{tmp_path}/in.fvecs")
    cli.main(["-i", f"{tmp_path}/in.fvecs", "-o", f"{tmp_path}/out.fvecs", "-n", "5", "-m", "3"])
    assert np.array(rows(spark.read.format("vecs").load(f"{tmp_path}/out.fvecs"))).shape == (5, 8)


def test_streams(spark, tmp_path):
    x = np.random.default_rng(0).random((100, 4))
    for part in range(2):
        spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x[part * 50 : part * 50 + 50])], "vec_id long, embedding array<double>").coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema("vec_id long, embedding array<double>").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = assign_stream(stream, x[:3]).writeStream.format("memory").queryName("assigned").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("assigned").count() == 100
    model = StreamingKMeans(x[:3])
    q = stream.writeStream.foreachBatch(model.update).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert model.weight.sum() == 100 and model.model.iterations == 2
    model.update(spark.read.parquet(f"{tmp_path}/in/0"), 0)
    assert model.weight.sum() == 100
