import numpy as np

from tessella.sources import points as P
from tessella.streaming.mini_batch import StreamingMiniBatch


def test_stream_gives_running_means_once(spark, tmp_path):
    r = np.random.default_rng(0)
    x = r.normal(size=(90, 2)) + 50 * (np.arange(90) % 3)[:, None]
    start = np.array([[0.0, 0], [50, 50], [100, 100]])
    frame = P.from_matrix(spark, x)
    for part in range(3):
        frame.where(f"obs_id % 9 div 3 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    model = StreamingMiniBatch(start, str(tmp_path / "state"))
    model.start(stream, str(tmp_path / "check")).awaitTermination(120)
    want = np.array([x[np.arange(90) % 3 == j].mean(0) for j in range(3)])
    assert np.allclose(model.centers, want) and model.counts.tolist() == [30] * 3
    again = StreamingMiniBatch(start, str(tmp_path / "state"))
    again.update(frame, 2)  # a micro-batch that was taken in already
    assert np.allclose(again.centers, want) and again.last == 2
    assert {r["cid"] for r in again.predict(frame.where("obs_id % 3 = 1")).collect()} == {1}
