"""Polled services as data sources."""

import json

import pytest

from tessera.sources import pollers as P


def put(folder, *names):
    folder.mkdir(exist_ok=True)
    for n in names:
        (folder / f"{n}.json").write_text(json.dumps({"title": n, "url": f"https://x.org/{n}", "text": f"text of {n}\nmore"}))


def test_clips_come_once_after_a_failed_batch(spark, tmp_path):
    service, spool, checkpoint = tmp_path / "service", f"file://{tmp_path}/spool", f"{tmp_path}/checkpoint"
    seen, fail = [], [True]

    def sink(df, epoch):
        rows = [(r.title, r.text) for r in df.collect()]
        if rows and fail and fail.pop():
            raise RuntimeError("the batch fails")
        seen.extend(rows)

    def run(n):
        stream = P.polled_clips(spark, "tessera.sources.pollers:drain_folder", f"file://{service}", spool)
        q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
        try:
            for _ in range(300):
                if len(seen) >= n or q.exception():
                    break
                q.awaitTermination(0.2)
            if q.exception():
                raise q.exception()
        finally:
            q.stop()

    put(service, "a", "b")
    with pytest.raises(Exception, match="the batch fails"):
        run(2)
    assert not list(service.iterdir()) and not seen  # the service has forgotten them
    put(service, "c")
    run(3)
    put(service, "d", "e")
    run(5)
    assert sorted(t for t, _ in seen) == ["a", "b", "c", "d", "e"] and seen[0][1].endswith("\nmore")


def test_offsets_and_commits(tmp_path):
    service = tmp_path / "service"
    put(service, "a", "b")
    options = {"call": "tessera.sources.pollers:drain_folder", "argument": f"file://{service}", "spool": f"file://{tmp_path}/spool"}
    r = P.ClipReader(options)
    assert r.initialOffset() == {"rows": 0}
    rows, end = r.read({"rows": 0})
    assert [x[0] for x in rows] == ["a", "b"] and end == {"rows": 2}
    put(service, "c")
    rows, later = P.ClipReader(options).read(end)
    assert [x[0] for x in rows] == ["c"] and later == {"rows": 3}
    assert [x[0] for x in r.readBetweenOffsets({"rows": 1}, {"rows": 3})] == ["b", "c"]
    r.commit(later)
    assert len(r._spooled()) == 1 and r.read(later)[1] == later  # nothing new


def test_searches_are_partitions(spark):
    df = P.searched(spark, "tessera.sources.pollers:echo", ["ab", "rope", "ab"])
    assert df.rdd.getNumPartitions() == 2 and {(r.query, r.place) for r in df.collect()} == {("ab", 0), ("ab", 1), *(("rope", i) for i in range(4))}
    assert P.searched(spark, "tessera.sources.pollers:echo", []).count() == 0
