"""Recorded feeds: bounds of a batch, and a query that is killed and started again."""

from __future__ import annotations

import json

from tidewater.sources import replay


def record(folder, files):
    folder.mkdir(exist_ok=True)
    for name, times in files.items():
        (folder / name).write_text("".join(json.dumps({"received_ms": t, "n": f"{name}:{i}é"}, ensure_ascii=False) + "\n" for i, t in enumerate(times)))


def offsets(reader, most=50):
    out = [reader.initialOffset()]
    for _ in range(most):
        out.append(reader.latestOffset())
        if out[-1] == out[-2]:
            break
    return out


def lines(reader, start, end):
    return [row[3] for part in reader.partitions(start, end) for row in reader.read(part)]


def test_both_bounds_of_a_batch(tmp_path):
    record(tmp_path / "feed", {"a": [*range(7)], "b": [7, 8, 2_000, 2_999, 3_000], "c": [3_001]})
    reader = replay.FeedReader({"path": str(tmp_path / "feed"), "progress": str(tmp_path / "p"), "rows": "4", "span_ms": "1000"})
    at = offsets(reader)
    sizes = [len(lines(reader, a, b)) for a, b in zip(at, at[1:])]
    assert sizes == [4, 4, 1, 2, 2, 0]  # by rows, by rows, by time, by time, the rest
    assert sum((lines(reader, a, b) for a, b in zip(at, at[1:])), []) == lines(reader, at[0], at[-1])


def test_lines_that_are_not_whole_or_not_json(tmp_path):
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed/a").write_bytes(b'{"received_ms": 1}\nnoise\n\n{"received_ms": "x"}\n{"received_ms": 5}')
    reader = replay.FeedReader({"path": str(tmp_path / "feed"), "progress": str(tmp_path / "p")})
    at = offsets(reader)
    assert [r[2] for p in reader.partitions(at[0], at[-1]) for r in reader.read(p)] == [1, None, None, None]
    with (tmp_path / "feed/a").open("ab") as f:
        f.write(b"\n")
    later = reader.latestOffset()
    assert [r[2] for p in reader.partitions(at[-1], later) for r in reader.read(p)] == [5]


def test_offset_is_offered_again_after_a_start(tmp_path):
    record(tmp_path / "feed", {"a": [*range(10)]})
    options = {"path": str(tmp_path / "feed"), "progress": str(tmp_path / "p"), "rows": "3"}
    first = replay.FeedReader(options)
    one, two = first.latestOffset(), first.latestOffset()
    again = replay.FeedReader(options)
    assert again.latestOffset() == two and len(lines(again, two, again.latestOffset())) == 3
    assert len(lines(again, one, two)) == 3


def test_killed_and_restarted(spark, tmp_path):
    record(tmp_path / "feed", {f"{k}": [100 * (40 * k + i) for i in range(40)] for k in range(3)})
    seen, calls = {}, []

    def once(fail_at):
        def sink(df, epoch):
            calls.append(epoch)
            rows = [r["payload"] for r in df.collect()]
            if epoch == fail_at:
                raise RuntimeError("killed")
            seen[epoch] = rows  # a batch that runs again replaces its rows

        stream = replay.recorded(spark, str(tmp_path / "feed"), str(tmp_path / "progress"), rows=7)
        query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="0 seconds").start()
        try:
            for _ in range(60):
                if query.awaitTermination(1) or sum(map(len, seen.values())) >= 120:
                    break
        except Exception as e:
            assert "killed" in str(e)
        query.stop()

    once(2)  # fails in its third batch
    assert len(seen) == 2
    once(5)
    once(None)
    every = [line for epoch in sorted(seen) for line in seen[epoch]]
    assert len(every) == len(set(every)) == 120 and max(map(len, seen.values())) == 7
    assert len(calls) > len(seen)
