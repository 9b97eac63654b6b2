"""Search calls as a stream: each query is asked once, refusals are waited out, and rates are kept."""

import os
from collections import Counter

import pytest

from tallygrain.sources import recorded, search_stream
from tallygrain.sources.search_stream import Bucket, asked


def test_a_bucket_keeps_the_rate():
    clock = [0.0]
    sleep = lambda s: clock.__setitem__(0, clock[0] + s)
    b = Bucket(2.0, 3.0, lambda: clock[0], sleep)
    at = []
    for _ in range(7):
        b.take()
        at.append(clock[0])
    assert at == pytest.approx([0, 0, 0, 0.5, 1.0, 1.5, 2.0])
    clock[0] += 100
    for _ in range(4):  # a long pause saves up no more than the burst
        b.take()
    assert clock[0] == pytest.approx(102.5)


def test_only_refusals_are_tried_again():
    for error, tries in ((RuntimeError("202 Ratelimit"), 3), (OSError("HTTP 429"), 3), (ValueError("Too Many Requests"), 3), (OSError("no route"), 1), (ValueError("2029 results"), 1)):
        waits, calls = [], []

        def provider(q, k, country):
            calls.append(q)
            raise error

        rows, n, told = asked(provider, "q", 5, "uk", 3, 1.0, waits.append)
        assert (rows, n, len(calls)) == ([], tries, tries) and told == f"{type(error).__name__}: {error}"
        assert waits == [1.0, 2.0][: tries - 1]


def test_top_k_is_cut_before_rows_without_title_go():
    rows, n, error = asked(lambda q, k, c: iter([("t", "u", "s"), ("", "u", "s"), ("t", None, "s"), ("t4", "u4", "s")]), "q", 3, "uk", 3, 1.0)
    assert (rows, n, error) == ([(0, "t", "u", "s")], 1, None)


@pytest.fixture
def provider(tmp_path):
    log = str(tmp_path / "calls")

    def ask(query, k, country):
        with open(log, "a") as f:
            f.write(query + "\n")
        if query.startswith("bad"):
            raise ValueError("no")
        if query.startswith("busy") and open(log).read().split("\n").count(query) < 2:
            raise RuntimeError("ratelimit")
        for i in range(2 if not query.startswith("none") else 0):
            yield f"{query} {i}", f"https://x.example/{i}", country

    recorded.PROVIDERS["counted"] = ask
    yield lambda: Counter(open(log).read().split("\n")[:-1]) if os.path.exists(log) else Counter()
    del recorded.PROVIDERS["counted"]


def test_restarts_ask_nothing_twice(spark, tmp_path, provider):
    spark.dataSource.register(search_stream.search_stream("counted"))
    (tmp_path / "queries").mkdir()
    (tmp_path / "queries" / "a.txt").write_text("\n".join([f"q{i}" for i in range(12)] + ["", "bad one", "busy two", "none"]) + "\n")
    got, fails = {}, [1]

    def sink(df, batch):
        rows = df.collect()
        if batch == 1 and fails:  # the second batch is lost after its queries were asked
            fails.pop()
            raise RuntimeError("sink lost")
        got[batch] = rows

    def run():
        stream = spark.readStream.format("tallygrain_counted_stream").option("path", f"file://{tmp_path}/queries").option("journal", f"file://{tmp_path}/journal")
        stream = stream.option("rate", "200").option("batch", "7").option("parallel", "2").option("wait", "0.01").load()
        return stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).start()

    q = run()
    with pytest.raises(Exception, match="sink lost"):
        q.processAllAvailable()
    q.stop()
    q = run()
    q.processAllAvailable()
    (tmp_path / "queries" / "b.txt").write_text("later\n")
    q.processAllAvailable()
    q.stop()
    q = run()
    q.processAllAvailable()
    q.stop()
    want = Counter({f"q{i}": 1 for i in range(12)} | {"bad one": 1, "busy two": 2, "none": 1, "later": 1})
    assert provider() == want
    rows = [r for b in got.values() for r in b]
    assert Counter(r.query for r in rows) == Counter({f"q{i}": 2 for i in range(12)} | {"bad one": 1, "busy two": 2, "none": 1, "later": 2})
    told = {r.query: (r.tries, r.error) for r in rows}
    assert told["bad one"] == (1, "ValueError: no") and told["busy two"] == (2, None) and told["none"] == (1, None) and told["q3"] == (1, None)
