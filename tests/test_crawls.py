"""Page search, searches under a ceiling and versioned state against plain Python, and runs that break off."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from recordmill.operators import search as SE
from recordmill.operators import versions as V


def visited(site, start, pages, links, most, overlap):
    """Plain best-first search of one site."""
    front, known, out, n = [(-100.0, 0, 0, start)], {start}, [], 0
    home = pages.get((site, start), (None, None, set()))[2]
    while front and n < most:
        front.sort()
        url, n = front.pop(0)[3], n + 1
        page = pages.get((site, url))
        score, certain, words = page or (0, False, set())
        same = page is not None and len(words & home) >= overlap * max(1, min(len(words), len(home)))
        out.append((site, n, url, page is not None, score, certain, same))
        if certain:
            break
        best = {}
        for target, weight, at in links.get((site, url), []):
            if weight > 0:
                w, a = best.get(target, (0, at))
                best[target] = (max(w, weight), min(a, at))
        front += [(-w, n, a, t) for t, (w, a) in best.items() if t not in known]
        known |= set(best)
    return out


def made_web(seed):
    rng = random.Random(seed)
    sites, urls, words = [None, "a", "b", "c", "d", "e"], [f"/{i}" for i in range(12)], "one two three four five six".split()
    pages = {(s, u): (rng.choice([0, 1, 2, 3]), rng.random() < 0.05, set(rng.sample(words, rng.randrange(7)))) for s in sites for u in urls if rng.random() < 0.7}
    links = {(s, u): [(rng.choice(urls), float(rng.choice([0, 1, 2])), k) for k in range(rng.randrange(6))] for s in sites for u in urls}
    return sites, pages, links


@pytest.mark.parametrize("most", [1, 5])
def test_visits_equal_a_plain_search(spark, most):
    sites, pages, links = made_web(most)
    p = spark.createDataFrame([(s, u, score, c, sorted(w)) for (s, u), (score, c, w) in pages.items()], "site string, url string, score long, certain boolean, words array<string>")
    on = spark.createDataFrame([(s, u, *x) for (s, u), xs in links.items() for x in xs], "site string, url string, target string, weight double, at long")
    starts = spark.createDataFrame([(s, "/0", 100.0) for s in sites], "site string, url string, weight double")
    got = SE.visit_sites(starts, p, on, most)
    want = [row for s in sites for row in visited(s, "/0", pages, links, most, 0.8)]
    order = lambda r: (r[0] or "", r[1])
    assert sorted((tuple(r) for r in got.collect()), key=order) == sorted(want, key=order)
    best = {r["site"]: r for r in SE.best_pages(got).collect()}
    for s, rows in itertools.groupby(sorted(want, key=order), key=lambda r: r[0]):
        rows = list(rows)
        ok = [r for r in rows if r[3] and r[4] > 0 and (r[5] or not r[6])]
        top = min(ok, key=lambda r: (-r[4], r[1])) if ok else None
        assert (best[s]["status"], best[s]["url"], best[s]["visited"]) == ("found" if top else "notFound" if any(r[3] for r in rows) else "unreachable", top and top[2], len(rows))
    assert SE.visit_sites(starts.limit(0), p, on, most).count() == 0


def test_a_soft_404_is_not_the_page(spark):
    words = [f"w{i}" for i in range(10)]
    pages = spark.createDataFrame([("s", "/", 0, False, words), ("s", "/x", 9, False, words[:9]), ("s", "/y", 2, False, ["other"]), ("t", "/", 5, True, words)], "site string, url string, score long, certain boolean, words array<string>")
    links = spark.createDataFrame([("s", "/", "/x", 2.0, 1), ("s", "/", "/y", 1.0, 2), ("s", "/", "/gone", 3.0, 0)], "site string, url string, target string, weight double, at long")
    starts = spark.createDataFrame([("s", "/", 9.0), ("t", "/", 9.0), ("u", "/", 9.0)], "site string, url string, weight double")
    got = {r["site"]: (r["status"], r["url"], r["visited"]) for r in SE.best_pages(SE.visit_sites(starts, pages, links)).collect()}
    assert got == {"s": ("found", "/y", 4), "t": ("found", "/", 1), "u": ("unreachable", None, 1)}


@pytest.mark.parametrize("ceiling", [1, 7, 1000])
def test_searches_cover_every_row_once(spark, ceiling):
    rng = random.Random(ceiling)
    rows = [(i, rng.choice(["x", "x", "x", "y", None]), rng.choice([1, 2, None])) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, f string, g int")
    searches = SE.covering_searches(df, ["f", "g"], ceiling).collect()
    assert sum(r["hits"] for r in searches) == 200
    assert all(r["parts"] == 1 or r["depth"] == 2 for r in searches) and all(-(-r["hits"] // r["parts"]) <= ceiling for r in searches)
    found = SE.searched_rows(df, ["f", "g"], ["id"], ceiling)
    assert sorted(r["id"] for r in found.collect()) == list(range(200))
    masked = [F.when(F.col("depth") > i, F.col(c)).alias(c) for i, c in enumerate(["f", "g"])]
    sizes = found.groupBy("depth", *masked, "part").count().collect()
    assert max(r["count"] for r in sizes) <= ceiling and len(sizes) == sum(r["parts"] for r in searches)
    for r in searches:  # as short as the ceiling allows
        if r["depth"]:
            parent = [x for x in rows if r["depth"] == 1 or x[1] == r["f"]]
            assert len(parent) > ceiling
    assert SE.covering_searches(df.limit(0), ["f", "g"], ceiling).count() == 0


SCHEMA = "l string, i string, r long"


def ranked(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_a_run_that_breaks_off_leaves_whole_lists(spark, tmp_path):
    state = V.VersionedState(spark, str(tmp_path / "s"), SCHEMA, ["l"])
    assert state.current().count() == 0 and state.commits() == []
    first = [("a", ranked(spark, ("a", "x", 1), ("a", "y", 2))), ("b", ranked(spark, ("b", "x", 1)))]
    V.track_lists(state, "run1", first, lambda n, df: None)

    def broken(name, rows):
        if name == "b":
            raise ConnectionError

    second = [("a", ranked(spark, ("a", "y", 1))), ("b", ranked(spark, ("b", "z", 1)))]
    with pytest.raises(ConnectionError):
        V.track_lists(state, "run2", second, broken)
    assert sorted(tuple(r) for r in state.current().collect()) == [("a", "y", 1), ("b", "x", 1)]
    V.track_lists(state, "run2", second, lambda n, df: None)  # the run again: a is not published twice, b now is
    assert sorted(tuple(r) for r in state.current().collect()) == [("a", "y", 1), ("b", "z", 1)]
    assert [(c["run"], c["name"], c["version"]) for c in state.commits()] == [("run1", "a", 1), ("run1", "b", 2), ("run2", "a", 3), ("run2", "b", 4)]


def test_rows_without_a_record_do_not_exist(spark, tmp_path, monkeypatch):
    state = V.VersionedState(spark, str(tmp_path / "s"), SCHEMA, ["l"])
    state.publish("r1", "all", ranked(spark, ("a", "x", 1), (None, "x", 1)))
    monkeypatch.setattr(V.json, "dumps", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):  # killed after the rows, before the record
        state.publish("r2", "all", ranked(spark, ("a", "q", 9)))
    monkeypatch.undo()
    assert sorted(tuple(r) for r in state.current().collect() if r["l"]) == [("a", "x", 1)] and state.current().count() == 2
    assert state.publish("r2", "all", ranked(spark, ("a", "q", 9))) and not state.publish("r2", "all", ranked(spark, ("a", "w", 9)))
    assert sorted(r["i"] for r in state.current().collect()) == ["q", "x"]


def test_replayed_batches_are_published_once(spark, tmp_path):
    state = V.VersionedState(spark, str(tmp_path / "s"), SCHEMA, ["l"])
    (tmp_path / "in").mkdir()
    ranked(spark, ("a", "x", 1), ("b", "y", 1)).write.parquet(str(tmp_path / "in" / "1"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in" / "*"))
    write = state.batches()
    query = stream.writeStream.foreachBatch(lambda df, n: [write(df, n), write(df, n)] and None).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(state.commits()) == 1 and state.current().count() == 2


def test_compared_lists(spark, tmp_path):
    state = V.VersionedState(spark, str(tmp_path / "s"), SCHEMA, ["l"])
    state.publish("r1", "a", ranked(spark, ("a", "x", 1), ("a", "y", 2), ("a", "z", 3)))
    now = ranked(spark, ("a", "y", 1), ("a", "w", 2), ("b", "x", 1), ("b", "y", 7))
    got = {(r["l"], r["i"]): r["change"] for r in V.compare_lists(state, now, "i", "r", 2).collect()}
    assert got == {("a", "y"): "up", ("a", "w"): "new", ("a", "x"): "dropped", ("b", "x"): "baseline"}
