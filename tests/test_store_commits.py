"""Commits over several tables, the stored index under updates, and ordered greedy choice."""

import datetime as dt
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemora.api import MemoryStore
from mnemora.functions import text as T
from mnemora.operators import fts, graph, textindex
from mnemora.operators import recall as R
from mnemora.sources.commits import CommitLog, latest_by

NOW = dt.datetime(2024, 1, 31)
ROWS = "id long, v string, seq long"


def put(c, spark, table, *rows):
    c.add(table, spark.createDataFrame([(*r, c.number) for r in rows], ROWS))


def state(log, table="a"):
    return sorted((r["id"], r["v"]) for r in latest_by(log.read(table, ROWS).drop("commit"), ["id"]).collect())


def test_a_failure_between_two_tables_shows_nothing(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/s")
    with log.commit() as c:
        put(c, spark, "a", (1, "one"))
        put(c, spark, "b", (1, "eins"))
    with pytest.raises(RuntimeError), log.commit() as c:
        put(c, spark, "a", (1, "two"), (2, "new"))
        raise RuntimeError("lost between the tables")
    again = CommitLog(spark, f"file://{tmp_path}/s")
    assert state(again) == [(1, "one")] and state(again, "b") == [(1, "eins")]
    with again.commit() as c:
        put(c, spark, "a", (3, "three"))
    assert c.number == 3 and state(log) == [(1, "one"), (3, "three")]
    assert log.vacuum() == 1 and state(log) == [(1, "one"), (3, "three")]


def test_writers_at_once_lose_nothing(spark, tmp_path):
    """Every row of every writer is there, and numbers are taken once."""
    logs = [CommitLog(spark, f"file://{tmp_path}/s") for _ in range(6)]
    taken, start = [], threading.Barrier(6)

    def write(i):
        start.wait()
        for k in range(2):
            with logs[i].commit() as c:
                put(c, spark, "a", (10 * i + k, "x"), (99, f"{i}{k}"))
            taken.append(c.number)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(taken) == list(range(1, 13))
    got = dict(state(CommitLog(spark, f"file://{tmp_path}/s")))
    assert len(got) == 13 and got[99] in {f"{i}{k}" for i in range(6) for k in range(2)}


def test_compaction_beside_a_late_writer(spark, tmp_path):
    """A commit claimed before a compaction and published after it keeps its place: newer rows of other commits win over it."""
    log = CommitLog(spark, f"file://{tmp_path}/s")
    with log.commit() as c:
        put(c, spark, "a", (1, "old"), (2, "old"))
    late = log.commit()
    put(late, spark, "a", (1, "late"), (2, "late"))
    with log.commit() as c:
        put(c, spark, "a", (1, "new"))
    fold = lambda rows: latest_by(rows.drop("commit"), ["id"])
    log.compact({"a": (ROWS, (), fold)})
    assert len(log.manifests()) == 1 and state(log) == [(1, "new"), (2, "old")]
    late.publish()
    assert state(log) == [(1, "new"), (2, "late")]
    assert log.vacuum() == 2 and state(log) == [(1, "new"), (2, "late")]


TEXTS = {i: " ".join(f"w{(i * k * 7 + k) % 23}" for k in range(1, 6 + i % 9)) + (" red-fox" if i % 6 == 0 else " red x fox" if i % 6 == 1 else "") for i in range(120)}


def frames(spark, texts):
    d = spark.createDataFrame([(i, t) for i, t in texts.items()], "id long, text string")
    q = spark.createDataFrame([(0, "w1 w7"), (1, "red-fox"), (2, "w3"), (3, "nowhere w1"), (4, "?!"), (5, "w2 red-fox w9 w4")], "query_id long, query string")
    return d, q, q.select("query_id", F.flatten(F.transform(T.query_phrases(F.col("query")), T.tokens)).alias("terms"))


def rows(df):
    return sorted(map(tuple, df.select("query_id", "id", "score", "hits").collect()))


def same_as_scan(spark, index, texts):
    d, q, terms = frames(spark, texts)
    text = F.col("text")
    assert rows(index.bm25(terms)) == rows(fts.bm25(d, terms, text=text))
    assert rows(index.match_all(q)) == rows(fts.bm25(d, terms, text=text, only=fts.match_all(d, q, text=text)))
    best = sorted(map(tuple, index.top(terms, 5).select("query_id", "fts_pos", "id", "score").collect()))
    want = {}
    for query, i, score, _ in rows(fts.bm25(d, terms, text=text)):
        want.setdefault(query, []).append((-score, i))
    assert best == sorted((query, n + 1, i, -s) for query, found in want.items() for n, (s, i) in enumerate(sorted(found)[:5]))


@pytest.mark.parametrize(("split", "stripe", "named"), [(10_000, 1024, 1024), (1, 7, 1024), (1, 7, 2)])
def test_index_under_updates(spark, tmp_path, monkeypatch, split, stripe, named):
    """Equal to a scan of the texts after changes, deletions, a return of a deleted id and a compaction; small and large segments."""
    for name, value in (("SPLIT_FROM", split), ("STRIPE", stripe), ("NAMED", named), ("FIRST", 2)):
        monkeypatch.setattr(textindex, name, value)
    df = lambda t: spark.createDataFrame(list(t.items()), "id long, text string")
    texts = dict(TEXTS)
    index = textindex.indexed(spark, f"file://{tmp_path}/i", df(texts))
    same_as_scan(spark, index, texts)
    changed = {3: "w1 w7 w7 red-fox", 6: "", 500: "w3 w3 red fox w4 w2 w9"}
    with index.log.commit() as c:
        index.write(c, df(changed), df({i: texts[i] for i in changed if i in texts}))
    texts |= changed
    gone = {i: texts.pop(i) for i in (0, 12, 13, 500)}
    with index.log.commit() as c:
        index.write(c, None, df(gone))
    with index.log.commit() as c:
        index.write(c, df({12: "w7 w1 back again"}))
    texts[12] = "w7 w1 back again"
    same_as_scan(spark, index, texts)
    written = index.log.read("postings", index.schemas["postings"]).filter(F.col("commit") == 2)
    assert {i for r in written.select("ids").collect() for i in r["ids"]} == {3, 500}  # an update writes its own documents' terms
    index.log.compact(index.folds())
    assert len(index.log.manifests()) == 1
    same_as_scan(spark, index, texts)


def test_index_reads_the_terms_buckets_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "SPLIT_FROM", 1)
    index = textindex.indexed(spark, f"file://{tmp_path}/i", frames(spark, TEXTS)[0])
    plan = index.match_all(frames(spark, TEXTS)[1].filter("query_id = 2"))._jdf.queryExecution().optimizedPlan().toString()
    bucket = spark.range(1).select(textindex.bucket(F.lit("w3"))).first()[0]
    scan = next(x for x in plan.splitlines() if "Filter" in x and "bucket#" in x)
    assert f"IN (-1,{bucket})" in scan and "= w3" in scan
    physical = index.match_all(frames(spark, TEXTS)[1].filter("query_id = 2"))._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in physical.splitlines() if "FileScan" in x and "places" in x)
    assert "PartitionFilters: [bucket#" in scan and "w3" in scan.split("PushedFilters")[1]


def test_index_sends_a_posting_once_for_all_queries(spark, tmp_path, monkeypatch):
    """What is shuffled knows no query, and answers in several blocks of queries equal a scan's, with a tombstone too."""
    index = textindex.indexed(spark, f"file://{tmp_path}/i", frames(spark, TEXTS)[0])
    _, q, terms = frames(spark, TEXTS)
    for df in (index.match_all(q), index.bm25(terms)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression [stripe" in plan and "query_id" not in plan[plan.index("RepartitionByExpression") :]
    monkeypatch.setattr(textindex, "QUERY_BLOCK", 2)
    with index.log.commit() as c:
        index.write(c, None, spark.createDataFrame([(7, TEXTS[7])], "id long, text string"))
    same_as_scan(spark, index, {i: t for i, t in TEXTS.items() if i != 7})


def test_empty_index(spark, tmp_path):
    d, q, terms = frames(spark, TEXTS)
    index = textindex.indexed(spark, f"file://{tmp_path}/i", d.limit(0))
    assert index.match_all(q).count() == index.bm25(terms).count() == index.top(terms).count() == 0


def test_store_commits_are_whole(spark, tmp_path, monkeypatch):
    """A save that fails after its memories are written leaves no memory, vector or posting; one batch guards itself."""
    s = MemoryStore(spark, f"file://{tmp_path}/store")
    text = "kafka brokers run the pipeline of the east zone"
    got = s.save([(text, "decision", [], "atlas", None), (text + " now", "decision", [], None, None), (text + " now", "pattern", [], "atlas", None), (text, "decision", [], "other", None)], NOW, 0.9).collect()
    assert sorted(r["status"] for r in got) == ["saved", "saved", "saved", "skipped_near_duplicate"]
    skipped = next(r for r in got if r["status"] != "saved")
    assert skipped["matched"] in {r["id"] for r in got if r["status"] == "saved"}
    monkeypatch.setattr(s.index, "write", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        s.save([("pulsar clusters replace everything", "decision", [], "atlas", None)], NOW)
    monkeypatch.undo()
    again = MemoryStore(spark, f"file://{tmp_path}/store")
    assert again.memories.count() == again.vectors.count() == 3 and again.recall("pulsar").filter("fts_hit").count() == 0
    (one,) = again.memories.filter("type = 'pattern'").collect()
    assert again.update(one["id"], content="zookeeper keeps the ledger") == "updated"
    assert [r["id"] for r in again.recall("zookeeper ledger", k=1).filter("fts_hit").collect()] == [one["id"]]
    again.compact()
    assert again.forget(one["id"]) == "deleted" and again.recall("zookeeper").filter("fts_hit").isEmpty() and again.vectors.count() == 2


def greedy(edges):
    """Nodes in order, each kept unless an earlier neighbour was."""
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    kept = set()
    for n in sorted(near):
        if not any(m in kept for m in near[n] if m < n):
            kept.add(n)
    return sorted((n, n in kept) for n in near)


@pytest.mark.parametrize("seed", range(3))
def test_first_independent_set_equals_the_loop(spark, tmp_path, seed):
    rng = np.random.default_rng(seed)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 40, (60, 2))] + [(i, i + 1) for i in range(100, 112)] + [(200, 200 + i) for i in range(1, 30)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert sorted(map(tuple, graph.first_independent(df, f"file://{tmp_path}/r").collect())) == greedy(edges)
    assert graph.first_independent(df.limit(0), f"file://{tmp_path}/r").count() == 0


def greedy_stars(stars, least):
    near = {}
    for seed, member in stars:
        if member != seed[1]:
            near.setdefault(seed, set()).add(member)
    used, out = set(), []
    for seed in sorted(near):
        free = near[seed] - used
        if seed[1] not in used and len(free) + 1 >= least:
            used |= free | {seed[1]}
            out += [(seed[1], m) for m in free | {seed[1]}]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_greedy_stars_equal_the_loop(spark, tmp_path, seed):
    """Random stars, a hub that all share, and a chain in which each decision hangs on the one before."""
    rng = np.random.default_rng(seed)
    at = dict(enumerate(rng.integers(0, 10, 400).tolist()))
    pairs = [tuple(map(int, e)) for e in rng.integers(0, 60, (150, 2))] + [(100 + i, 100 + j) for i in range(25) for j in (i + 1, i + 2)] + [(200 + i, 200) for i in range(1, 20)] + [(200 + i, 230 + i) for i in range(1, 20)]
    at |= {i: i for i in range(100, 130)}
    stars = [((at[a], a), b) for a, b in set(pairs)]
    df = spark.createDataFrame(stars, "seed struct<at: long, id: long>, member long")
    got = sorted((r["seed"]["id"], r["member"]) for r in graph.greedy_stars(df, 3, f"file://{tmp_path}/r").collect())
    assert got == greedy_stars(stars, 3) and got


def test_cache_scores_no_row_twice(spark, tmp_path):
    """A second call scores nothing, equal texts are scored once, the bound holds, and the least recently used go."""
    from mnemora.operators import cache

    c = cache.ScorerCache(CommitLog(spark, f"file://{tmp_path}/c"), "array<double>", 3)
    asked = []

    def embed(df, text):
        asked.extend(sorted(r[text] for r in df.collect()))
        return df.withColumn("embedding", F.array(F.length(text).cast("double")))

    def call(texts, day):
        rows = spark.createDataFrame(list(enumerate(texts)), "n long, text string")
        asked.clear()
        got = cache.embedded(c, rows, "text", embed, F.lit(NOW + dt.timedelta(days=day)).cast("timestamp"))
        return [(r["embedding"] and r["embedding"][0], r["hit"]) for r in got.orderBy("n").collect()]

    assert call(["a", "bb", "a", None], 0) == [(1.0, False), (2.0, False), (1.0, False), (None, None)] and asked == ["a", "bb"]
    assert call(["bb", "a"], 1) == [(2.0, True), (1.0, True)] and asked == []
    assert call(["ccc", "a"], 2) == [(3.0, False), (1.0, True)] and asked == ["ccc"]
    assert call(["dddd"], 3) == [(4.0, False)] and c.state().count() == 3  # bb was used longest ago
    assert call(["bb", "a", "ccc", "dddd", "eeeee"], 4)[:3] == [(2.0, False), (1.0, True), (3.0, True)] and asked == ["bb", "eeeee"]
    assert c.state().count() == 3


def test_judged_sets_come_from_the_cache(spark, tmp_path):
    from mnemora.operators import cache

    c = cache.ScorerCache(CommitLog(spark, f"file://{tmp_path}/j"), "map<long,double>", 10)
    judge = lambda df: df.select("key", F.map_from_arrays("ids", F.transform("ids", lambda i: i * 1.0)).alias("value"))
    pool = lambda *rows: spark.createDataFrame(rows, "query_id long, query string, id long")
    first = cache.judged_sets(c, pool((1, "q", 7), (1, "q", 8), (2, "other", 7)), judge, F.lit(NOW).cast("timestamp")).orderBy("query_id").collect()
    assert [(r["status"], r["scores"]) for r in first] == [("ok", {7: 7.0, 8: 8.0}), ("ok", {7: 7.0})]
    again = cache.judged_sets(c, pool((5, "q", 8), (5, "q", 7), (6, "q", 9)), judge, F.lit(NOW).cast("timestamp")).orderBy("query_id").collect()
    assert [r["status"] for r in again] == ["cache", "ok"] and again[0]["scores"] == {7: 7.0, 8: 8.0}
