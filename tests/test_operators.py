import datetime as dt

from pyspark.sql import functions as F

from mnemora.operators import beliefs, extract, graph, lifecycle, sessions
from mnemora.operators import recall as R
from mnemora.scorers import cautious, hashed_embedding
from mnemora.sources import store

def now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def memories(spark, rows):
    """rows: id, content, type, project, age in days."""
    made = [(i, c, t, p, ["x"], None, dt.datetime(2024, 1, 31) - dt.timedelta(days=a), 0, None, 0.5) for i, c, t, p, a in rows]
    return spark.createDataFrame(made, "id long, content string, type string, project string, tags array<string>, meta_source string, created_at timestamp, access_count long, last_accessed timestamp, importance double")


def relations(spark, rows):
    return spark.createDataFrame([(a, b, k, 1.0) for a, b, k in rows], "source_id long, target_id long, relation_type string, weight double")


def pairs(spark, rows):
    return spark.createDataFrame(rows, "a long, b long, sim double")


def test_conflicts(spark, tmp_path):
    m = memories(spark, [(1, "use kafka", "decision", "p", 14), (2, "use pulsar", "decision", "p", 0), (3, "x", "pattern", "p", 1), (4, "y", "decision", "q", 1), (5, "Phase 1 EXECUTED", "decision", "p", 3), (6, "Tier 2 LANDED", "decision", "p", 2)])
    sims = pairs(spark, [(1, 2, 0.83), (1, 3, 0.83), (1, 4, 0.83), (5, 6, 0.85), (2, 6, 1.0)])
    none = relations(spark, [])
    got = beliefs.conflict_pairs(sims, m, none, 0.8, 0.985)
    assert [(r["a"], r["b"], r["via"]) for r in got.collect()] == [(1, 2, "similarity")]
    flags = {r["id"]: r.asDict() for r in beliefs.conflict_flags(got.select("a", "b"), m, f"file://{tmp_path}").collect()}
    assert flags[2]["role"] == "current" and flags[1]["role"] == "superseded_candidate" and flags[1]["vs"] == 2 and flags[1]["age"] == "14d ago"
    edge = beliefs.conflict_pairs(sims.limit(0), m, relations(spark, [(6, 5, "contradicts")]), 0.8, 0.985)
    assert [(r["a"], r["b"], r["via"]) for r in edge.collect()] == [(5, 6, "edge")]


def test_supersede_pass(spark):
    m = memories(spark, [(1, "use A", "decision", None, 9), (2, "use B instead", "decision", "p", 1), (3, "t", "tool", None, 0), (4, "u instead", "tool", None, 1)])
    sims, none = pairs(spark, [(1, 2, 0.85), (3, 4, 0.9)]), relations(spark, [])
    got = beliefs.supersede_candidates(sims, m, none, 0.8, 0.97).collect()
    assert [(r["newer"], r["older"], r["verdict"]) for r in got] == [(2, 1, "supersedes")]
    assert beliefs.supersede_candidates(sims, m, relations(spark, [(2, 1, "relates_to")]), 0.8, 0.97).count() == 0


def test_classifier_guards(spark):
    df = spark.createDataFrame([("supersedes", 2.0, "no longer true", "x"), ("supersedes", 0.9, "plain", "x"), ("supersedes", 0.9, "P1 EXECUTED", "P2 LANDED"), (None, None, "a", "b")], "v string, c double, n string, o string")
    got = [tuple(r["x"]) for r in df.select(cautious(F.col("v"), F.col("c"), F.col("n"), F.col("o")).alias("x")).collect()]
    assert got == [("supersedes", 1.0), ("contradicts", 0.9), ("unrelated", 1.0), ("unrelated", 0.0)]


def test_clusters_by_hand(spark, tmp_path):
    m = memories(spark, [(i, "c", "pattern", "p", 20 - i) for i in range(1, 7)] + [(9, "c", "pattern", "p", 2)])
    sims = pairs(spark, [(1, 2, 0.9), (1, 3, 0.9), (2, 4, 0.9), (4, 5, 0.9), (4, 6, 0.9), (1, 9, 0.99)])
    got = beliefs.clusters(sims, m, relations(spark, []), now(), 0.65, f"file://{tmp_path}/r")
    assert {(r["seed"], r["member"]) for r in got.collect()} == {(1, 1), (1, 2), (1, 3), (4, 4), (4, 5), (4, 6)}
    # the members are ends of part_of edges after the run, so a second run finds nothing
    edges = relations(spark, [(x, 100, "part_of") for x in range(1, 7)])
    assert beliefs.clusters(sims, m, edges, now(), 0.65, f"file://{tmp_path}/r").count() == 0
    assert beliefs.clusters(sims, m, relations(spark, []), now(), 0.65, f"file://{tmp_path}/r", most=1).select("seed").distinct().count() == 1


def test_merge_and_cleanup(spark, tmp_path):
    m = memories(spark, [(1, "a", "decision", "p", 10), (2, "a", "decision", "q", 5), (3, "a", "decision", None, 0)])
    sims = pairs(spark, [(1, 2, 0.97), (2, 3, 0.97)])
    got = beliefs.merged(sims, m, 0.95, f"file://{tmp_path}/a").collect()
    assert {(r["winner"], r["loser"]) for r in got} == {(3, 1), (3, 2)}
    one = beliefs.cleanup(pairs(spark, [(1, 2, 0.99)]), m, 0.93, {"q": "p"}, f"file://{tmp_path}/b").collect()
    assert [(r["canonical"], r["duplicate"]) for r in one] == [(2, 1)]
    assert beliefs.cleanup(pairs(spark, [(1, 2, 0.99)]), m, 0.93, {}, f"file://{tmp_path}/c").count() == 0


def test_graph(spark, tmp_path):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (50, 51)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(chain, f"file://{tmp_path}").collect()}
    assert all(got[i] == 0 for i in range(41)) and got[51] == 50 and 100 not in got
    empty = graph.components(chain.limit(0), f"file://{tmp_path}/e")
    assert empty.count() == 0
    r = relations(spark, [(1, 2, "part_of"), (2, 3, "part_of"), (3, 4, "part_of"), (2, 2, "part_of")])
    assert {(x["id"], x["depth"]) for x in graph.traverse(r, 1, 2).collect()} == {(1, 0), (2, 1), (3, 2)}
    assert {(x["id"], x["degree"]) for x in graph.degree(r).collect()} == {(1, 1), (2, 3), (3, 2), (4, 1)}
    moved = spark.createDataFrame([(1, 2)], "canonical long, duplicate long")
    assert {(x["source_id"], x["target_id"]) for x in graph.repointed(r, moved).collect()} == {(1, 3), (3, 4)}
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    new = relations(spark, [(1, 2, "part_of"), (2, 1, "part_of"), (2, 1, "part_of"), (1, 9, "part_of")])
    assert [(x["source_id"], x["target_id"]) for x in graph.add_edges(r, new, ids).collect()] == [(2, 1)]


def test_lifecycle(spark):
    new = spark.createDataFrame([("dduowcj roif", "decision", ["t"], None, "manual"), ("được rồi", "decision", ["t"], None, "manual"), ("x", "tool", [], "p", None)], "content string, type string, tags array<string>, project string, meta_source string")
    got = lifecycle.save_batch(new, now()).collect()
    assert len(got) == 2 and {r["status"] for r in got} == {"saved"}
    again = lifecycle.save_batch(new, now(), spark.createDataFrame([(got[0]["id"], "old")], "id string, matched string"))
    assert sorted(r["status"] for r in again.collect()) == ["saved", "skipped_near_duplicate"]
    m = memories(spark, [(1, "a", "decision", "p", 1), (2, "b", "decision", "p", 1)])
    patches = spark.createDataFrame([(1, "new"), (2, None), (7, "x")], "id long, content string")
    assert {r["id"]: r["content"] for r in lifecycle.update_fold(m, patches).collect()} == {1: "new", 2: "b"}
    assert {r["id"]: r["status"] for r in lifecycle.update_status(m, patches).collect()} == {1: "updated", 2: "empty", 7: "not_found"}
    req = relations(spark, [(1, 2, "supersedes"), (2, 1, "supersedes"), (1, 2, "nonsense")]).drop("weight")
    out = {(r["source_id"], r["relation_type"]): (r["status"], r["importance"]) for r in lifecycle.unlink(m, relations(spark, [(1, 2, "supersedes")]), req).collect()}
    assert out == {(1, "supersedes"): ("unlinked", 1.0), (2, "supersedes"): ("not_found", 0.5), (1, "nonsense"): ("invalid_relation_type", 0.5)}
    runs = spark.createDataFrame(list(enumerate([True, False, False, False, True, False])), "seq int, ok boolean")
    assert [r["open"] for r in lifecycle.breaker(runs).orderBy("seq").collect()] == [False, False, False, True, False, False]


def test_event_log(spark):
    log = spark.createDataFrame([(1, 1, "put", "a"), (1, 2, "put", "b"), (2, 1, "put", "c"), (2, 5, "delete", None)], "id long, seq long, op string, value string")
    assert [(r["id"], r["value"]) for r in store.latest(log).collect()] == [(1, "b")]
    good, bad = store.validated(spark.createDataFrame([("1", "x", "tool"), ("2", "x", "odd"), (None, "x", "tool")], "id string, content string, type string"))
    assert good.count() == 1 and bad.count() == 2


def test_judge_and_gates(spark):
    pool = spark.createDataFrame([(0, i + 1, x) for i, x in enumerate([1, 2, 3, 4, 5])], "query_id int, pos int, id long")
    scores = spark.createDataFrame(list(zip([1, 2, 3, 4, 5], [7, 1, 4, 9, 3], strict=True)), "memory_id long, score int")
    assert [r["id"] for r in R.judged(pool, scores, 3).orderBy("judge_pos").collect()] == [4, 1, 3]
    res = spark.createDataFrame([(0, False), (1, False), (1, True), (2, None)], "query_id int, fts_hit boolean")
    assert {r["query_id"] for r in R.noise_gate(res, F.lit("fallback:timeout")).collect()} == {1, 2}
    assert R.noise_gate(res, F.lit("ok")).count() == 4
    lines = spark.createDataFrame([(0, 1, "aaaa"), (0, 2, "bbbbbbb"), (0, 3, "c")], "query_id int, pos int, line string")
    assert [r["pos"] for r in R.within_budget(lines, 8, F.length("line")).collect()] == [1]


def test_extraction(spark):
    text = "First part. We decided to use B. Then more."
    far = "y" * 400 + " and so the bug fix " + "w " * 300
    rows = [(1, text), (2, None), (3, "nothing"), (4, "  indented TODO: write\nmore"), (5, far), (6, "Root cause: a leak! Done")]
    got = {r["line"]: r for g in ("technical", "action") for r in extract.signals(spark.createDataFrame(rows, "line int, text string"), g).collect()}
    assert {k: (r["kind"], r["context"], r["keyword"]) for k, r in got.items() if k != 5} == {1: ("decision", "We decided to use B.", "decided"), 4: ("action", "indented TODO: write", "TODO:"), 6: ("technical", "Root cause: a leak!", "Root cause:")}
    assert got[1]["match_text"] == text
    assert got[5]["context"].startswith("…yyy") and got[5]["context"].endswith("…") and len(got[5]["context"]) <= 201 and " and so the bug fix w" in got[5]["match_text"]
    cut = spark.createDataFrame([("one two three four,  five",), ("unbroken" * 4,), ("short ",), (None,)], "t string")
    assert [r["x"] for r in cut.select(extract.shortened(F.col("t"), 20).alias("x")).collect()] == ["one two three four…", "unbrokenunbrokenunbr…", "short", None]
    begin = spark.createDataFrame([("One line.  Two\nlines",), ("v1.2 is out! Yes.",), ("no end of it here at all",), ("",)], "t string")
    assert [r["x"] for r in begin.select(extract.opening(F.col("t"), 12).alias("x")).collect()] == ["One line.", "v1.2 is out!", "no end of…", ""]
    c = spark.createDataFrame([("s", 5, "we decided on kafka brokers"), ("s", 50, "zookeeper removal plan")], "session string, line int, match_text string")
    saves = spark.createDataFrame([("s", 60, "zookeeper")], "session string, line int, content string")
    assert [r["line"] for r in extract.unsaved(c, saves).collect()] == [5]
    vtt = ["WEBVTT", "00:01 --> 00:02", "hello", "hello<00:00:01><c> world</c>", "[Music]", "plain repeat", "next<00:00:02>"]
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(vtt)], "file string, line int, text string")
    assert [r["text"] for r in extract.captions(lines).orderBy("line").collect()] == ["hello world", "[Music]", "next"]
    e = extract.entities(spark.createDataFrame([(1, "see ~/Projects/Atlas/x and `/ship` then /research with sqlite")], "id int, text string"), {"atlas": []}, ["research", "ship"], ["sqlite"])
    assert {(r["name"], r["category"]) for r in e.collect()} == {("atlas", "project"), ("/research", "skill"), ("sqlite", "technology")}
    parts = spark.createDataFrame([("s", 1, "One", ["a", "b"]), ("s", 2, "Two", ["c" * 100]), ("s", 3, "Empty", [])], "session string, rank int, title string, items array<string>")
    assert extract.snapshot(parts, limit=40).first()["snapshot"] == "## One\n- a\n- b"


def test_markers(spark):
    """Who replaces whom: by phrase, place and the ids that exist."""
    own, a, b, c = "c" * 12, "a" * 12, "b" * 12, "dead00000001"
    cases = [
        (f"[SUPERSEDED 2026-05-29 — see migration memory {a}] old stuff", ("p1a", "passive", a, own, "high")),
        (f"DECISION (2026-06-12, supersedes {b}): now we bundle", ("p1a", "active", own, b, "high")),
        (f"CORRECTION to {b}: the real weights are different", ("p1a", "active", own, b, "high")),
        (f"[SUPERSEDED — see {a} and also {b} for context]", ("p1a", "passive", None, own, "review")),
        ("[SUPERSEDED 2026-05-30 — current: 0 gold] model", ("p1b", "passive", None, own, "pending")),
        ("[SUPERSEDED — see deadbeef1234] gone", ("p1b", "passive", None, own, "pending")),
        (f"just a normal decision about {a}", None),
        (None, None),
        ("CORRECTION to the plan", ("p1b", "active", None, None, "review")),
        ("RETIRED idea", ("p1b", "passive", None, own, "pending")),
        (f"RETIRED idea, replaced by {b}, not {a}", ("p1a", "passive", b, own, "high")),
        (f"RETIRED idea of {b}", ("p1a", "passive", None, own, "review")),
        (f"now corrected; see {own} and {a}", ("p1a", "passive", None, own, "review")),
        (f"it reverses a lot. It supersedes {own}, then {c}, {b}", ("p1a", "active", own, c, "high")),
        ("OBSOLETE, RETIRED. " + "x" * 200 + f" replaced by {a}", ("p1a", "passive", a, own, "high")),
    ]
    for text, want in cases:
        m = spark.createDataFrame([(own, text), *((i, "plain") for i in (a, b, c))], "id string, content string")
        got = [tuple(r)[1:] for r in extract.markers(m).collect()]
        assert got == ([want] if want else []), text


def test_registry_and_status(spark):
    p = spark.createDataFrame([("a", "/a", "primary"), ("b", "/b", "primary")], "name string, path string, status string")
    f = spark.createDataFrame([("/a",), ("/c",)], "path string")
    assert {(r["fault"], r["name"]) for r in sessions.registry_audit(p, f).collect()} == {("stale_path", "b"), ("unregistered", "/c"), ("primary_count", "2")}
    s = spark.createDataFrame([("x", dt.date(2024, 1, 1)), ("y", dt.date(2024, 1, 9))], "project string, updated date")
    c = spark.createDataFrame([("x", "src/a", dt.date(2024, 1, 5)), ("y", "docs/b", dt.date(2024, 2, 1))], "project string, path string, date date")
    assert {(r["project"], r["stale"]) for r in sessions.freshness(s, c, ["docs/"]).collect()} == {("x", True), ("y", False)}


def test_hashed_embedding(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "id long, t string")
    got = {r["id"]: r["embedding"] for r in hashed_embedding(df, "t", 16).collect()}
    assert sum(got[1]) == 3.0 and sum(got[2]) == 0.0 and sum(got[3]) == 0.0


def test_pairs_carry_no_contents(spark, sf):
    """Series are told by marks made once a memory: no condition on a pair reads two contents."""
    p, m = pairs(spark, [(0, 7, 0.95), (1, 8, 0.95)]), store.memories(spark, sf)
    plan = beliefs.conflict_pairs(p, m, store.relations(spark, sf), 0.3, 0.985)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan and not any("RLIKE" in x and ("Join" in x or "Filter" in x) for x in plan.splitlines())


def test_cleanup_carries_no_contents(spark, sf, tmp_path, monkeypatch):
    """The edges that label cleanup hands to the components come from pairs without contents."""
    seen = []
    monkeypatch.setattr(beliefs, "components", lambda e, folder: seen.append(e._jdf.queryExecution().optimizedPlan().toString()) or e.select(F.col("a").alias("node"), F.col("a").alias("component")))
    beliefs.cleanup(pairs(spark, [(0, 7, 0.95)]), store.memories(spark, sf), 0.33, {"src1": "src2"}, f"file://{tmp_path}/c")
    assert "RLIKE" in seen[0] and not any("RLIKE" in x and ("Join" in x or "Filter" in x) for x in seen[0].splitlines())


def test_similar_pairs_send_no_more_copies_as_they_grow(spark, monkeypatch):
    """Over tiles of several groups and pieces, exact with zero, equal and 64-bit vectors; a vector is sent GROUPS times at most."""
    import numpy as np

    from mnemora.operators import vectors

    rng = np.random.default_rng(1)
    m = np.r_[rng.normal(size=(150, 6)).astype(np.float32).astype(float), rng.normal(size=(60, 6)), np.zeros((2, 6)), np.ones((5, 6)) / 3]
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)] + [(900, None)], "memory_id long, embedding array<double>")
    size = np.linalg.norm(m, axis=1)
    sim = np.round(np.divide(m @ m.T, np.outer(size, size), out=np.zeros((len(m),) * 2), where=np.outer(size, size) > 0), 6)
    want = sorted((i, j) for i in range(len(m)) for j in range(i + 1, len(m)) if 0.4 <= sim[i, j] <= 0.999)
    found = vectors.similar_pairs(v, 0.4, 0.999, block=7)
    got = {(r["a"], r["b"]): r["sim"] for r in found.collect()}
    assert sorted(got) == want and all(abs(sim[k] - x) < 2e-6 for k, x in got.items())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "explode" not in plan.lower()  # blocks are not paired before they are sent
    assert vectors.similar_pairs(v.limit(0), 0.4).count() == 0


def test_links_have_the_components_of_all_pairs(spark, tmp_path):
    """Under each kind of rule, with nulls, over one group and several; rows are bounded by the vectors, not by the pairs."""
    import numpy as np

    from mnemora.operators import vectors

    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3).tolist(), "dst"[i % 3], None if i % 4 == 0 else f"p{i % 5}", "x" if i % 6 == 0 else None) for i in range(60)]
    v = spark.createDataFrame(rows, "memory_id long, embedding array<double>, type string, project string, mark string").cache()
    side = lambda s: v.select(F.col("memory_id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("type", "project", "mark")])
    ok = (F.col("type_a") == F.col("type_b")) & R.compatible(F.col("project_a"), F.col("project_b")) & (F.col("mark_a").isNull() | F.col("mark_b").isNull())
    for n, (low, block) in enumerate([(0.97, 7), (0.9, 100), (0.3, 7)]):
        every = vectors.similar_pairs(v, low, block=block).join(side("a"), "a").join(side("b"), "b").filter(ok)
        few = vectors.linking_pairs(v, low, facts=v, same=["type"], agree=["project"], apart=["mark"], block=block)
        got, want = (sorted(map(tuple, graph.components(e.select("a", "b"), f"file://{tmp_path}/{n}{k}").collect())) for k, e in enumerate((few, every)))
        assert got == want and got
        plain = vectors.linking_pairs(v, low, block=block)
        assert plain.count() <= 59 * (9 if block == 7 else 1) and vectors.similar_pairs(v, low, block=block).count() >= len(got) // 2
