import datetime as dt

from mnemora.api import MemoryStore

NOW = dt.datetime(2024, 1, 31)


def test_life_of_a_store(spark, tmp_path):
    s = MemoryStore(spark, f"file://{tmp_path}/store")
    assert s.memories.count() == 0 and s.recall("anything").count() == 0
    got = {r["status"]: r["id"] for r in s.save([("dduowcj kafka brokers run the pipeline", "decision", ["x"], "atlas", "manual"), ("weekly report tool", "tool", [], None, None)], NOW).collect()}
    assert set(got) == {"saved"} and s.memories.count() == 2
    again = s.save([("được kafka brokers run the pipeline", "decision", [], "atlas", None)], NOW).first()
    assert again["status"] == "skipped_near_duplicate"
    old = s.recall("kafka brokers", k=3, project="atlas", now=NOW).collect()
    assert old[0]["content"].startswith("được kafka") and old[0]["fts_hit"] and old[0]["vec_hit"]
    kafka = old[0]["id"]
    assert s.memories.filter(f"id = '{kafka}'").first()["access_count"] == 1
    new = s.save([("pulsar clusters replace everything we had", "decision", [], "atlas", "manual")], NOW, relations=[(kafka, "supersedes")]).first()["id"]
    assert abs(s.memories.filter(f"id = '{kafka}'").first()["importance"] - 0.45) < 1e-9
    assert kafka not in {r["id"] for r in s.recall("kafka brokers", project="atlas").collect()}
    assert {r["id"] for r in s.traverse(new).collect()} == {new, kafka}
    assert s.unlink(new, kafka, "supersedes") == "unlinked" and s.unlink(new, kafka, "supersedes") == "not_found"
    assert abs(s.memories.filter(f"id = '{kafka}'").first()["importance"] - 0.9) < 1e-9
    assert [s.update(kafka, project="other"), s.update(kafka), s.update("nope", project="x")] == ["updated", "empty", "not_found"]
    assert s.find_tools("weekly report", floor=0.1).count() == 1
    s.session("save", NOW, "atlas", "did things")
    assert s.session("start", NOW, "atlas").count() >= 1 and s.session("status", NOW).first()["sessions"] == 1 and s.session("consolidate", NOW).count() == 0
    assert [s.forget(kafka), s.forget(kafka)] == ["deleted", "not_found"] and s.memories.count() == 2


def test_revisions_and_sessions(spark, tmp_path):
    s = MemoryStore(spark, f"file://{tmp_path}/store")
    old = s.save([("the cache runs on redis with four nodes in the east zone", "decision", [], "atlas", None)], NOW).first()["id"]
    new = s.save([("the cache no longer runs on redis with four nodes in the east zone", "decision", [], "atlas", None)], NOW, near_duplicate=0.99, revise=(0.6, 0.98)).first()["id"]
    assert [(r["source_id"], r["target_id"], r["relation_type"]) for r in s.relations.collect()] == [(new, old, "supersedes")]
    first = s.session("save", NOW, "atlas", "did things", "s1", decisions=["we chose the second plan"], entities=["atlas", "redis", "kafka"]).first()
    assert (first["project"], first["memories"], first["known"], first["cluster"]) == ("atlas", 4, False, True)
    again = s.session("save", NOW + dt.timedelta(hours=1), None, "more", "s1", discoveries=["it holds"]).first()
    assert (again["project"], again["known"], again["cluster"]) == ("atlas", True, False)
    heir = s.session("save", NOW + dt.timedelta(hours=2), None, "other").first()
    assert heir["project"] == "atlas" and s.memories.filter("meta_source = 'wrap'").count() == 5
    assert s.vectors.count() == s.memories.count() == 7
