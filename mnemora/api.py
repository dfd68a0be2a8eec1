"""The memory store's public operations over an append-only event log.

Every write is one commit: its memories, edges, vectors and postings are named
by one manifest, so readers see all of them or none.  The state is the log's
latest fold, and the full-text index is changed for the rows written only.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.deploy import ship
from mnemora.functions import telex
from mnemora.operators import beliefs, fts, graph, lifecycle, sessions
from mnemora.operators import recall as R
from mnemora.operators.textindex import TextIndex
from mnemora.scorers import hashed_embedding, reversal_classifier
from mnemora.sources.commits import Commit, CommitLog, latest_by

EVENTS = "seq bigint, op string, id string, content string, type string, tags array<string>, project string, meta_source string, created_at timestamp, access_count bigint, last_accessed timestamp, importance double"
EDGES = "seq bigint, op string, source_id string, target_id string, relation_type string, weight double"
SESSIONS = "seq bigint, op string, id string, project string, started_at timestamp, summary string, ended_at timestamp"
VECTORS = "seq bigint, op string, memory_id string, embedding array<double>"
NEW = "content string, type string, tags array<string>, project string, meta_source string"
TABLES = {"memories": (EVENTS, ["id"]), "relations": (EDGES, ["source_id", "target_id", "relation_type"]), "vectors": (VECTORS, ["memory_id"]), "sessions": (SESSIONS, ["id"])}
#: Commits in force from which a write folds them into one.
COMPACT_FROM = 30


class MemoryStore:
    """A store in a folder that all executors share.

    ``embed`` adds ``embedding array<double>`` to a frame with ``id`` and a
    text column; the default is the offline hashed bag of words.  The current
    time is an argument of every operation that needs it.
    """

    def __init__(self, spark: SparkSession, folder: str, embed=hashed_embedding):
        ship(spark)
        self.spark, self.folder, self.embed = spark, folder.rstrip("/"), embed
        self.log = CommitLog(spark, self.folder)
        self.index = TextIndex(self.log)

    def _state(self, table: str) -> DataFrame:
        """A table's latest rows; deleted keys are gone."""
        schema, key = TABLES[table]
        return latest_by(self.log.read(table, schema).drop("commit"), key).filter("op <> 'delete'").drop("seq", "op")

    def _add(self, c: Commit, table: str, *batches: tuple[str, DataFrame]) -> None:
        """Write batches (op, rows) of one table into a commit; a key is in one of them at most."""
        fields = [f.split() for f in TABLES[table][0].split(", ")]
        out = None
        for op, rows in batches:
            rows = rows.withColumns({"seq": F.lit(c.number).cast("long"), "op": F.lit(op)})
            rows = rows.select(*[(F.col(x) if x in rows.columns else F.lit(None)).cast(kind).alias(x) for x, kind in fields])
            out = rows if out is None else out.unionByName(rows)
        c.add(table, out.coalesce(1))  # one request's rows

    def _held(self, rows: DataFrame) -> DataFrame:
        """One request's rows, worked out once, before anything is written."""
        return self.spark.createDataFrame(rows.collect(), rows.schema)

    def _after(self) -> None:
        if len(self.log.manifests()) >= COMPACT_FROM:
            self.compact()

    def compact(self) -> int:
        """Fold all commits in force into one."""
        state = {t: (schema, (), lambda rows, key=key: latest_by(rows.drop("commit"), key)) for t, (schema, key) in TABLES.items()}
        return self.log.compact(state | self.index.folds())

    @property
    def memories(self) -> DataFrame:
        return self._state("memories")

    @property
    def relations(self) -> DataFrame:
        return self._state("relations")

    @property
    def vectors(self) -> DataFrame:
        return self._state("vectors")

    def _texts(self, rows: DataFrame) -> DataFrame:
        return rows.select("id", fts.indexed_text().alias("text"))

    def _embedded(self, rows: DataFrame) -> DataFrame:
        """The vectors of contents (id, content); equal contents are embedded once."""
        texts = rows.select("id", "content").groupBy("content").agg(F.min("id").alias("id"))
        vectors = self.embed(texts, "content").select("content", "embedding")
        return rows.select(F.col("id").alias("memory_id"), "content").join(vectors, "content").drop("content")

    def _queries(self, query: str) -> DataFrame:
        q = self.spark.createDataFrame([(0, telex.repair(query))], "id long, query string")
        return self.embed(q, "query").select(F.col("id").alias("query_id"), "query", F.col("embedding").alias("vec"))

    def save(self, rows: list[tuple], now: dt.datetime, near_duplicate: float = 0.92, relations: list[tuple[str, str]] = (), revise: tuple[float, float] | None = None, classify=reversal_classifier) -> DataFrame:
        """Save rows (content, type, tags, project, source) in one commit: (id, status, matched).

        A row close to a stored one of its type and a compatible project is
        skipped, and so is one close to an earlier row of the batch that is
        saved, as if they were saved one by one.  ``relations`` are (target,
        type) edges from each saved row; superseded targets lose half of their
        importance.  With ``revise``, a band of similarity, each saved row's
        closest stored neighbour in it is classified, and an edge tells of a
        sure revision.
        """
        at = F.lit(now).cast("timestamp")
        given = self.spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"n long, {NEW}")
        new = self._held(lifecycle.save_batch(given, at).drop("status", "matched"))
        probes = self._held(self.embed(new.select("n", "id", "content", "type", "project"), "content").drop("content"))
        known = self.memories.select(F.col("id").alias("matched"), F.col("type").alias("known_type"), F.col("project").alias("known_project"))
        near = R.knn(self.vectors, probes.select(F.col("id").alias("query_id"), F.col("embedding").alias("vec")), 6).select(F.col("query_id").alias("id"), F.col("id").alias("matched"), "sim")
        near = near.join(known, "matched").join(new.select("id", "type", "project"), "id").filter((F.col("type") == F.col("known_type")) & R.compatible(F.col("project"), F.col("known_project")))
        near = self._held(near.select("id", "matched", "sim"))
        best = near.filter(F.col("sim") >= near_duplicate).groupBy("id").agg(F.max_by("matched", F.struct("sim", "matched")).alias("matched"))
        if len(rows) > 1:
            best = best.unionByName(beliefs.batch_duplicates(probes.join(best, "id", "left_anti"), near_duplicate, f"{self.folder}/rounds"))
        out = self._held(new.join(best, "id", "left").withColumn("status", F.when(F.col("matched").isNull(), "saved").otherwise("skipped_near_duplicate")))
        saved = out.filter("status = 'saved'").drop("n", "status", "matched")
        edges = self.spark.createDataFrame([(r["id"], t, k, 1.0) for r in saved.select("id").collect() for t, k in relations], "source_id string, target_id string, relation_type string, weight double")
        if revise:
            sibling = near.filter(F.col("sim").between(*revise)).groupBy("id").agg(F.max_by("matched", F.struct("sim", "matched")).alias("older"))
            sibling = sibling.join(self.memories.select(F.col("id").alias("older"), F.col("content").alias("before")), "older").join(saved.select("id", "content"), "id")
            told = sibling.select("id", "older", classify(F.col("content"), F.col("before")).alias("c")).filter(F.col("c.verdict").isin("supersedes", "contradicts") & (F.col("c.confidence") >= 0.85))
            edges = edges.unionByName(told.select(F.col("id").alias("source_id"), F.col("older").alias("target_id"), F.col("c.verdict").alias("relation_type"), F.col("c.confidence").alias("weight")))
        if not saved.isEmpty():
            stored = self.memories
            edges = self._held(graph.add_edges(self.relations, edges, stored.select("id").unionByName(saved.select("id"))))
            lower = self._held(self._demoted(stored, edges))
            again = self._held(self._texts(stored.join(saved.select("id"), "id", "left_semi")))
            vectors = self._held(self._embedded(saved))
            with self.log.commit() as c:
                self._add(c, "memories", ("put", saved), ("put", lower.join(saved.select("id"), "id", "left_anti")))
                self._add(c, "vectors", ("put", vectors))
                self._add(c, "relations", ("put", edges))
                self.index.write(c, self._texts(saved), again)
            self._after()
        return out.select("id", "status", "matched")

    def _demoted(self, stored: DataFrame, edges: DataFrame) -> DataFrame:
        return stored.drop("importance").join(lifecycle.demoted(stored, edges), "id").select(*stored.columns)

    def link(self, edges: DataFrame) -> None:
        """Add edges (source_id, target_id, relation_type, weight) whose ends exist and that are new."""
        new = self._held(graph.add_edges(self.relations, edges, self.memories))
        lower = self._held(self._demoted(self.memories, new))
        with self.log.commit() as c:
            self._add(c, "relations", ("put", new))
            self._add(c, "memories", ("put", lower))
        self._after()

    def recall(self, query: str, k: int = 5, project: str | None = None, kind: str | None = None, since: dt.datetime | None = None, now: dt.datetime | None = None) -> DataFrame:
        """The k best memories; with ``now`` their access is recorded."""
        at = F.lit(since).cast("timestamp") if since else None
        found = R.recall(self.memories, self.vectors, self.relations, self._queries(query), k, kind=kind, project=project, since=at, index=self.index)
        out = found.join(self.memories.select("id", "content", "project", "tags", "importance"), "id").orderBy("pos")
        if now is not None:
            out = self._held(out)
            hit = self.memories.join(F.broadcast(out.select("id")), "id", "left_semi").withColumns({"access_count": F.col("access_count") + 1, "last_accessed": F.lit(now).cast("timestamp")})
            hit = self._held(hit)
            with self.log.commit() as c:
                self._add(c, "memories", ("put", hit))
            self._after()
        return out

    def update(self, memory_id: str, **patch) -> str:
        """Change the fields given; ``updated``, ``empty`` or ``not_found``.

        A change of content, tags or project indexes this memory again, and a
        change of content embeds it again, in the same commit.
        """
        kinds = {f.split()[0]: f.split()[1] for f in EVENTS.split(", ")}
        fields = [k for k in patch if k in kinds]
        row = self.spark.createDataFrame([(memory_id, *[patch[k] for k in fields])], ", ".join(["id string", *[f"{k} {kinds[k]}" for k in fields]]))
        status = lifecycle.update_status(self.memories, row).first()["status"] if fields else "empty"
        if status == "updated":
            before = self._held(self.memories.filter(F.col("id") == memory_id))
            rows = self._held(lifecycle.update_fold(before, row))
            with self.log.commit() as c:
                self._add(c, "memories", ("put", rows))
                if {"content", "tags", "project"} & set(fields):
                    self.index.write(c, self._texts(rows), self._texts(before))
                if "content" in fields:
                    self._add(c, "vectors", ("put", self._embedded(rows)))
            self._after()
        return status

    def forget(self, memory_id: str) -> str:
        """Delete a memory with its edges, vector and postings; ``deleted`` or ``not_found``."""
        before = self._held(self.memories.filter(F.col("id") == memory_id))
        if before.isEmpty():
            return "not_found"
        gone = self._held(self.relations.filter((F.col("source_id") == memory_id) | (F.col("target_id") == memory_id)))
        with self.log.commit() as c:
            self._add(c, "relations", ("delete", gone))
            self._add(c, "memories", ("delete", before))
            self._add(c, "vectors", ("delete", before.select(F.col("id").alias("memory_id"))))
            self.index.write(c, None, self._texts(before))
        self._after()
        return "deleted"

    def unlink(self, source: str, target: str, relation_type: str, restore: bool = True) -> str:
        """Remove an edge; a superseded target gets its importance back."""
        req = self.spark.createDataFrame([(source, target, relation_type)], "source_id string, target_id string, relation_type string")
        got = lifecycle.unlink(self.memories, self.relations, req, restore).first()
        if got["status"] == "unlinked":
            with self.log.commit() as c:
                self._add(c, "relations", ("delete", req))
            if relation_type == "supersedes" and restore:
                self.update(target, importance=got["importance"])
        return got["status"]

    def find_tools(self, query: str, k: int = 3, project: str | None = None, floor: float = 0.35) -> DataFrame:
        return R.find_tools(self.memories, self.vectors, self._queries(query), project, floor, k)

    def session(self, action: str, now: dt.datetime, project: str | None = None, summary: str | None = None, session_id: str | None = None, **learned: list[str]) -> DataFrame:
        """``start`` gives the context, ``save`` ends a session, ``status`` counts, ``consolidate`` lists the weekly digests due.

        ``save`` takes a summary and lists of decisions, discoveries and
        entities, which become memories; a session without an id is new, and
        one without a project inherits that of the last.
        """
        at = F.lit(now).cast("timestamp")
        log = self._state("sessions")
        if action == "save":
            lists = [learned.get(c) for c in sessions.LEARNED]
            kinds = ", ".join(f"{c} array<string>" for c in sessions.LEARNED)
            asked = self.spark.createDataFrame([(session_id or f"{now:%Y%m%d%H%M%S}", project, summary, *lists)], f"id string, project string, summary string, {kinds}")
            ended, made = sessions.saved(asked, log, at)
            ended = self.spark.createDataFrame(ended.collect(), ended.schema)  # one row
            items = [(r["content"], r["type"], [], None, r["meta_source"]) for r in made.orderBy("n").collect()]
            with self.log.commit() as c:
                self._add(c, "sessions", ("put", ended.select("id", "project", F.lit(now).cast("timestamp").alias("started_at"), "summary", "ended_at")))
            if items:
                self.save(items, now)
            return ended
        if action == "start":
            return sessions.start(self.memories, log, at, project)
        if action == "status":
            return sessions.counts(self.memories, log, at)
        if action == "consolidate":
            return lifecycle.weekly_digest(log, at)
        raise ValueError(f"unknown action {action!r}")

    def traverse(self, entity: str, depth: int = 2) -> DataFrame:
        """Memories around an entity, by id or else the best text match."""
        root = entity
        if self.memories.filter(F.col("id") == entity).isEmpty():
            best = R.text_leg(self.memories, self._queries(entity), index=self.index).orderBy("fts_pos").first()
            root = best["id"] if best else entity
        return graph.traverse(self.relations, root, depth).join(self.memories.select("id", "content", "type"), "id")
