"""Sources: transcripts, prompt files, tool descriptions, captions and registries, read through Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions import text as T

EVENT = "session string, prompt string, tool_name string, tool_input string, tool_result string, tool_response string, last_assistant_message string, cwd string, transcript_path string, ts timestamp"


def transcript(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSONL transcripts as blocks (file, line, role, block, kind, text, name, input); malformed lines are left out.

    A message's content is a string or an array of blocks, so it is parsed as
    a variant; only user and assistant lines stay.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    v = raw.withColumn("v", F.try_parse_json("value")).filter("v is not null")
    get = lambda c, p: F.try_variant_get(c, p, "string")
    v = v.withColumn("role", F.coalesce(get("v", "$.message.role"), get("v", "$.type"))).filter("role in ('user', 'assistant')")
    plain = v.select("file", "line", "role", F.lit(0).alias("block"), F.lit("text").alias("kind"), get("v", "$.message.content").alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("input")).filter(F.schema_of_variant(F.try_variant_get("v", "$.message.content", "variant")) == "STRING")
    blocks = v.select("file", "line", "role", F.posexplode(F.try_variant_get("v", "$.message.content", "array<variant>")).alias("block", "b"))
    parts = blocks.select("file", "line", "role", "block", get("b", "$.type").alias("kind"), F.coalesce(get("b", "$.text"), get("b", "$.content")).alias("text"), get("b", "$.name").alias("name"), get("b", "$.input").alias("input"))
    return plain.unionByName(parts)


def prompts(spark: SparkSession, path: str, modified_after: str | None = None) -> DataFrame:
    """Plain prompts (file, line, prompt) of transcripts changed since a time; wrappers and interruptions are left out."""
    raw = spark.read.text(path, wholetext=True, modifiedAfter=modified_after).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    v = raw.withColumn("v", F.try_parse_json("value")).filter("v is not null").filter(F.try_variant_get("v", "$.type", "string") == "user")
    v = v.filter(F.schema_of_variant(F.try_variant_get("v", "$.message.content", "variant")) == "STRING")
    p = v.select("file", "line", F.try_variant_get("v", "$.message.content", "string").alias("prompt"))
    return p.filter(~F.col("prompt").startswith("<") & ~F.col("prompt").startswith("[Request"))


def hook_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Hook events of JSON files, as a batch or a stream; an old field's name stands in for the new one's."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(EVENT).json(path).withColumn("result", F.coalesce("tool_result", "tool_response"))


def skills(spark: SparkSession, path: str) -> DataFrame:
    """Tool descriptions (path, name, description, body): front matter with a folded or single line, and the body's beginning.

    Folders that hold snapshots or workspaces are left out.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    raw = raw.filter(~F.col("path").rlike("skill-snapshot|workspace"))
    head = F.regexp_extract("value", r"(?s)^---\s*\n(.*?)\n---", 1)
    folded = F.trim(F.regexp_replace(F.regexp_extract(head, r"(?m)^description:\s*[>|][-+]?\s*\n((?:[ \t]+.*(?:\n|$))+)", 1), r"\s+", " "))
    single = F.trim(F.regexp_extract(head, r"(?m)^description:[ \t]*([^>|\n].*)$", 1))
    body = F.trim(F.regexp_replace("value", r"(?s)^---\s*\n.*?\n---\s*", ""))
    return raw.select("path", F.trim(F.regexp_extract(head, r"(?m)^name:\s*(.+)$", 1)).alias("name"), F.when(folded != "", folded).otherwise(single).alias("description"), T.clip(body, 300).alias("body"))


def caption_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines (file, line, text) of caption files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))


def best_track(tracks: DataFrame, languages: list[str]) -> DataFrame:
    """Each video's caption track (video, language, path) by language priority, then any English one."""
    rank = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("language"))
    place = F.when(rank > 0, rank).when(F.col("language").startswith("en"), len(languages) + 1)
    return tracks.withColumn("place", place).filter("place is not null").groupBy("video").agg(F.min_by("path", F.struct("place", "language", "path")).alias("path"))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """A project registry's rows (name, path, type, summary, status)."""
    raw = spark.read.text(path, wholetext=True)
    kind = "projects map<string, struct<path:string, type:string, summary:string, status:string>>"
    return raw.select(F.explode(F.from_json("value", f"struct<{kind.replace(' map', ':map')}>")["projects"]).alias("name", "p")).select("name", "p.*")


def register(known: DataFrame, new: DataFrame) -> DataFrame:
    """Registry rows to append: those whose name is not there."""
    return new.join(known, "name", "left_anti")


def server_scopes(global_: DataFrame, inline: DataFrame, files: DataFrame) -> DataFrame:
    """(server, scope): global before a project's inline entry before its file."""
    rows = None
    for place, df in enumerate((global_, inline, files)):
        part = df.select("server", "scope", F.lit(place).alias("place"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("server").agg(F.min_by("scope", F.struct("place", "scope")).alias("scope"))


def plugin_tools(plugins: DataFrame, enabled: DataFrame) -> DataFrame:
    """Tools (plugin, tool, project) of plugins (plugin, tools array) for the projects (plugin, project) that enable them; a null project is everywhere."""
    return plugins.select("plugin", F.explode("tools").alias("tool")).join(enabled, "plugin")
