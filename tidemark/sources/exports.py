"""Readers of chat exports, workspaces, markdown and event buffers, and the markdown writer."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a zip's entry, and of all its entries, at most.
ENTRY_BYTES, ZIP_BYTES = 25 << 20, 100 << 20
LIST_SCHEMA = "array<struct<uuid:string,name:string,created_at:string,updated_at:string,chat_messages:array<struct<uuid:string,text:string,sender:string,created_at:string>>>>"
TREE_SCHEMA = "array<struct<title:string,create_time:double,update_time:double,current_node:string,mapping:map<string,struct<parent:string,message:struct<author:struct<role:string>,create_time:double,content:struct<content_type:string,parts:array<string>>>>>>>"
EVENT_SCHEMA = "timestamp timestamp, session_id string, project_id string, tool_name string, tool_input_hash string, tool_output_summary string, exit_status int, schema_version int, _corrupt_record string"


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", schema)).alias("c")).select("c.*")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def _iso(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _label(sender: Column) -> Column:
    low = F.lower(sender)
    return F.when(low.isin("human", "assistant"), F.initcap(low)).when(F.coalesce(sender, F.lit("")) == "", "Unknown").otherwise(F.concat(F.upper(F.substring(sender, 1, 1)), F.substr(sender, F.lit(2))))


def read_list_export(spark: SparkSession, path: str) -> DataFrame:
    """Conversations with a list of messages: one record each, `# name` and a block for each message. A missing or bad date is an error."""
    c = _documents(spark, path, LIST_SCHEMA).where(F.size("chat_messages") > 0)
    date = lambda x, what: F.when(x.isNull() | (x == ""), F.raise_error(F.concat(F.lit(f"missing {what} of "), F.coalesce("uuid", F.lit("?"))))).otherwise(F.to_timestamp(x))
    head = lambda m: F.concat(F.lit("\n**"), _label(m["sender"]), F.lit("**"), F.when(F.coalesce(m["created_at"], F.lit("")) != "", F.concat(F.lit(" ("), _iso(F.to_timestamp(m["created_at"])), F.lit(")"))).otherwise(""), F.lit(":\n"))
    body = F.transform("chat_messages", lambda m: F.concat(head(m), _strip(F.coalesce(m["text"], F.lit(""))), F.lit("\n")))
    content = F.concat(F.lit("# "), _strip(F.coalesce("name", F.lit(""))), F.lit("\n"), F.array_join(body, ""))
    return c.select(F.col("uuid").alias("source_id"), content.alias("content"), date(F.col("created_at"), "created_at").alias("created_at"), date(F.col("updated_at"), "updated_at").alias("updated_at"), F.lit("context").alias("memory_type"), F.lit(2).alias("importance"), F.lit("document").alias("storage_mode"))


def _branch(mapping: dict, node: str | None) -> list[tuple[str, float | None, str]]:
    """(role, time, text) from the root to a node; a circle ends the walk."""
    seen, out = set(), []
    while node in mapping and node not in seen:
        seen.add(node)
        entry = mapping[node]
        m = entry["message"]
        role = m and m["author"] and m["author"]["role"]
        if role and role != "system":
            content = m["content"]
            text = "\n".join(content["parts"] or []) if content and content["content_type"] == "text" else f"[{content['content_type'] if content else 'no content'}]"
            if text.strip():
                out.append((role, m["create_time"], text.strip()))
        node = entry["parent"]
    return out[::-1]


def read_tree_export(spark: SparkSession, path: str) -> DataFrame:
    """Conversations kept as trees: the branch that ends at the current node, without system turns."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for title, created, updated, mapping, node in zip(part["title"], part["create_time"], part["update_time"], part["mapping"], part["current_node"], strict=True):
                turns = _branch(dict(mapping), node)
                if turns:
                    rows.append((title, f"# {(title or '').strip()}\n" + "".join(f"\n**{r.capitalize()}**:\n{t}\n" for r, _, t in turns), created, updated))
            yield pd.DataFrame(rows, columns=["title", "content", "created", "updated"])

    c = _documents(spark, path, TREE_SCHEMA).mapInPandas(run, "title string, content string, created double, updated double")
    return c.select("title", "content", F.timestamp_seconds("created").alias("created_at"), F.timestamp_seconds("updated").alias("updated_at"))


def read_workspace(spark: SparkSession, path: str) -> DataFrame:
    """Zip exports of a workspace: messages (channel, ts, user, text, thread_ts) with mentions as names, replies marked `-> `."""

    def unzip(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for data in part["content"]:
                total, names, rows = 0, {}, []
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for info in z.infolist():
                        total += info.file_size
                        if info.file_size > ENTRY_BYTES or total > ZIP_BYTES:
                            raise ValueError(f"{info.filename}: the archive is too large")
                    for info in z.infolist():
                        if info.filename == "users.json":
                            names = {u["id"]: u.get("real_name") or u.get("name") or u["id"] for u in json.loads(z.read(info))}
                    for info in z.infolist():
                        channel, _, file = info.filename.rpartition("/")
                        if channel and file.endswith(".json"):
                            rows += [(channel, m["ts"], names.get(m["user"], m["user"]), m.get("text") or "", m.get("thread_ts"), json.dumps(names)) for m in json.loads(z.read(info)) if m.get("type") == "message" and m.get("user")]
                yield pd.DataFrame(rows, columns=["channel", "ts", "user", "text", "thread_ts", "names"])

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(unzip, "channel string, ts string, user string, text string, thread_ts string, names string")
    name = F.from_json("names", "map<string,string>")
    words = F.transform(F.split("text", r"(?=<@)"), lambda w: F.when(w.rlike(r"^<@\w+>"), F.concat(F.lit("@"), F.coalesce(name[F.regexp_extract(w, r"^<@(\w+)>", 1)], F.regexp_extract(w, r"^<@(\w+)>", 1)), F.regexp_replace(w, r"^<@\w+>", ""))).otherwise(w))
    reply = F.coalesce(F.col("thread_ts") != F.col("ts"), F.lit(False))
    return raw.select("channel", F.col("ts").cast("double").alias("ts"), "user", F.concat(F.when(reply, "-> ").otherwise(""), F.array_join(words, "")).alias("text"), "thread_ts")


def export_format(head: Column) -> Column:
    """What an export is, by the start of its bytes as text: workspace, list, tree or unknown."""
    return F.when(head.startswith("PK\x03\x04"), "workspace").when(F.contains(head, F.lit('"chat_messages"')), "list").when(F.contains(head, F.lit('"mapping"')), "tree").otherwise("unknown")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, heading, body) for each `## ` section, front matter left out."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n", "").alias("text"))
    parts = whole.select("path", F.posexplode(F.split("text", r"(?m)^(?=## )")).alias("pos", "part"))
    body = _strip(F.regexp_replace("part", r"\A## [^\n]*\n?", ""))
    return parts.select("path", "pos", _strip(F.regexp_extract("part", r"\A## ([^\n]*)", 1)).alias("heading"), body.alias("body")).where("body <> '' or heading <> ''")


def write_markdown(records: DataFrame, path: str) -> None:
    """A markdown file for each record, front matter first, in folders by id."""
    text = F.concat(F.lit("---\nid: "), F.col("id").cast("string"), F.lit("\ntype: "), "memory_type", F.lit("\nproject: "), "project", F.lit("\ntags: ["), F.array_join("tags", ", "), F.lit("]\n---\n"), "content")
    records.select("id", text.alias("value")).write.mode("overwrite").partitionBy("id").text(path)


def read_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lines of tool events: (good events, malformed lines)."""
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.from_json("value", EVENT_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("e"))
    bad = F.col("e._corrupt_record").isNotNull() | F.col("e.session_id").isNull()
    return lines.where(~bad).select("e.*").drop("_corrupt_record"), lines.where(bad).select("value")
