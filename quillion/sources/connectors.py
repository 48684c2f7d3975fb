"""Connector payloads as events, source code as nodes and edges, and texts as documents with their entities.

Payloads are JSON texts, one a row, as files that a poller or a webhook drops; so a batch and a
stream of them read alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillion.functions import text
from quillion.operators import entities

# Where each service's public payloads hold an event's content, author, thread and link.
PATHS = {
    "github": ("$.title|$.body", "$.user.login", "$.repository.full_name", "$.html_url"),
    "slack": ("$.text", "$.user", "$.channel", "$.ts"),
    "discord": ("$.content", "$.author.username", "$.channel_id", "$.id"),
    "telegram": ("$.message.text", "$.message.from.username", "$.message.chat.id", "$.message.message_id"),
    "twitter": ("$.text", "$.author_id", "$.conversation_id", "$.id"),
    "notion": ("$.title|$.plain_text", "$.last_edited_by.id", "$.parent.database_id", "$.url"),
    "webhook": ("$.content|$.text|$.message", "$.peer_id", "$.session_id", "$.source"),
}


def events(payloads: DataFrame, kind: str, workspace_id: str, json_col: str = "value") -> DataFrame:
    """Connector events of a service's payloads: (content, workspace_id, summary, memory_type, peer_id, session_id, metadata).

    Content is what the payload's text fields hold, a line each; payloads without any, and
    texts that aren't JSON, give no event. The summary is the content's first 120 characters.
    """
    body, author, thread, link = PATHS[kind]
    at = lambda path: F.get_json_object(json_col, path)
    content = F.concat_ws("\n", *[F.nullif(F.trim(at(p)), F.lit("")) for p in body.split("|")])
    rows = payloads.select(content.alias("content"), at(author).alias("peer_id"), at(thread).alias("session_id"), at(link).alias("link"))
    metadata = F.to_json(F.struct(F.lit(kind).alias("source"), F.col("link").alias("link")))
    return rows.where("content <> ''").select(
        "content", F.lit(workspace_id).alias("workspace_id"), F.substring("content", 1, 120).alias("summary"), F.lit(kind).alias("memory_type"), "peer_id", "session_id", metadata.alias("metadata")
    )


# By file ending, what starts a definition and an import. Group 1 is the name.
CODE = {
    "py": (r"(?m)^\s*(?:async\s+)?(?:def|class)\s+(\w+)", r"(?m)^\s*(?:from|import)\s+([\w.]+)"),
    "js": (r"(?m)^\s*(?:export\s+)?(?:async\s+)?(?:function|class)\s+(\w+)", r"(?m)(?:from|require\()\s*['\"]([^'\"]+)['\"]"),
    "java": (r"(?m)^\s*(?:public\s+|private\s+|protected\s+|abstract\s+|final\s+|static\s+)*(?:class|interface|enum|record)\s+(\w+)", r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)\s*;"),
    "go": (r"(?m)^(?:func\s+(?:\([^)]*\)\s*)?|type\s+)(\w+)", r"(?m)^\s*(?:import\s+)?\"([\w./-]+)\"\s*$"),
    "rs": (r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:fn|struct|enum|trait)\s+(\w+)", r"(?m)^\s*use\s+([\w:]+)"),
}
ENDINGS = {"ts": "js", "tsx": "js", "jsx": "js", "mjs": "js", "pyi": "py"}


# Patterns of a language's strings and comments, for one pass from left to right: what begins first counts, so a comment's
# mark in a string is none, and the other way about.
_SHORT = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|\'[^\'\\\n]*+(?:\\.[^\'\\\n]*+)*+\''
_SLASHES = r"//[^\n]*|/\*(?s:.*?)\*/"
TRAPS = {
    "py": r'(?s:""".*?"""|\'\'\'.*?\'\'\')|' + _SHORT + r"|#[^\n]*",
    "js": r"`[^`\\]*+(?:\\(?s:.)[^`\\]*+)*+`|" + _SHORT + "|" + _SLASHES,
    "java": r'(?s:""".*?""")|' + _SHORT + "|" + _SLASHES,
    "go": r"`[^`]*`|" + _SHORT + "|" + _SLASHES,
    "rs": r'r#"(?s:.*?)"#|"[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+"|\'(?:\\.[^\']*|[^\'\\\n])\'|//[^\n]*|/\*(?s:(?:(?!/\*|\*/).|/\*.*?\*/)*?)\*/',
}
#: Strings that an import consists of; they are kept.
IMPORTED = {"js": r"(?:\bfrom|\brequire\(|\bimport)\s*(?:\"[^\"\n]*\"|'[^'\n]*')", "go": r'(?m:^[ \t]*(?:import[ \t]+)?(?:[\w.]+[ \t]+)?"[^"\n]*"[ \t]*$)'}


def lexed(language: Column, code: Column) -> Column:
    """Code without its strings and comments, but with the strings that name imports."""
    out = code
    for name, traps in TRAPS.items():
        kept = IMPORTED.get(name)
        bare = F.regexp_replace(code, f"({kept})|{traps}", "$1 ") if kept else F.regexp_replace(code, traps, " ")
        out = F.when(language == name, bare).otherwise(out)
    return out


def code_graph(files: DataFrame, path_col: str = "path", text_col: str = "content") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of source files (path, content): a node for each file and definition, `defines` and `imports` edges.

    nodes: (id, node_type, label); edges: (source_node_id, target_node_id, relation). What strings
    and comments say defines and imports nothing. An import goes to the file whose path ends
    with it, the first of several; one without such a file keeps its name. Files of other
    endings are nodes without edges.
    """
    ending = F.lower(F.regexp_extract(path_col, r"\.(\w+)$", 1))
    language = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ENDINGS.items() for x in kv]), ending), ending)
    rows = files.select(F.col(path_col).alias("path"), language.alias("language"), lexed(language, F.col(text_col)).alias("code"))
    found = lambda which: F.array_distinct(_by_language(F.col("language"), "code", which))
    rows = rows.select("path", "language", found(0).alias("defined"), found(1).alias("used"))
    # An inner explode would filter by the list's size first, and find it twice.
    defined = rows.select("path", F.explode_outer("defined").alias("name")).where("name is not null")
    nodes = rows.select(F.col("path").alias("id"), F.lit("file").alias("node_type"), F.regexp_extract("path", r"([^/]+)$", 1).alias("label"))
    nodes = nodes.union(defined.select(F.concat_ws("#", "path", "name"), F.lit("code"), "name"))
    edges = defined.select(F.col("path").alias("source_node_id"), F.concat_ws("#", "path", "name").alias("target_node_id"), F.lit("defines").alias("relation"))
    used = rows.select("path", "language", F.explode_outer("used").alias("name")).where("name is not null")
    # Paths are dealt out before their endings are sorted, so that a task that reads many of them doesn't sort them all.
    dealt = files.select(F.col(path_col).alias("file"), language.alias("file_language")).repartition("file")
    parts = F.split(F.regexp_replace("file", r"\.\w+$", ""), "/")
    endings = dealt.select("file", "file_language", parts.alias("p"))
    endings = endings.select("file", "file_language", F.explode_outer(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", i, F.size("p")), "/"))).alias("key"))
    known = endings.groupBy("file_language", "key").agg(F.min("file").alias("file"))
    asked = used.withColumn("key", import_key(F.col("language"), F.col("path"), F.col("name")))
    # A side of a row an ending isn't broadcast. Imports are only sent where they are read, and made distinct after they are dealt out.
    resolved = asked.join(known.hint("merge"), (F.col("language") == F.col("file_language")) & (asked["key"] == known["key"]), "left")
    resolved = resolved.select("path", F.coalesce("file", "name").alias("target"), F.lit("imports").alias("relation"))
    return nodes, edges.union(resolved.repartition("path", "target").distinct())


def import_key(language: Column, path: Column, name: Column) -> Column:
    """The end of the path, without its ending, that an import names; relative ones are taken from the importing file's folder."""
    folder = F.split(F.regexp_replace(path, r"/?[^/]*$", ""), "/")
    up = lambda at, step: F.when(step == "..", F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))).when(step == ".", at).otherwise(F.concat(at, F.array(step)))
    relative = F.array_join(F.filter(F.aggregate(F.split(F.regexp_replace(name, r"\.(?:[jt]sx?|mjs)$", ""), "/"), folder, up), lambda x: x != ""), "/")
    dotted = F.translate(name, ".", "/")
    return F.when(language.isin("py", "java"), dotted).when(language == "rs", F.regexp_replace(name, "::", "/")).when(name.startswith("."), relative).otherwise(name)


def _by_language(language: Column, text_col: str, which: int) -> Column:
    out = F.array().cast("array<string>")
    for name, patterns in CODE.items():
        out = F.when(language == name, F.regexp_extract_all(text_col, F.lit(patterns[which]), F.lit(1))).otherwise(out)
    return out


def source_pages(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, entity pages) of texts (id, content): pages are (name, type, document_ids) of what the texts name."""
    documents = texts.select("id", F.substring_index("content", "\n", 1).alias("title"), "content")
    chunks = texts.select(F.col("id").alias("document_id"), F.posexplode(text.document_chunks(F.col("content"))).alias("chunk_index", "content"))
    named = entities.mentions(texts).select("name", "type", F.col("id").alias("document_id")).distinct()
    return documents, chunks, named.groupBy("name", "type").agg(F.count("*").alias("documents"), F.min("document_id").alias("first_document_id"))
