"""Skill use: names, paths, calls that read a skill, rounds and summaries.

Defined results: null names, paths, commands and inputs name no skill; repeated rows
are uses of their own until :func:`once_per_round`; a null session is a session; an
empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.functions.guards import stripped
from loglattice.functions.text import tool_kind
from loglattice.operators.ordered import meet, running_sum

# Where skills live, what reads a file, what a command that reads must not hold, and the fields of inputs.
ROOTS = (
    ".codex", ".claude", ".pi", ".pi/agent", ".agents", ".cursor", ".config/agentsync", ".config/opencode", ".opencode",
    ".gemini/config", ".gemini/antigravity-cli", ".gemini", ".kimi-code",
)
PLUGIN = "plugins/[^/\\s\"'<>]+"
SKILL_FILE = "skills/(?:\\.system/)?([^/\\s\"'<>]+)/SKILL\\.md(?:\\z|[\\s\"'<>])"
TOKEN = "([^\\s\"'<>`|;&()]+/SKILL\\.md)"
SEPARATOR = r"\s*(?:&&|\|\||;|\|)\s*"
READERS = ("cat", "head", "tail", "less", "more", "bat", "nl")
OTHER_COMMANDS = (
    "tee", "rm", "mv", "cp", "chmod", "chown", "touch", "truncate", "ln", "mkdir", "rmdir", "rg", "grep", "egrep", "fgrep", "ag", "fd", "find", "ls", "tree", "wc", "stat", "file", "diff", "git",
    "python", "python3", "node", "ruby", "perl", "awk",
)
PATH_FIELDS = ("path", "file_path", "filePath", "Path", "TargetFile", "target_file", "absolute_path", "filename")
COMMAND_FIELDS = ("cmd", "command", "script")
NAME_FIELDS = ("skill", "name", "id", "command")
LONGEST_NAME = 128

_WORD = r"(?:[^\s\"'\\]|\\.|\"(?:[^\"\\]|\\.)*\"|'[^']*')+"


def raw_name(name: Column) -> Column:
    """Without a leading ``/``, ``$`` or ``@``, its namespace kept; null if nothing is left."""
    return F.nullif(stripped(F.regexp_replace(stripped(name), r"^(?:[/$@]\s*)+", "")), F.lit(""))


def normal_path(path: Column) -> Column:
    """A path or file URI with forward slashes, without ``.``, ``..`` and doubled slashes."""
    text = F.regexp_replace(F.regexp_replace(stripped(path), "^file://", ""), r"\\", "/")
    home, absolute = F.startswith(text, F.lit("~/")), F.startswith(text, F.lit("/"))
    head = F.when(home, "~/").when(absolute, F.when(F.startswith(text, F.lit("//")) & ~F.startswith(text, F.lit("///")), "//").otherwise("/")).otherwise("")
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    back = lambda acc: F.when((F.size(acc) > 0) & (last(acc) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1)).when(absolute, acc).otherwise(F.concat(acc, F.array(F.lit(".."))))
    step = lambda acc, part: F.when(part.isin("", "."), acc).when(part == "..", back(acc)).otherwise(F.concat(acc, F.array(part)))
    parts = F.aggregate(F.split(F.when(home, F.substring(text, 3, 1 << 30)).otherwise(text), "/"), F.array().cast("array<string>"), step)
    joined = F.array_join(parts, "/")
    return F.concat(head, F.when((joined == "") & ~absolute, ".").otherwise(joined))


def name_in_path(path: Column) -> Column:
    """The skill that a normal path of its file names; null if it names none."""
    places = "|".join([*(r.replace(".", r"\.") for r in ROOTS), PLUGIN])
    known, any_root = (F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")) for pattern in (rf"(?i)(?:^|/)(?:{places})/{SKILL_FILE}", rf"(?i)(?:^|/){SKILL_FILE}"))
    name = raw_name(F.coalesce(known, any_root))
    good = ~name.isin(".", "..", ".system", "SKILL.md") & ~name.rlike(r"[<>{}*?$`]") & (F.length(name) <= LONGEST_NAME)
    return F.when(good, name)


def _words(segment: Column) -> Column:
    """The words of a command, quotes taken off; where quotes don't close, what white space parts."""
    whole = segment.rlike(rf"\A\s*(?:{_WORD}\s*)*\z")
    clean = lambda w: F.regexp_replace(F.regexp_replace(w, "[\"']", ""), r"\\(.)", "$1")
    return F.when(whole, F.transform(F.regexp_extract_all(segment, F.lit(_WORD), F.lit(0)), clean)).otherwise(F.split(F.trim(segment), r"\s+"))


def _reads(segment: Column) -> Column:
    """Whether a command only reads files: settings before it are skipped; ``sed`` has to print only."""
    writes = segment.rlike(rf"(?i)(?:>>?|<<|\b(?:{'|'.join(OTHER_COMMANDS)})\b|sed\s+-[^a-zA-Z]*i)")
    words = _words(segment)
    starts = F.array_position(F.transform(words, lambda w: ~F.contains(w, F.lit("=")) | F.startswith(w, F.lit("-"))), True)
    command = F.lower(F.element_at(F.split(F.get(words, (starts - 1).cast("int")), "/"), -1))
    prints = F.exists(F.slice(words, (starts + 1).cast("int"), F.size(words)), lambda w: F.startswith(w, F.lit("-n")))
    return F.coalesce(F.contains(segment, F.lit("SKILL.md")) & ~writes & (command.isin(*READERS) | ((command == "sed") & prints)), F.lit(False))


def paths_in_command(command: Column) -> Column:
    """Paths of skill files in the parts of a command line that only read."""
    some = F.when(F.contains(command, F.lit("SKILL.md")), F.filter(F.split(stripped(command), SEPARATOR), _reads))
    return F.flatten(F.transform(some, lambda part: F.regexp_extract_all(part, F.lit(f"(?i){TOKEN}"), F.lit(1))))


def uses_of_calls(calls: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """``session, seq, call_id, name, path, trigger, detection, origin``: the skill that a tool call invokes or reads.

    ``calls(session, seq, call_id, tool, input)``, the input as JSON; ``catalog(session, path, name)`` are names
    that a session's own list gives to paths, which come before what a path says.  Of a command's paths the
    first that names a skill counts.  Calls that write, search or list name none.
    """
    text = lambda field: F.nullif(stripped(F.when(F.schema_of_variant(F.try_variant_get("v", f"$.{field}", "variant")) == "STRING", F.try_variant_get("v", f"$.{field}", "string"))), F.lit(""))
    plain = F.nullif(stripped(F.when(F.schema_of_variant("v") == "STRING", F.try_variant_get("v", "$", "string"))), F.lit(""))
    one = lambda fields: F.coalesce(plain, *[text(f) for f in fields])
    rows = calls.select("session", "seq", "call_id", tool_kind(F.col("tool")).alias("kind"), F.try_parse_json("input").alias("v")).filter("kind in ('skill', 'read', 'shell')")
    called = rows.filter("kind = 'skill'").select("session", "seq", "call_id", raw_name(one(NAME_FIELDS)).alias("name"), F.coalesce(*[text(f) for f in ("path", "dir", "directory", "location")]).alias("path")).filter("name is not null")
    found = F.when(F.col("kind") == "read", F.array(one(PATH_FIELDS))).otherwise(paths_in_command(one(COMMAND_FIELDS)))
    read = rows.filter("kind <> 'skill'").select("session", "seq", "call_id", F.posexplode(found).alias("k", "raw")).filter(F.contains("raw", F.lit("SKILL.md")))
    read = read.withColumn("path", normal_path(F.col("raw")))
    known = F.lit(None).cast("string")
    if catalog is not None:
        listed = catalog.groupBy("session", "path").agg(F.min("name").alias("listed"))
        for place in ("raw", "path"):
            read = meet(read, listed.withColumnsRenamed({"path": place, "listed": f"by_{place}"}), ["session", place], "left")
        known = F.coalesce("by_raw", "by_path")
    read = read.withColumn("name", F.coalesce(known, name_in_path(F.col("path")))).filter("name is not null")
    first = read.groupBy("session", "seq", "call_id").agg(F.min_by(F.struct("name", "path"), "k").alias("u")).select("session", "seq", "call_id", "u.name", "u.path")
    passive = first.select("*", F.lit("auto").alias("trigger"), F.lit("file_read").alias("detection"), F.lit("inferred").alias("origin"))
    return called.select("*", F.lit("auto").alias("trigger"), F.lit("skill_tool").alias("detection"), F.lit("native").alias("origin")).unionByName(passive)


def bare_name(name: Column) -> Column:
    """Without a leading ``/``, ``$`` or ``@`` and without namespaces (``a:b`` is ``b``)."""
    raw = F.regexp_replace(stripped(name), "^[/$@]+", "")
    return F.nullif(F.element_at(F.split(raw, ":"), -1), F.lit(""))


def with_rounds(events: DataFrame) -> DataFrame:
    """Events with ``round``: user messages that weren't injected open one."""
    opens = F.when((F.col("type") == "user_message") & ~F.coalesce(F.col("origin") == "injected", F.lit(False)), 1).otherwise(0)
    return running_sum(events, ["session"], "seq", opens, "round")


def once_per_round(uses: DataFrame) -> DataFrame:
    """One use of a skill for each round: an explicit one before passive ones, then the earliest.

    ``uses(session, round, seq, name, trigger, origin)``; ``origin`` becomes ``native`` if any member's is.
    """
    named = uses.withColumn("bare", bare_name(F.col("name"))).filter("bare IS NOT NULL")
    order = F.struct(F.when(F.col("trigger") == "explicit", 0).otherwise(1), "seq")
    best = named.groupBy("session", "round", "bare").agg(F.min_by(F.struct("seq", "name", "trigger"), order).alias("u"), F.bool_or(F.col("origin") == "native").alias("native"))
    return best.select("session", "round", "u.seq", "u.name", "bare", "u.trigger", F.when(F.col("native"), "native").otherwise("inferred").alias("origin"))


def summary(uses: DataFrame) -> DataFrame:
    """Uses, sessions and triggers by skill, most used first."""
    sums = uses.groupBy("bare").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("trigger") == "explicit").alias("n_explicit"), F.count_if(F.col("trigger") != "explicit").alias("n_passive"), F.countDistinct("session").alias("n_sessions"), F.max("seq").alias("last_seq"))
    return sums.orderBy(F.desc("total"), "bare")
