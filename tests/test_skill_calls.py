"""Skills that tool calls read."""

import json
import posixpath

import pytest
from pyspark.sql import functions as F

from loglattice.operators import skills

PATHS = ["/a/./b//../c/SKILL.md", "a/../../b", "~/x/../y/./SKILL.md", "file:///a/b", "C:\\x\\y", "//a/b", "///a", "/..", "..", "", ".", "a/..", "~/", "  /a  "]


def normal(path):
    text = path.strip().removeprefix("file://").replace("\\", "/")
    return "~/" + posixpath.normpath(text[2:]) if text.startswith("~/") else posixpath.normpath(text)


def test_paths_are_normalised(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "p string").select("p", skills.normal_path(F.col("p")).alias("n"))
    assert {r["p"]: r["n"] for r in df.collect()} == {p: normal(p) for p in PATHS}


NAMES = {
    "/home/u/.claude/skills/pdf/SKILL.md": "pdf", "/h/.codex/skills/.system/make/SKILL.md": "make", "/p/plugins/x/skills/$tool/SKILL.md": "tool", "skills/any/SKILL.md": "any", "/x/myskills/any/SKILL.md": None,
    "/x/skills/a b/SKILL.md": None, "/x/skills/{a}/SKILL.md": None, "/x/skills/pdf/SKILL.md.bak": None, "/x/skills/ns:pdf/skill.md": "ns:pdf", "/x/skills/" + "n" * 129 + "/SKILL.md": None, "/x/skills/.system/SKILL.md": None,
}


def test_names_in_paths(spark):
    df = spark.createDataFrame([(p,) for p in NAMES], "p string").select("p", skills.name_in_path(F.col("p")).alias("n"))
    assert {r["p"]: r["n"] for r in df.collect()} == NAMES


P = "/r/.claude/skills/pdf/SKILL.md"
COMMANDS = {
    f"cat {P}": [P], f"PAGER=cat LESS= /usr/bin/less '{P}'": [P], f"cd /x && head -5 {P}; echo": [P], f"sed -n 1,5p {P}": [P], f"sed -e s/a/b/ {P}": [], f"sed -i s/a/b/ {P}": [], f"cat {P} > /tmp/x": [], f"cat {P} | grep x": [P],
    f"grep x {P}": [], f"rm {P}": [], f"cat a; rm {P}": [], f"cat \"{P}": [P], f"\"cat\" {P}": [P], f"echo {P}": [], f"bat -n {P} {P}": [P, P], f"A=1 B=2 {P}": [], "cat README.md": [], f"CAT {P}": [P], f"cat {P} || tail {P}": [P, P], f"cat\\ x {P}": [],
}


def test_commands_that_only_read(spark):
    df = spark.createDataFrame([(c,) for c in COMMANDS], "c string").select("c", skills.paths_in_command(F.col("c")).alias("p"))
    assert {r["c"]: r["p"] or [] for r in df.collect()} == COMMANDS


CALLS = [
    ("Skill", {"skill": " /ns:pdf ", "path": "p"}, ("ns:pdf", "p", "skill_tool")), ("Skill", "$make", ("make", None, "skill_tool")), ("skill", {"skill": 5}, None), ("Read", {"file_path": P}, ("pdf", P, "file_read")), ("Read", P, ("pdf", P, "file_read")),
    ("Read", {"path": "/x/README.md"}, None), ("Read", {"path": "/own/SKILL.md"}, ("listed", "/own/SKILL.md", "file_read")), ("Bash", {"command": f"cat /nope/SKILL.md {P}"}, ("pdf", P, "file_read")), ("Bash", {"command": f"rm {P}"}, None),
    ("Bash", {"command": "cat /own/../own/SKILL.md"}, ("listed", "/own/SKILL.md", "file_read")), ("Edit", {"path": P}, None), ("Grep", {"path": P}, None), ("Read", None, None), ("Unknown", {"path": P}, None),
]


@pytest.mark.parametrize("session", ["s", None])
def test_uses_of_calls(spark, session):
    rows = [(session, k, f"c{k}", tool, json.dumps(value)) for k, (tool, value, _) in enumerate(CALLS)] + [(session, 99, "c", "Read", "{broken"), (session, 98, "c", None, None)]
    calls = spark.createDataFrame(rows, "session string, seq long, call_id string, tool string, input string")
    catalog = spark.createDataFrame([(session, "/own/SKILL.md", "listed"), ("other", P, "wrong")], "session string, path string, name string")
    got = {r["seq"]: (r["name"], r["path"], r["detection"]) for r in skills.uses_of_calls(calls, catalog).collect()}
    assert got == {k: want for k, (*_, want) in enumerate(CALLS) if want}
    assert skills.uses_of_calls(calls.limit(0)).count() == 0
