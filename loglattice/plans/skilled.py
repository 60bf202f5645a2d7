"""Queries over skills: clicks, views and purchases of ``events`` are tool calls, signups user messages, a user is a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.operators import filters, skills

#: Tools and inputs that events take in turn; ``{n}`` is the event's number modulo 4.
TEMPLATES = (
    ("Skill", '{{"skill": "/ns:s{n}", "path": "p"}}'), ("Read", '{{"file_path": "/h/.claude/skills/./s{n}/SKILL.md"}}'), ("Bash", '{{"command": "PAGER=cat head -5 \\"/h/.codex/skills/s{n}/SKILL.md\\" | wc"}}'), ("Bash", '{{"command": "rm /h/.codex/skills/s{n}/SKILL.md"}}'),
    ("Bash", '{{"command": "cd x && sed -n 1,5p /h/../g/skills/s{n}/SKILL.md"}}'), ("Read", '{{"path": "/own/{n}/SKILL.md"}}'), ("Edit", '{{"path": "/h/.claude/skills/s{n}/SKILL.md"}}'), ("Bash", '{{"command": "cat /own/9/SKILL.md /h/.pi/agent/skills/.system/s{n}/SKILL.md"}}'),
)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), "event_type", (F.col("event_id") % 4).cast("string").alias("n"))
    at = (F.col("seq") % len(TEMPLATES)).cast("int")
    tool = F.get(F.array(*[F.lit(t) for t, _ in TEMPLATES]), at)
    raw = F.replace(F.get(F.array(*[F.lit(x.replace("{{", "{").replace("}}", "}")) for _, x in TEMPLATES]), at), F.lit("{n}"), F.col("n"))
    return rows.select("session", "seq", F.when(F.col("event_type") == "signup", "user_message").otherwise("tool_call").alias("type"), F.lit(None).cast("string").alias("origin"), F.concat(F.lit("c"), F.col("seq")).alias("call_id"), tool.alias("tool"), raw.alias("input"))


def _uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calls(spark, sf_dir)
    catalog = rows.select("session").distinct().filter("session % 2 = 0").select("session", F.lit("/own/1/SKILL.md").alias("path"), F.lit("mine").alias("name"))
    return skills.uses_of_calls(rows.filter("type = 'tool_call'"), catalog)


def skill_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _uses(spark, sf_dir)


def skill_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds = skills.with_rounds(calls(spark, sf_dir)).select("session", "seq", "round")
    return skills.once_per_round(_uses(spark, sf_dir).join(rounds, ["session", "seq"]))


def skill_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skills.summary(skill_rounds(spark, sf_dir))


def skills_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of a skill that a user named (every third is taken as such), and the others, counted by name."""
    uses = _uses(spark, sf_dir).withColumn("trigger", F.when(F.col("seq") % 3 == 0, "explicit").when(F.col("seq") % 3 == 1, "auto"))
    parts = [filters.select_skills(uses, t).groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumn("asked", F.lit(t)) for t in ("explicit", "passive", "all")]
    return parts[0].union(parts[1]).union(parts[2])


QUERIES = {f.__name__: f for f in (skill_uses, skill_rounds, skill_totals, skills_selected)}

_USES = """
e AS (SELECT user_id AS session, event_id AS seq, event_type = 'signup' AS um, event_id % 8 AS t, CAST(event_id % 4 AS VARCHAR) AS n FROM events),
u AS (SELECT session, seq, CASE t WHEN 0 THEN 'ns:s' || n WHEN 5 THEN 'mine' ELSE 's' || n END AS name,
             CASE t WHEN 0 THEN 'p' WHEN 1 THEN '/h/.claude/skills/s' || n || '/SKILL.md' WHEN 2 THEN '/h/.codex/skills/s' || n || '/SKILL.md' WHEN 4 THEN '/g/skills/s' || n || '/SKILL.md' WHEN 5 THEN '/own/' || n || '/SKILL.md' ELSE '/h/.pi/agent/skills/.system/s' || n || '/SKILL.md' END AS path, t = 0 AS nat
      FROM e WHERE NOT um AND (t IN (0, 1, 2, 4, 7) OR t = 5 AND n = '1' AND session % 2 = 0))"""
_ROUNDS = f"""{_USES},
r AS (SELECT session, seq, sum(um::INT) OVER (PARTITION BY session ORDER BY seq) AS round FROM e),
o AS (SELECT u.session, CAST(round AS BIGINT) AS round, min(seq) AS seq, arg_min(name, seq) AS name, replace(name, 'ns:', '') AS bare, 'auto' AS trigger, CASE WHEN bool_or(nat) THEN 'native' ELSE 'inferred' END AS origin FROM u JOIN r USING (session, seq) GROUP BY u.session, round, bare)"""

ORACLES = {
    "skill_uses": f"WITH {_USES} SELECT session, seq, 'c' || seq AS call_id, name, path, 'auto' AS trigger, CASE WHEN nat THEN 'skill_tool' ELSE 'file_read' END AS detection, CASE WHEN nat THEN 'native' ELSE 'inferred' END AS origin FROM u",
    "skill_rounds": f"WITH {_ROUNDS} SELECT * FROM o",
    "skill_totals": f"WITH {_ROUNDS} SELECT bare, count(*) AS total, 0::BIGINT AS n_explicit, count(*) AS n_passive, count(DISTINCT session) AS n_sessions, max(seq) AS last_seq FROM o GROUP BY bare",
    "skills_selected": f"""WITH {_USES}, x AS (SELECT name, seq % 3 = 0 AS ex FROM u) SELECT name, count(*) AS n, 'explicit' AS asked FROM x WHERE ex GROUP BY name
        UNION ALL SELECT name, count(*), 'passive' FROM x WHERE NOT ex GROUP BY name UNION ALL SELECT name, count(*), 'all' FROM x GROUP BY name""",
}
