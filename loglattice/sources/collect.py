"""Usage observations from native lines, each with an identity that repeated loads agree on.

An observation has ``session, pos, sub`` (its place), what it counts (``scope``,
``counter``), whose it is (``response_id``, ``message_id``, ``turn_id``,
``scope_id``), the models and labels, the token counts and ``observation_id``.
Absent is null, never zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.functions.guards import amount, counter
from loglattice.sources.claude import cleaned, field, parsed

TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens", "total_tokens")
COLUMNS = ("session", "pos", "sub", "record", "field", "scope", "counter", "counter_name", "operation_detail", "scope_id", "response_id", "message_id", "turn_id", "model", "requested_model", "reasoning_level", "service_tier", *TOKENS, "cost", "subdivisions")
_KINDS = {"pos": "long", "sub": "int", "cost": "double", "subdivisions": "map<string,long>"} | dict.fromkeys(TOKENS, "long")


def _tokens(paths: dict[str, str], base: str = "$", of: str = "v") -> dict[str, Column]:
    return {name: counter(F.try_variant_get(of, f"{base}.{path}", "variant")) for name, path in paths.items()}


def _shaped(df: DataFrame) -> DataFrame:
    """All columns of an observation, absent ones as nulls."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(_KINDS.get(c, "string")).alias(c) for c in COLUMNS])


def _nothing(columns: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.col(c) for c in columns]).isNull()


def _subdivisions(parts: dict[str, Column]) -> Column:
    """The breakdowns that are there, by name; null if none is."""
    pairs = F.filter(F.array(*[F.struct(F.lit(name).alias("k"), value.alias("n")) for name, value in parts.items()]), lambda p: p["n"].isNotNull())
    return F.when(F.size(pairs) > 0, F.map_from_entries(pairs))


def with_ids(obs: DataFrame, runtime: str) -> DataFrame:
    """``runtime:session:record:field``; repeats within a session get ``#2``, ``#3`` in the order of their places."""
    base = F.concat_ws(":", F.lit(runtime), "session", "record", "field")
    nth = F.row_number().over(Window.partitionBy("_id").orderBy("pos", "sub"))
    return obs.withColumn("_id", base).withColumn("observation_id", F.when(nth > 1, F.concat("_id", F.lit("#"), nth)).otherwise(F.col("_id"))).drop("_id").withColumn("runtime", F.lit(runtime))


def claude_observations(rows: DataFrame) -> DataFrame:
    """One observation for each message line with usage or a model, and one for each model of a cost-state line.

    A line with labels only is kept with unknown scope, so it never enters a sum.
    The models of one cost-state line come in the order of their names.
    """
    lines = parsed(rows).withColumns({"record": F.concat(F.lit("line:"), "pos"), "kind": field("$.type")})
    usage = F.try_variant_get("v", "$.message.usage", "variant")
    counts = _tokens({"input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_read_tokens": "cache_read_input_tokens", "cache_write_tokens": "cache_creation_input_tokens", "reasoning_tokens": "output_tokens_details.thinking_tokens"}, "$.message.usage")
    parts = _tokens({"cache_creation_1h": "cache_creation.ephemeral_1h_input_tokens", "cache_creation_5m": "cache_creation.ephemeral_5m_input_tokens", "server_tool_web_search_requests": "server_tool_use.web_search_requests", "server_tool_web_fetch_requests": "server_tool_use.web_fetch_requests"}, "$.message.usage")
    model = F.try_variant_get("v", "$.message.model", "variant")
    named = F.coalesce(F.schema_of_variant(model) == "STRING", F.lit(False))
    native = F.when(F.schema_of_variant(F.try_variant_get("v", "$.message.id", "variant")) == "STRING", F.nullif(field("$.message.id"), F.lit("")))
    messages = lines.filter((F.coalesce("kind", F.lit("")) != "cost-state") & F.schema_of_variant(F.try_variant_get("v", "$.message", "variant")).startswith("OBJECT"))
    messages = messages.withColumns({
        **counts, "subdivisions": _subdivisions(parts), "named": named, "model": cleaned("$.message.model"), "requested_model": cleaned("$.requestedModel"),
        "reasoning_level": F.coalesce(cleaned("$.perTurnEffort"), cleaned("$.effort")), "service_tier": F.when(F.schema_of_variant(usage).startswith("OBJECT"), cleaned("$.message.usage.service_tier")), "native": native,
    })
    counted = ~_nothing(tuple(counts)) | F.col("subdivisions").isNotNull() | F.col("named")
    labelled = ~_nothing(("requested_model", "reasoning_level", "service_tier"))
    messages = messages.withColumn("counted", counted).filter(F.col("counted") | labelled)
    messages = messages.withColumns({
        "sub": F.lit(0), "field": F.when(F.col("counted"), "usage").otherwise("attribution"), "scope": F.when(F.col("counted"), "message").otherwise("unknown"),
        "counter": F.when(F.col("counted"), "absolute").otherwise("unknown"), "operation_detail": F.when(~F.col("counted"), "attribution"), "scope_id": F.col("native"), "response_id": F.col("native"), "message_id": F.col("native"),
    })
    states = lines.filter("kind = 'cost-state'").select("session", "pos", "record", F.nullif(field("$.sessionId"), F.lit("")).alias("scope_id"), F.posexplode(F.map_entries(F.from_json(F.to_json(F.try_variant_get("v", "$.modelUsage", "variant")), "map<string,string>"))).alias("sub", "m"))
    states = states.withColumns({"b": F.try_parse_json("m.value"), "model": F.nullif(F.trim("m.key"), F.lit(""))}).filter(F.col("model").isNotNull() & F.schema_of_variant("b").startswith("OBJECT"))
    buckets = _tokens({"input_tokens": "inputTokens", "output_tokens": "outputTokens", "cache_read_tokens": "cacheReadInputTokens", "cache_write_tokens": "cacheCreationInputTokens", "reasoning_tokens": "thinkingTokens"}, of="b")
    tiers = _tokens({"cache_creation_1h": "cacheCreationEphemeral1hInputTokens", "cache_creation_5m": "cacheCreationEphemeral5mInputTokens", "server_tool_web_search_requests": "webSearchRequests"}, of="b")
    states = states.withColumns({
        **buckets, "subdivisions": _subdivisions(tiers), "cost": amount(F.try_variant_get("b", "$.costUSD", "variant")), "field": F.concat(F.lit("modelUsage:"), "model"),
        "scope": F.lit("session"), "counter": F.lit("cumulative"), "counter_name": F.lit("cost_state"), "operation_detail": F.lit("cost_state"),
    }).filter(~_nothing((*buckets, "cost")))
    return with_ids(_shaped(messages).unionByName(_shaped(states)), "claude")


def _turn(path: str) -> Column:
    return F.coalesce(cleaned(f"{path}.turn_id"), cleaned(f"{path}.turnId"))


def codex_observations(rows: DataFrame) -> DataFrame:
    """Every usage-shaped block: of a request, of a turn so far, of a thread so far, and those of notes.

    A block without a model takes the model that the turn's last context asked
    for as ``requested_model``; thread counters take none.
    """
    lines = parsed(rows).withColumns({"record": F.concat(F.lit("line:"), "pos"), "kind": field("$.type"), "own_turn": _turn("$.payload")})
    settings = "$.payload.collaboration_mode.settings"
    asked = F.coalesce(cleaned("$.payload.model"), cleaned(f"{settings}.model"))
    level = F.coalesce(*[cleaned(f"{base}.{name}") for base in ("$.payload", settings) for name in ("effort", "reasoning_effort")])
    contexts = lines.filter(F.col("kind").isin("turn_context", "session_meta", "thread_settings_applied") & F.col("own_turn").isNotNull())
    contexts = contexts.select("session", F.col("own_turn").alias("turn_id"), "pos", asked.alias("asked"), level.alias("level"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c)
    contexts = contexts.groupBy("session", "turn_id").agg(last("asked"), last("level"))

    paths = {"input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_read_tokens": "cached_input_tokens", "cache_write_tokens": "cache_write_input_tokens", "reasoning_tokens": "reasoning_output_tokens", "total_tokens": "total_tokens"}
    record, note = F.col("kind") == "token_usage_record", F.col("kind") == "event_msg"
    kinds = [  # where, whether, scope, counter, name
        ("$.payload.turn_token_usage", record, "turn", "cumulative", "turn_token_usage"), ("$.payload.usage", record, "call", "absolute", "usage"), ("$.payload.thread_token_usage", record, "session", "cumulative", "thread_token_usage"),
        ("$.payload.info.last_token_usage", note, "call", "absolute", "usage"), ("$.payload.info.last_usage", note, "call", "absolute", "usage"),
        ("$.payload.info.total_token_usage", note, "unknown", "cumulative", "turn_token_usage"), ("$.payload.info.total_usage", note, "unknown", "cumulative", "turn_token_usage"),
    ]
    blocks = []
    for path, when, scope, kind, name in kinds:
        block = F.try_variant_get("v", path, "variant")
        there = when & F.schema_of_variant(block).startswith("OBJECT")
        own = name if ".info." not in path else path.rsplit(".", 1)[1]
        blocks.append(F.when(there, F.struct(block.alias("b"), F.lit(scope).alias("scope"), F.lit(kind).alias("counter"), F.lit(name).alias("counter_name"), F.lit(own).alias("field"))))
    spread = lines.filter(record | note).select("session", "pos", "record", "kind", "own_turn", "v", F.posexplode(F.array(*blocks)).alias("sub", "u")).filter("u IS NOT NULL")
    whole = F.col("u.scope") == "session"
    turn = F.when(F.col("kind") == "event_msg", F.coalesce("own_turn", _turn("$.payload.info"))).when(~whole, F.col("own_turn"))
    response = F.when((F.col("kind") == "token_usage_record") & ~whole, cleaned("$.payload.response_id"))
    model = F.when(F.col("kind") == "event_msg", F.coalesce(cleaned("$.payload.info.model"), cleaned("$.payload.model"))).otherwise(cleaned("$.payload.model"))
    spread = spread.withColumns({"b": F.col("u.b"), "turn_id": turn, "response_id": response, "model": model, "thread": F.when(whole, cleaned("$.payload.thread_id")), "effort": F.coalesce(cleaned("$.payload.effort"), cleaned("$.payload.reasoning_effort"))})
    spread = spread.withColumns(_tokens(paths, of="b")).filter(~_nothing((*paths, "model")))
    joined = spread.join(contexts, ["session", "turn_id"], "left")
    fits = (F.col("kind") == "token_usage_record") & F.col("model").isNull()
    joined = joined.withColumns({
        "scope": F.col("u.scope"), "counter": F.col("u.counter"), "counter_name": F.col("u.counter_name"), "field": F.col("u.field"), "scope_id": F.coalesce("thread", "response_id", "turn_id"),
        "requested_model": F.when(fits, F.col("asked")), "reasoning_level": F.coalesce("effort", F.when(F.col("kind") == "token_usage_record", F.col("level"))),
    })
    return with_ids(_shaped(joined), "codex")
