"""Query understanding and conversation operators over batches of requests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import config
from docloom.functions import text as T
from docloom.functions.vectors import cosine

#: Spellings of the school's name, masked before metadata is looked for, in order.
SCHOOL_NAMES = [
    "đại học tài chính - marketing", "đại học tài chính marketing", "đh tài chính - marketing", "đh tài chính marketing",
    "tài chính - marketing", "tài chính marketing", "đại học ufm", "đh ufm", "ufm", "trường đại học",
]


def history(messages: DataFrame, turns: int = config.HISTORY_TURNS, chars: int = config.MESSAGE_CHARS) -> DataFrame:
    """The last 2 * turns messages of each conversation, texts cut to `chars`."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = messages.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= 2 * turns)
    return last.withColumn("text", T.truncated(F.col("text"), chars))


def transcript(messages: DataFrame, turns: int = config.HISTORY_TURNS, summarize: bool = True) -> DataFrame:
    """conv_id, history: the last messages of each conversation, by speaker. A message of
    over SUMMARY_TRIGGER characters is replaced by its summary, cut to SUMMARY_CHARS, where
    messages has a column summary that isn't null, else by its beginning; without
    summarize, long ones are cut to MESSAGE_CHARS. A null role or text counts as empty."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = messages.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= 2 * turns)
    text = F.coalesce("text", F.lit(""))
    said = T.truncated(text, config.MESSAGE_CHARS)
    if summarize:
        cut = F.concat(F.left(text, F.lit(config.SUMMARY_CHARS)), F.lit("..."))
        short = F.coalesce(F.left("summary", F.lit(config.SUMMARY_CHARS)), cut) if "summary" in messages.columns else cut
        said = F.when(F.length(text) > config.SUMMARY_TRIGGER, short).otherwise(said)
    name = F.when(F.col("role") == "user", config.USER_NAME).otherwise(config.OTHER_NAME)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(name, F.lit(": "), said).alias("line")))), lambda m: m["line"])
    return last.groupBy("conv_id").agg(F.array_join(parts, "\n").alias("history"))


def metadata(query: Column) -> Column:
    """Struct (level, program) after the school's own names are masked."""
    masked = reduce(lambda c, s: F.replace(c, F.lit(s), F.lit(" ")), SCHOOL_NAMES, F.lower(query))
    return F.struct(T.first_match(masked, config.LEVELS).alias("program_level"), T.first_match(masked, config.PROGRAMS).alias("program_name"))


def action(intent: Column, query: Column) -> Column:
    """Action of an intent: short queries greet, unknown intents fall back."""
    known = F.create_map(*[F.lit(x) for kv in config.INTENT_ACTIONS.items() for x in kv])
    label = F.upper(F.trim(intent))
    return F.when(F.length(F.trim(query)) < config.MIN_QUERY_CHARS, "GREET").otherwise(F.coalesce(F.try_element_at(known, label), F.lit(config.DEFAULT_ACTION)))


def next_node(safe: Column, act: Column) -> Column:
    return (
        F.when(~safe, "response")
        .when(act.startswith("PROCEED_RAG"), "multi_query")
        .when(act == "PROCEED_FORM", "form")
        .when(act == "PROCEED_CARE", "care")
        .otherwise("response")
    )


def after_rag(act: Column) -> Column:
    return F.when(act.isin("PROCEED_RAG_UFM_SEARCH", "PROCEED_RAG_PR_SEARCH"), "rag_search").otherwise("response")


def request_gate(text: Column) -> Column:
    """What happens to a query by its length alone."""
    n = F.length(text)
    return F.when(n > config.MAX_INPUT_CHARS, "block").when(n >= config.SUMMARIZE_CHARS, "summarize").when(n < config.MIN_QUERY_CHARS, "greet").otherwise("pass")


def cache_lookup(requests: DataFrame, cache: DataFrame, ttl_seconds: int = config.CACHE_TTL_SECONDS, least: float = config.CACHE_SIMILARITY, most: int = config.CACHE_SIZE) -> DataFrame:
    """request_id, entry_id, similarity, hit of the best live entry of the same action.

    A request (request_id, action, asked_at, embedding) finds the last `most` entries
    (entry_id, action, saved_at, embedding) saved until then, as far as they live. Entries
    are numbered in the order they were saved, by a scan that needs no single task; the
    action and the block of `most` numbers are equi-keys, so a request meets two blocks at
    most, however long the history is."""
    from docloom.operators.scan import running

    saved = cache.select(F.lit(0).alias("kind"), F.col("entry_id").cast("string").alias("id"), F.col("saved_at").alias("at"), F.lit(1).cast("long").alias("one"))
    asked = requests.select(F.lit(1).alias("kind"), F.col("request_id").cast("string").alias("id"), F.col("asked_at").alias("at"), F.lit(0).cast("long").alias("one"))
    both = running(saved.unionByName(asked).withColumn("all", F.lit(0)), "all", ["at", "kind", "id"], {"number": "one"})
    entries = cache.withColumn("id", F.col("entry_id").cast("string")).join(both.filter("kind = 0").select("id", "number"), "id").withColumn("block", F.floor(F.col("number") / most))
    asks = requests.withColumn("id", F.col("request_id").cast("string")).join(both.filter("kind = 1").select("id", "number"), "id")
    last = F.floor((F.col("number") - 1) / most)
    asks = asks.withColumn("block", F.explode(F.array(last, last - 1)))
    here = (F.col("c.number") < F.col("r.number")) & (F.col("c.number") >= F.col("r.number") - most) & (F.unix_timestamp("r.asked_at") - F.unix_timestamp("c.saved_at") < ttl_seconds)
    pairs = asks.alias("r").join(entries.alias("c"), (F.col("r.action") == F.col("c.action")) & (F.col("r.block") == F.col("c.block")) & here)
    scored = pairs.select("r.request_id", "c.entry_id", F.round(cosine(F.col("r.embedding"), F.col("c.embedding")), 6).alias("similarity")).filter("similarity > 0")
    best = scored.groupBy("request_id").agg(F.min(F.struct(-F.col("similarity"), "entry_id")).alias("b"))
    return best.select("request_id", F.col("b.entry_id").alias("entry_id"), (-F.col("b.col1")).alias("similarity"), (-F.col("b.col1") >= least).alias("hit"))


def cache_state(saved: DataFrame, most: int = config.CACHE_SIZE) -> DataFrame:
    """What a first-in-first-out cache of `most` entries holds in the end."""
    return saved.filter("n_results > 0").orderBy(F.desc("saved_at"), F.desc("entry_id")).limit(most)


def live(sessions: DataFrame, now: Column, ttl_seconds: int = config.SESSION_TTL_SECONDS) -> DataFrame:
    return sessions.filter(F.unix_timestamp(now) - F.unix_timestamp("ts") < ttl_seconds)


def request_counts(requests: DataFrame, seconds: int = config.RATE_WINDOW_SECONDS, most: int = config.RATE_LIMIT) -> DataFrame:
    """Requests of the same client within the window up to each, and whether they reach
    past the limit. All requests count; the exact limiter, where refused ones don't, is
    in docloom.streaming."""
    w = Window.partitionBy("client").orderBy(F.unix_micros("ts")).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return requests.withColumn("n_window", F.count("*").over(w)).withColumn("over", F.col("n_window") > most)


def session_lookup(puts: DataFrame, gets: DataFrame, ttl_seconds: int = config.SESSION_TTL_SECONDS) -> DataFrame:
    """request_id, document of gets (session_id, ts, request_id): the document of puts
    (session_id, ts, request_id, document) last put before in the session, if it isn't
    older than the TTL, else null. An as-of join in one pass: both sides are one table in
    order of time, so that no get meets all puts of its session. Of rows at one time the
    smaller request_id is first."""
    columns = ("session_id", "ts", "request_id", "document")
    rows = puts.select(*columns).unionByName(gets.withColumn("document", F.lit(None).cast("string")).select(*columns))
    w = Window.partitionBy("session_id").orderBy("ts", "request_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("document").isNotNull(), F.struct("ts", "document")), ignorenulls=True).over(w)
    live_ = F.unix_micros("ts") - F.unix_micros("last.ts") <= ttl_seconds * 1_000_000
    return rows.withColumn("last", last).filter("document is null").select("request_id", F.when(live_, F.col("last.document")).alias("document"))


def recent(messages: DataFrame, most: int = config.API_HISTORY) -> DataFrame:
    """conv_id, turn, history: the last `most` messages before each, as role: text."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-most, -1)
    return messages.select("conv_id", "turn", F.collect_list(F.concat_ws(": ", "role", F.coalesce("text", F.lit("")))).over(w).alias("history"))
