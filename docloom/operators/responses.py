"""Answers that need no model, forms that fit a request, and citations that may be shown.

Templates, messages and contacts are parameters: texts of their own of who runs this.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import config
from docloom.functions import text as T

#: Hosts that only lead on to others, and what stands for a form not there.
REDIRECT_HOSTS = ["vertexaisearch.cloud.google.com", "www.google.com/url"]
MOST_FORMS, NO_FORM, OWN_FORM, FORM_NAME = 3, "NONE", "don_chung", "Mẫu đơn theo yêu cầu"


def picked(templates: list[str], key: Column) -> Column:
    """One of the templates, which the key's hash decides: alike in every run."""
    at = F.pmod(F.xxhash64(key), F.lit(len(templates)))
    return F.element_at(F.array(*map(F.lit, templates)), (at + 1).cast("int"))


def instant(action: Column, intent: Column, key: Column, greet: list[str], clarify: list[str], refusals: dict[str, str], refusal: str, contact: str) -> Column:
    """Struct (response, source) of a greeting, a question back or a refusal (that of the
    intent, else the general one), with the contact below; null for other actions."""
    below = lambda c, between: F.concat(c, F.lit(between + contact))
    own = F.coalesce(*[F.when(intent == k, v.strip()) for k, v in refusals.items()], F.lit(refusal.strip()))
    answer = lambda c, source: F.struct(c.alias("response"), F.lit(source).alias("source"))
    return (
        F.when(action == "GREET", answer(below(picked(greet, key), "\n---\n"), "greet_template"))
        .when(action == "CLARIFY", answer(below(picked(clarify, key), "\n---\n"), "clarify_template"))
        .when(action == "BLOCK_FALLBACK", answer(below(own, "\n"), "intent_block"))
    )


def blocked(query: Column, messages: dict[int, str], contact: str) -> Column:
    """Struct (passed, layer, normalized, response, source) of the fast scan: a query that
    a layer of the guard stops gets that layer's message (0 too long, 1 banned words, 2
    injection) with the contact below. Of one too long 200 characters are kept. Both word
    filters are layer 1 to the outside."""
    found = T.guard(query)
    message = F.coalesce(*[F.when(found["layer"] == k, m) for k, m in messages.items()])
    stopped = ~found["safe"]
    return F.struct(
        found["safe"].alias("passed"), F.when(stopped, F.least(found["layer"], F.lit(1))).alias("layer"),
        F.when(found["layer"] == 0, T.lower(F.left(query, F.lit(200)))).otherwise(T.normalize_teencode(query)).alias("normalized"),
        F.when(stopped, F.concat(message, F.lit("\n" + contact))).alias("response"), F.when(stopped, "fast_scan").alias("source"),
    )


def shown(citations: Column, domains: list[str] | None = None) -> Column:
    """The citations (array of structs with url) that name a URL, lead to no redirecting
    host and, if domains are given, stand on one of them or below."""
    keep = lambda c: (F.coalesce(c["url"], F.lit("")) != "") & ~c["url"].rlike("|".join(h.replace(".", r"\.") for h in REDIRECT_HOSTS))
    return F.filter(citations, (lambda c: keep(c) & T.allowed_host(c["url"], domains)) if domains else keep)


def form_titles(files: DataFrame) -> DataFrame:
    """filename, title of form templates (source, text): the title of the frontmatter, else
    the name without its ending."""
    block = F.when(F.startswith("text", F.lit("---")) & (F.size(F.split("text", "---", 3)) == 3), F.get(F.split("text", "---", 3), F.lit(1)))
    said = F.regexp_extract(block, r"(?m)^title:[ \t]*(.*?)[ \t]*$", 1)
    bare = F.regexp_replace(F.regexp_replace(said, r"^([\x22'])(.*)\1$", "$2"), r"\\\x22", "\"")
    return files.select(F.col("source").alias("filename"), F.coalesce(F.nullif(bare, F.lit("")), F.replace("source", F.lit(".md"), F.lit(""))).alias("title"))


def selected_forms(answers: DataFrame, templates: DataFrame) -> DataFrame:
    """request_id, position, id, name, template_file: up to three forms that a model's
    answer (request_id, raw) names, by their titles in templates (form_titles). A form that
    isn't among them, and an answer that can't be read or names none, gives one to be
    written freely, with no file."""
    inner = F.regexp_replace(F.regexp_replace(F.trim("raw"), r"\A```[^\n]*\n", ""), r"(?s)```.*\z", "")
    read = F.from_json(inner, "forms array<struct<filename:string,description:string>>")["forms"]
    none = F.array(F.struct(F.lit(NO_FORM).alias("filename"), F.lit(FORM_NAME).alias("description")))
    forms = F.when(F.size(F.coalesce(read, F.array().cast("array<struct<filename:string,description:string>>"))) > 0, F.slice(read, 1, MOST_FORMS)).otherwise(none)
    each = answers.select("request_id", F.posexplode(forms).alias("at", "f")).select("request_id", (F.col("at") + 1).alias("position"), F.coalesce("f.filename", F.lit(NO_FORM)).alias("filename"), F.coalesce("f.description", F.lit(FORM_NAME)).alias("description"))
    known = templates.groupBy("filename").agg(F.min("title").alias("title"))
    met = each.join(known, "filename", "left")
    there = F.col("title").isNotNull()
    return met.select("request_id", "position", F.when(there, F.replace("filename", F.lit(".md"), F.lit(""))).otherwise(OWN_FORM).alias("id"), F.coalesce("title", "description").alias("name"), F.when(there, F.col("filename")).alias("template_file"))


def last_turns(messages: DataFrame, most: int = config.API_HISTORY) -> DataFrame:
    """The last `most` messages of each conversation, as a client is given them."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("_back", F.row_number().over(w)).filter(F.col("_back") <= most).drop("_back")
