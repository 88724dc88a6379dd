"""Cleaning of search queries and of models' answers, and what becomes of them: column
expressions over batches of requests. The year and all defaults are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import config
from docloom.functions import text as T

#: Which of the school's sites answers which words, in order; and all its sites' root.
DOMAINS = [
    ("tuyển sinh", "tuyensinh.ufm.edu.vn"), ("điểm chuẩn", "tuyensinh.ufm.edu.vn"), ("xét tuyển", "tuyensinh.ufm.edu.vn"), ("chỉ tiêu", "tuyensinh.ufm.edu.vn"),
    ("nguyện vọng", "tuyensinh.ufm.edu.vn"), ("hồ sơ", "tuyensinh.ufm.edu.vn"), ("đào tạo", "pdt.ufm.edu.vn"), ("chương trình", "pdt.ufm.edu.vn"),
    ("học phí", "pdt.ufm.edu.vn"), ("tín chỉ", "pdt.ufm.edu.vn"), ("lịch học", "pdt.ufm.edu.vn"), ("thời khóa biểu", "uis.ufm.edu.vn"),
    ("nhập học", "nhaphoc.ufm.edu.vn"), ("thủ tục", "nhaphoc.ufm.edu.vn"), ("học bổng", "ctsv.ufm.edu.vn"), ("rèn luyện", "ctsv.ufm.edu.vn"), ("ký túc xá", "ktx.ufm.edu.vn"),
]
ROOT_DOMAIN = "ufm.edu.vn"
#: Names of a program beside its own.
ABBREVIATIONS = {
    "tài chính - ngân hàng": "TC-NH, TCNH, tc-nh, tcnh, Tài chính Ngân hàng", "quản trị kinh doanh": "QTKD, qtkd, Quản trị KD", "quản lý kinh tế": "QLKT, qlkt, Quản lý KT",
    "marketing": "MKT, mkt, Marketing", "kinh doanh quốc tế": "KDQT, kdqt, KD Quốc tế", "kế toán": "KT, kt, Kế toán", "toán kinh tế": "TKT, tkt, Toán KT",
    "kinh tế học": "KTH, kth, Kinh tế", "luật kinh tế": "LKT, lkt, Luật KT",
}
#: Sources of answers that need no model.
BYPASS = ["greet_template", "clarify_template", "care_template", "form_template", "intent_block", "fast_scan", "contextual_guard", "keyword_filter", "input_validation"]
#: Fixed limits.
MAX_DOMAINS, MAX_QUERIES, VARIANT_CHARS, HARD_CUT, ANSWER_CHARS, ENOUGH_CHARS, PREVIEW_CHARS, SLUG_CHARS = 3, 2, 5, 1200, 1200, 50, 200, 50

_STRIP = r"(?U)^\s+|\s+\z"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, _STRIP, "")


# -- questions -------------------------------------------------------------------------


def with_year(text: Column, year: int) -> Column:
    """The query, with the last year and this one behind it if it names none of 2020 to 2039."""
    return F.when(text.rlike(r"20[2-3]\d"), text).otherwise(F.concat(text, F.lit(f" năm {year - 1} {year}")))


def domains(query: Column, defaults: list[str], most: int = MAX_DOMAINS) -> Column:
    """Sites that the query's words name, in the table's order, then the root, then the
    defaults as far as there is room."""
    found = F.filter(F.array(*[F.when(F.contains(F.lower(query), F.lit(word)), site) for word, site in DOMAINS]), lambda d: d.isNotNull())
    return F.slice(F.array_distinct(F.concat(found, F.array(F.lit(ROOT_DOMAIN), *map(F.lit, defaults)))), 1, most)


def search_string(terms: Column, sites: Column) -> Column:
    """Terms and the sites that a search is held to."""
    return F.concat_ws(" ", terms, F.array_join(F.transform(sites, lambda d: F.concat(F.lit("site:"), d)), " OR "))


def web_search(action: Column, query: Column, own: Column, press: Column, year: int, sites: list[str] = config.SITES, press_sites: list[str] = config.PRESS_SITES) -> Column:
    """Struct (terms, sites, search) of what an action looks up. A search of the school's
    sites asks for the first MAX_QUERIES of the model's queries `own` (array) joined by |,
    or the query itself without any, on the sites that the query names; any other asks the
    press for the model's query `press`, or the query itself, on the first five sites."""
    school = action == "PROCEED_RAG_UFM_SEARCH"
    asked = F.coalesce(F.nullif(F.array_join(F.slice(own, 1, MAX_QUERIES), " | "), F.lit("")), query)
    terms = with_year(F.when(school, asked).otherwise(F.coalesce(F.nullif(press, F.lit("")), query)), year)
    where = F.when(school, domains(query, sites)).otherwise(F.array(*map(F.lit, press_sites[:5])))
    return F.struct(terms.alias("terms"), where.alias("sites"), search_string(terms, where).alias("search"))


def press_query(raw: Column) -> Column:
    """The query in a model's answer: quotes around it go, double ones first, then a number;
    null if nothing is left."""
    s = raw
    for around in (r"(?U)^\s+|\s+\z", r"^\x22+|\x22+\z", r"^'+|'+\z", r"(?U)^\s+|\s+\z", r"^\d+\.\s*"):
        s = F.regexp_replace(s, around, "")
    return F.nullif(s, F.lit(""))


def variants(raw: Column) -> Column:
    """Questions of a numbered or bulleted list, without marks; short ones drop out."""
    bare = F.transform(F.split(stripped(raw), "\n"), lambda s: F.regexp_replace(stripped(s), r"^\s*\d+[.)\]]\s*", ""))
    clean = F.transform(bare, lambda s: stripped(F.regexp_replace(s, r"^\s*[-•]\s*", "")))
    return F.filter(clean, lambda s: F.length(s) > VARIANT_CHARS)


def search_queries(raw: Column, most: int = MAX_QUERIES) -> Column:
    """The first search queries of a model's answer: hyphens, stars and quotes around a
    line go, in this order, then its number."""

    def bare(s: Column) -> Column:
        for around in (r"(?U)^\s+|\s+\z", r"^-+|-+\z", r"^\*+|\*+\z", r"^\x22+|\x22+\z", r"^'+|'+\z", r"(?U)^\s+|\s+\z", r"^\d+\.\s*"):
            s = F.regexp_replace(s, around, "")
        return s

    return F.slice(F.filter(F.transform(F.split(raw, "\n"), bare), lambda s: s != ""), 1, most)


def shortened(query: Column, summary: Column) -> Column:
    """A long query's summary within the limit; the query's beginning where there is none."""
    s = stripped(summary)
    fits = F.when(F.length(s) >= ANSWER_CHARS, F.concat(F.left(s, F.lit(ANSWER_CHARS - 3)), F.lit("..."))).otherwise(s)
    return F.coalesce(F.nullif(fits, F.lit("")), F.concat(F.left(query, F.lit(HARD_CUT)), F.lit("...")))


def preview(content: Column) -> Column:
    return F.left(content, F.lit(PREVIEW_CHARS))


def log_slug(query: Column) -> Column:
    return F.regexp_replace(F.replace(F.upper(F.left(query, F.lit(SLUG_CHARS))), F.lit(" "), F.lit("_")), r"[^\p{L}\p{N}_]", "")


def valid_intent(intent: Column) -> Column:
    """Struct (valid, intent): as it is, else in capitals with blanks and hyphens as _, else
    the fallback."""
    known = sorted(config.INTENT_ACTIONS)
    normal = F.translate(F.upper(intent), " -", "__")
    name = F.when(intent.isin(known), intent).when(normal.isin(known), normal)
    return F.struct(name.isNotNull().alias("valid"), F.coalesce(name, F.lit(config.FALLBACK_INTENT)).alias("intent"))


def program_name(heading: Column) -> Column:
    """What a heading says after NGÀNH, up to a bracket; else it without its set phrases.
    Capitals become a title."""
    after = F.regexp_replace(F.regexp_extract(heading, r"(?iuU)NGÀNH\s+([^(]+)", 1), r"(?U)^[\s*]+|[\s*]+\z", "")
    rest = stripped(F.regexp_replace(heading, r"(?iuU)(CHƯƠNG TRÌNH|ĐÀO TẠO|TIẾN SĨ|THẠC SĨ|GIỚI THIỆU)\s*", ""))

    def title(s: Column) -> Column:
        """A capital wherever no letter stands before."""
        chars = F.split(s, "")
        return F.array_join(F.transform(chars, lambda c, i: F.when((i > 0) & F.coalesce(F.get(chars, i - 1), F.lit("")).rlike(r"\p{L}"), F.lower(c)).otherwise(F.upper(c))), "")

    return F.when(after != "", F.when(after == F.upper(after), title(after)).otherwise(after)).when(rest != "", title(rest)).otherwise(heading)


def abbreviations(name: Column) -> Column:
    key = F.regexp_replace(F.translate(F.trim(F.lower(name)), "–—", "--"), r"\s+", " ")
    return F.coalesce(*[F.when(key == n, short) for n, short in ABBREVIATIONS.items()])


# -- answers ---------------------------------------------------------------------------


def _object(text: Column) -> Column:
    """A JSON object as a map; null if it can't be read as it stands."""
    return F.from_json(text, "map<string,string>", {"allowSingleQuotes": "false"})


def answer_object(raw: Column) -> Column:
    """Map of the first flat JSON object of an answer, code fences aside, with double quotes
    for single ones if it can't be read else; null if it can't be read at all."""
    bare = F.replace(F.regexp_replace(raw, r"```(?:json)?\s*", ""), F.lit("```"), F.lit(""))
    found = F.nullif(F.regexp_extract(bare, r"(\{[^{}]*\})", 1), F.lit(""))
    return F.coalesce(_object(found), _object(F.replace(found, F.lit("'"), F.lit('"'))))


def verdict(raw: Column) -> Column:
    """Struct (passed, critique) of a checking model's answer. An object decides, where it
    reads as one; whatever else is said passes, so that no loop goes on for ever."""
    object_ = F.nullif(F.regexp_extract(raw, r"(\{[^}]+\})", 1), F.lit(""))
    fields = _object(object_)
    passed = F.coalesce(~F.lower(F.coalesce(fields["passed"], F.lit("false"))).isin("false", "0", "", "null"), F.lit(False))
    return F.struct(F.when(fields.isNull(), True).otherwise(passed).alias("passed"), F.when(fields.isNull(), "").otherwise(stripped(F.coalesce(fields["critique"], F.lit("")))).alias("critique"))


def form_fields(raw: Column) -> Column:
    """Map of the fields that an answer fills in: what stands for nothing drops out."""
    fenced = F.coalesce(F.nullif(F.regexp_extract(raw, r"(?s)```(?:json)?(.*?)(?:```|\z)", 1), F.lit("")), raw)
    bare = stripped(fenced)
    object_ = F.when(bare.startswith("{"), bare).otherwise(F.nullif(F.regexp_extract(bare, r"(\{[^{}]*\})", 1), F.lit("")))
    fields = _object(object_)
    nothing = lambda v: v.isNull() | F.lower(v).isin("", "null", "none", "false", "0", "[]", "{}")
    return F.coalesce(F.map_filter(fields, lambda k, v: ~nothing(v)), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def merged_extra(automatic: Column, given: Column) -> Column:
    """Two maps as one; what is given wins."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    given = F.coalesce(given, none)
    return F.map_concat(F.map_filter(F.coalesce(automatic, none), lambda k, v: ~F.map_contains_key(given, k)), given)


def merged_context(internal: Column, web: Column, citations: Column) -> Column:
    """Sections of the internal context, the web's and its citations (array of text, url)."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    links = F.array_join(F.transform(citations, lambda c: F.concat(F.lit("- ["), c["text"], F.lit("]("), c["url"], F.lit(")"))), "\n")
    return F.concat_ws(
        "\n\n",
        F.when(has(internal), F.concat(F.lit("[DỮ LIỆU NỘI BỘ]\n"), internal)),
        F.when(has(web), F.concat(F.lit("[DỮ LIỆU TỪ WEB]\n"), web)),
        F.when(has(web) & (F.size(citations) > 0), F.concat(F.lit("[NGUỒN TRÍCH DẪN]\n"), links)),
    )


def is_enough(context: Column, said: Column, enabled: bool = True) -> Column:
    """A context suffices if it isn't short and the model's answer begins with YES."""
    return F.lit(enabled) & (F.length(stripped(F.coalesce(context, F.lit("")))) >= ENOUGH_CHARS) & F.startswith(F.upper(stripped(F.coalesce(said, F.lit("")))), F.lit("YES"))


def bypasses_model(source: Column) -> Column:
    return source.isin(BYPASS)


def fallback_answer(existing: Column, context: Column, message: str) -> Column:
    return F.coalesce(F.nullif(existing, F.lit("")), F.nullif(context, F.lit("")), F.lit(message))


def safe_by_scores(score: Column, deep: Column, least: float = 0.88) -> Column:
    """Two guards' answers: a score from `least` on or UNSAFE blocks; no answer passes."""
    return ~(F.coalesce(score >= least, F.lit(False)) | F.coalesce(F.startswith(F.upper(F.trim(deep)), F.lit("UNSAFE")), F.lit(False)))


def allowed_origin(origin: Column, referer: Column, hosts: list[str], enabled: bool = True) -> Column:
    """A request's origin, else its referer, is on an allowed host; without either it passes."""
    named = F.coalesce(F.nullif(origin, F.lit("")), F.nullif(referer, F.lit("")))
    return F.lit(not enabled) | named.isNull() | T.allowed_host(named, hosts)


# -- tables ----------------------------------------------------------------------------


def best_over_variants(scored: DataFrame, k: int = config.VECTOR_TOP_K) -> DataFrame:
    """The k best chunks of each query by their best score over its variants
    (query_id, variant, chunk_id, score)."""
    best = scored.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def vector_shape(vectors: DataFrame) -> DataFrame:
    """Mean, least, greatest and standard deviation of the norms, and how many fall into
    each tenth up to 2 (the last has the rest), of vectors (embedding) with an embedding."""
    from docloom.functions.vectors import norm

    n = vectors.filter(F.col("embedding").isNotNull()).select(norm(F.col("embedding")).alias("n"))
    bins = n.groupBy(F.least(F.floor(F.col("n") * 10), F.lit(20)).cast("int").alias("bin")).agg(F.count("*").alias("count"), F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    total = F.sum("count")
    mean = F.sum("s") / total
    shape = F.array_sort(F.collect_list(F.struct("bin", "count")))
    text = F.array_join(F.transform(shape, lambda x: F.concat_ws(":", x["bin"], x["count"])), ",")
    return bins.agg(total.alias("n"), F.round(mean, 6).alias("avg"), F.round(F.min("lo"), 6).alias("min"), F.round(F.max("hi"), 6).alias("max"), F.round(F.sqrt(F.greatest(F.sum("q") / total - mean * mean, F.lit(0.0))), 4).alias("stddev"), text.alias("distribution"))


def document_detail(chunks: DataFrame, source: str) -> DataFrame:
    """A source's active chunks in the order they came in."""
    return chunks.filter((F.col("source") == source) & F.col("is_active")).orderBy("created_at", "chunk_id")


def without_logs(logs: DataFrame, names: DataFrame) -> DataFrame:
    """The ledger without the rows of files (file_name)."""
    return logs.join(names.select("file_name").distinct(), "file_name", "left_anti")


#: Fixed value: what a cancelled task says.
CANCELLED = "Bị hủy bởi Admin"


def cancelled(tasks: DataFrame, wanted: DataFrame) -> DataFrame:
    """tasks (task_id, status, message) after the wanted ones (task_id) were cancelled:
    they have failed, whatever they were before. Wanted tasks that aren't there change
    nothing."""
    stop = wanted.select("task_id").distinct().withColumn("_stop", F.lit(True))
    marked = tasks.join(stop, "task_id", "left")
    return marked.withColumn("status", F.when(F.col("_stop"), "failed").otherwise(F.col("status"))).withColumn("message", F.when(F.col("_stop"), CANCELLED).otherwise(F.col("message"))).drop("_stop")


def cache_statistics(cache: DataFrame, now: Column, ttl_seconds: int = config.CACHE_TTL_SECONDS, most: int = config.CACHE_SIZE) -> DataFrame:
    """One row: entries, those still alive, and the cache's limits."""
    alive = F.unix_timestamp(now) - F.unix_timestamp("saved_at") < ttl_seconds
    return cache.agg(F.count("*").alias("size"), F.count_if(alive).alias("alive")).select("size", "alive", F.lit(most).alias("max_size"), F.lit(config.CACHE_SIMILARITY).alias("threshold"), F.lit(ttl_seconds).alias("ttl_seconds"))

