"""The thin queries opN_<name> of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import chat, decontaminate, embeddings, fim, filter_audit, line_dedup, near_dup, packing, quality, secrets, sharding, substrings, token_counts
from docloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hits")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op6_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"), exact=1)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.chats(table(spark, sf_dir, "conversations")))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.transform(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_token_counts, op2_quality, op3_near_duplicates, op4_decontamination, op5_secrets, op6_repeated_spans, op7_shards, op8_line_dedup, op9_packing, op10_embedding_near_dup, op11_filter_audit, op12_chat_formatting, op13_fill_in_middle)}

_WORDS = r"list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

SQL: dict[str, str] = {
    "op4_decontamination": f"""WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark), n AS (SELECT item_id, w, least(13, len(w)) AS m FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS gram FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM n)),
d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
a AS (SELECT k, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM g) WHERE len(w) >= m),
h AS (SELECT k, i, a.m, item_id FROM a JOIN g ON g.m = a.m AND g.gram = array_to_string(a.w[i : i + a.m - 1], ' ')),
c AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + m)) AS p FROM h) GROUP BY 1),
t AS (SELECT k, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT k, item_id::VARCHAR AS id FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (k) LEFT JOIN t USING (k)""",
    "op6_repeated_spans": r"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
v AS (SELECT k, doc_id, i, array_to_string(w[i : i + 49], ' ') AS g FROM (SELECT k, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT g, min(doc_id) AS source FROM v GROUP BY 1), r AS (SELECT k, i FROM v JOIN f USING (g) WHERE doc_id > source),
p AS (SELECT k, list_distinct(flatten(list(range(i, i + 50)))) AS gone FROM r GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256 FROM d LEFT JOIN p USING (k)""",
    "op11_filter_audit": r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, list_filter(string_split_regex(text, '[ \t-\r]+'), lambda x: x <> '') AS w FROM d),
s AS (SELECT text, min(doc_id) AS first FROM d GROUP BY 1),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY 1),
f AS (SELECT doc_id, part, MAP {'A': len(w) < 200, 'B': 100 * list_unique(w) < 50 * len(w), 'C': 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text), 'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > first, false)} AS fails FROM w JOIN s USING (text)),
m AS (SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: fails[x]) AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM c a, c b, c, c d, c e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
p AS (SELECT filter_order, step, filter_order[step] AS f, string_split(left(filter_order, step - 1), '') AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT list_contains(fails, f) AND NOT list_has_any(fails, before)), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (list_contains(fails, f) AND NOT list_has_any(fails, before)), 0)::BIGINT AS removed,
 coalesce(sum(n) FILTER (list_contains(fails, f) AND list_has_any(fails, before)), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = [f]), 0)::BIGINT AS unique_fails,
 coalesce(sum(good) FILTER (list_contains(fails, f) AND NOT list_has_any(fails, before)), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (list_contains(fails, f) AND NOT list_has_any(fails, before)), 0)::BIGINT AS toxic_lost FROM m, p GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r""",
    "op12_chat_formatting": r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, i, if(i = 0, 'user', 'assistant'), '</s>[INST] ok [/INST]' FROM range(2) r(i)),
e AS (SELECT *, sha256(text) AS h, length(regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g')) + length(role) + 24 AS chars FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, h) AS said, coalesce(string_agg(text, '' ORDER BY turn, role, h) FILTER (role = 'assistant'), '') AS loss, sum(chars)::BIGINT AS formatted_chars FROM e GROUP BY 1)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g""",
    "op13_fill_in_middle": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
x AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS k FROM d),
r AS (SELECT *, len(u) AS n, least(k[1] % (len(u) + 1), k[2] % (len(u) + 1)) AS a, greatest(k[1] % (len(u) + 1), k[2] % (len(u) + 1)) AS b, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR k[3] % 100 >= 50 THEN 'plain' WHEN k[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM x),
p AS (SELECT *, coalesce(array_to_string(u[1 : a], ''), '') AS pre, coalesce(array_to_string(u[a + 1 : b], ''), '') AS mid, coalesce(array_to_string(u[b + 1 :], ''), '') AS suf FROM r)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
}
