"""Provider calls with failures, the bounded loop, and answering a stream through a cache."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docloom.plans import loops, providers
from docloom.streaming.answering import Cache


def test_retries_and_order():
    waits = []
    asked = lambda *chain: providers.ask("x", chain, sleep=waits.append)
    assert asked(providers.StandIn("a")) == ("a says x", "a", 1, None) and not waits
    assert asked(providers.StandIn("a", 2)) == ("a says x", "a", 3, "a: 429; a: 429") and waits == [2, 4]
    waits.clear()
    assert asked(providers.StandIn("a", 9), providers.StandIn("b", 1)) == ("b says x", "b", 5, "a: 429; a: 429; a: 429; b: 429") and waits == [2, 4, 2]
    waits.clear()
    assert asked(providers.StandIn("a", never="x"), providers.StandIn("b")) == ("b says x", "b", 2, "a: bad request") and not waits  # for good: not tried again
    assert asked(providers.StandIn("a", never="x"), providers.StandIn("b", never="x")) == (None, None, 2, "a: bad request; b: bad request")
    assert asked() == (None, None, 0, "")


def test_no_row_is_lost(spark):
    rows = [(i, None if i == 7 else f"{'no ' * (i % 5 == 0)}{'never ' * (i % 10 == 0)}{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "id int, text string").repartition(5)
    got = {r.id: r for r in providers.answered(df, lambda: [providers.StandIn("first", 1, "no "), providers.StandIn("second", 0, "never")], base=0.0).collect()}
    assert got.keys() == {i for i, _ in rows}
    for i, t in rows:
        r = got[i]
        if t and "never" in t:
            assert (r.answer, r.provider, r.calls, r.error) == (None, None, 2, "first: bad request; second: bad request")
        elif t and "no " in t:
            assert (r.answer, r.provider, r.calls) == (f"second says {t}", "second", 2)
        else:
            assert (r.answer, r.provider, r.calls, r.error) == (f"first says {t or ''}", "first", 2, "first: 429")
    with pytest.raises(ValueError, match="calls"):
        providers.answered(df.withColumn("calls", F.lit(1)), list)


@pytest.mark.parametrize("max_loops", [0, 1, 3])
def test_loop_equals_one_row_at_a_time(spark, max_loops):
    rng = random.Random(max_loops)
    passes = {i: rng.choice([1, 1, 2, 3, 9]) for i in range(60)}
    df = spark.createDataFrame(list(passes.items()), "id int, when_ int").repartition(3)
    made, checked = [], []

    def draft(rows):
        made.append(rows.count())
        return rows.withColumn("draft", F.concat_ws("|", F.col("id"), "round", F.coalesce("critique", F.lit("none"))))

    def check(rows):
        checked.append(rows.count())
        verdict = F.when(F.col("id") % 7 == 6, F.lit(None).cast("boolean")).otherwise(F.col("round") >= F.col("when_"))
        return rows.withColumn("passed", verdict).withColumn("said", F.concat(F.lit("c"), "round"))

    want = []
    for i, when in passes.items():
        critique = None
        for n in range(1, max_loops + 2):
            text = f"{i}|{n}|{critique or 'none'}"
            if n > max_loops or i % 7 == 6 or n >= when:
                want.append((i, text, True, critique or "", n))
                break
            critique = f"c{n}"
    got = [(r.id, r.draft, r.passed, r.critique, r.rounds) for r in loops.refined(df, draft, check, max_loops).collect()]
    assert sorted(got) == sorted(want) and len(checked) == max_loops and len(made) == max_loops + 1
    assert made == [sum(n <= r[4] for r in want) for n in range(1, max_loops + 2)]


def test_loop_stops_early(spark):
    made = []
    df = spark.range(5)
    out = loops.refined(df, lambda r: made.append(1) or r.withColumn("draft", F.lit("d")), lambda r: r.withColumn("passed", F.lit(True)).withColumn("said", F.lit("")), 9)
    assert out.count() == 5 and len(made) == 1
    with pytest.raises(ValueError, match="draft"):
        loops.refined(df.withColumn("draft", F.lit(1)), None, None)


REQUESTS = "request_id long, action string, asked_at timestamp, embedding array<double>, text string"


def simulated(batches, most, ttl, least):
    cache, out = [], {}
    for batch in batches:
        fresh = []
        for i, action, at, v, text in batch:
            live = [(-round(sum(a * b for a, b in zip(v, e[3], strict=True)) / (sum(a * a for a in v) * sum(b * b for b in e[3])) ** 0.5, 6), e[0], e[4]) for e in cache if e[1] == action and e[2] <= at and (at - e[2]).total_seconds() < ttl]
            best = min(live, default=None)
            if best and -best[0] >= least:
                out[i] = (best[2], True, best[1])
            else:
                answer = None if "fail" in text else f"answer to {text}"
                out[i] = (answer, False, None)
                if answer:
                    fresh.append((i, action, at, v, answer))
        cache = sorted(cache + fresh, key=lambda e: (e[2], e[0]))[-most:]
    return out, {e[0] for e in cache}


def test_answering_a_stream(spark, tmp_path):
    rng = random.Random(5)
    start = datetime(2026, 1, 1)
    batches = [[(10 * b + k, rng.choice("xy"), start + timedelta(hours=3 * b, seconds=k), [1.0, rng.choice([0.0, 1.0, 5.0])], rng.choice(["a", "b", "fail"])) for k in range(10)] for b in range(6)]
    want, left = simulated(batches, 9, 8 * 3600, 0.98)
    calls = []

    def ask(rows):
        calls.append(rows.count())
        return rows.withColumn("answer", F.when(F.col("text") != "fail", F.concat(F.lit("answer to "), "text")))

    cache = Cache(str(tmp_path / "c"), most=9, ttl_seconds=8 * 3600, least=0.98)
    for batch in batches:
        spark.createDataFrame(batch, REQUESTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        cache.run(spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), ask, str(tmp_path / "cp"))
    got = {r.request_id: (r.answer, r.hit, r.entry_id) for r in cache.answers(spark).collect()}
    assert got == want and {r.entry_id for r in cache.before(spark, 99).collect()} == left
    assert sum(calls) == sum(not hit for _, hit, _ in want.values()) and any(hit for _, hit, _ in want.values())
    again = spark.createDataFrame(batches[-1], REQUESTS)
    for _ in range(2):  # a batch that runs again
        cache.step(again, 5, ask)
    assert {r.request_id: (r.answer, r.hit, r.entry_id) for r in cache.answers(spark).collect()} == want
    assert {r.entry_id for r in cache.before(spark, 99).collect()} == left and cache.answers(spark).count() == len(want)


def test_composing_pages(spark):
    from docloom.plans import compose

    schema = "page_id int, html string, title string, file_name string, program_level string, program_name string, academic_year string, reference_url string"
    rows = [(1, "<p>a</p>\n<p>bb</p>\n<p>c</p>", "T", " x ", "thac_si", None, "2026", ""), (2, "ok\nfail", "U", None, None, None, None, None), (3, None, None, "y.md", None, None, None, "http://u")]
    seen = []

    def ask(parts):
        seen.extend(r.text for r in parts.collect())
        inner = F.regexp_extract("text", r"(?s)phần này:\n(.*)\z", 1)
        return parts.withColumn("answer", F.when(~inner.contains("fail"), F.concat(F.lit("```markdown\n"), F.regexp_replace(inner, "</?p>", ""), F.lit(" \n```")))).withColumn("error", F.when(inner.contains("fail"), "no answer"))

    got = {r.page_id: tuple(r)[1:] for r in compose.composed(spark.createDataFrame(rows, schema).repartition(3), ask, most=12).collect()}
    assert got == {
        1: ("x.md", '---\ntitle: "T"\nprogram_level: "thac_si"\nacademic_year: "2026"\n---\n-start-\n\na\n\nbb\n\nc', 3, None),
        2: ("Ban_Nhaps.md", None, 1, "no answer"),
        3: ("y.md", '---\ntitle: ""\nreference_url: "http://u"\n---\n-start-\n\n', 1, None),
    }
    assert "Tiêu đề: T (Phần 2/3)\n\nNội dung HTML phần này:\n<p>bb</p>" in seen
