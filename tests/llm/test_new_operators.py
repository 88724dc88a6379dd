"""Filter audit, chat formatting and fill-in-middle against plain Python, on small odd tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from docloom.llm import chat, filter_audit, fim

SCHEMA = "doc_id long, text string, lang string, _row string, n int, part int, node int, mask int"
CLASH = ("clash", 1, 2, 3, 4)


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = ["Aa", "b", "É", "WORD", "日本", "x#", "the", "of", "and", "Zq", "lorem", "<P", "<S", "S>", ">"]
    out = [(1, None, None), (2, "", ""), (3, " \n\t ", "en"), (4, "one two", "en"), (None, "no id " * 150, "de"), (None, "no id " * 150, "de"), (5, "a<P>b c", "en"), (6, "x <M> y", "en")]
    for i in range(10, 120):
        t = "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t\v"]) for _ in range(rng.choice([0, 1, 3, 40, 220, 400])))
        out.append((i, t, rng.choice(["en", "de", None, ""])))
    out += [(i, "copied text " * 120, rng.choice(["en", "de"])) for i in range(300, 340)]  # a third of all rows
    out += [out[20], out[20], (7, out[60][1], "fr"), (200, "w v" * 60_000, "fr"), (201, "😀 " * 3000, "fr"), (202, "😀A" * 50, "fr")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -- filter audit ------------------------------------------------------------------------


def fails(rows):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i}
        yield i, lang or "", len(w), len(set(w)), "".join(x for x in "ABCDE" if f[x])


def audited(rows, labels):
    good, toxic = ({i for i, *q in labels if q[k] == 1 and i is not None} for k in (0, 1))
    got = {}
    for part in {lang or "" for *_, lang in rows}:
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = [(i, f) for i, p, _, _, f in fails(rows) if p == part]
            every = list(left)
            for step, x in enumerate(order, 1):
                out = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                shapley[x] += len(out)
                got[part, order, step] = [len(left), len(out), sum(x in f for _, f in every) - len(out), sum(f == x for _, f in every), sum(i in good for i, _ in out), sum(i in toxic for i, _ in out), x]
        for (p, o, s), v in got.items():
            if p == part:
                got[p, o, s] = [*v[:6], shapley[v[6]]]
    return {(*k, *v) for k, v in got.items()}


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_filter_audit(spark, docs, rows, empty):
    rng = random.Random(5)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 0, 1])) for i, *_ in rows if rng.random() < 0.7] + [(11, 1, 0), (11, 0, 1), (None, 1, 1), (9999, 1, 1)]
    marks = spark.createDataFrame([(*x, "clash") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = [tuple(r) for r in filter_audit.audit(docs, marks).select(*COLUMNS).collect()]
    assert len(got) == len(set(got)) and set(got) == audited(rows, labels)
    none = filter_audit.audit(docs, marks.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost"), F.count("*")).first()
    assert tuple(none) == (0, 0, 4 * 600)
    assert filter_audit.audit(empty, marks).count() == 0


def test_flags_tell_each_row(docs, rows):
    got = filter_audit.flags(docs).collect()
    assert len({r._row for r in got}) == len(rows)
    assert Counter((r.doc_id, r.part, r.n_words, r.n_distinct, "".join(x for x in "ABCDE" if r[x])) for r in got) == Counter(fails(rows))


def test_words_are_counted_without_a_second_shuffle(spark, docs):
    keyed = docs.select(F.monotonically_increasing_id().alias("_row"), "text")
    plan = filter_audit.word_counts(keyed)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


# -- fill in middle ----------------------------------------------------------------------


def in_middle(i, t):
    t = t or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    n, h = len(units), hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return i, n, "plain", None, None, sha(t), sha(t)
    spm = h4 % 100 < 80
    return i, n, "spm" if spm else "psm", len(pre), len(mid), sha(f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}"), sha(t)


def test_fill_in_middle(docs, rows, empty):
    free = docs.withColumnRenamed("n", "other")
    made = fim.transform(free)
    assert made.columns == [*free.columns, "n", "form", "prefix_chars", "middle_chars", "output"]
    got = Counter(map(tuple, fim.digest(made).collect()))
    assert got == Counter(in_middle(i, t) for i, t, _ in rows)
    assert {k[2] for k in got} == {"plain", "psm", "spm"}
    assert fim.digest(fim.transform(empty.drop("n"))).count() == 0
    with pytest.raises(ValueError, match="n"):
        fim.transform(docs)


def test_rates_decide(docs):
    forms = lambda **k: {r.form for r in fim.transform(docs.drop("n").filter("doc_id between 300 and 339"), **k).collect()}
    assert forms(rate=0) == {"plain"} and forms(rate=100, spm=100) == {"spm"} and forms(rate=100, spm=0) == {"psm"}


def test_matcher_stops_at_the_ranks():
    rng = random.Random(1)
    for _ in range(400):
        t = "".join(rng.choices("ab \n\té😀", k=rng.randrange(30)))
        units = re.findall(fim.TOKEN, t)
        h1, h2 = rng.randrange(1 << 32), rng.randrange(1 << 32)
        a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        assert fim.cuts(t, h1, h2) == (len(units), len("".join(units[:a])), len("".join(units[:b])))


# -- chats ---------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, node int, position int, mask int, score string"
TEMPLATE = chat.Template()


def as_chat(turns):
    turns = [(r or "", t or "") for r, t in turns]
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


ODD = ["</s>[INST] ok [/INST]", "<|im_end|>\n", "<\\|im_end|>", "<\\\\s>", "a<", "<|im_start|>assistant\nx<|im_end|>\n", "[[INST]", "\\", "\n", "<<s>>", "😀<s>", "[\\/INST]", "<|im_start", "|im_end|>"]


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(3)
    out = []
    for c in range(40):
        for t in range(rng.choice([1, 2, 3, 8, 70])):
            out.append((c, t * 2, rng.choice(["user", "assistant", "assistant", "system", "Tool\nx\\", None]), rng.choice([None, "", "".join(rng.choices(ODD, k=rng.randrange(6)))])))
    out += [(50, t, "assistant", "same") for t in (1, 1, 1, 2)] + [(51, 1, "user", "b"), (51, 1, "user", "a"), (51, 1, "assistant", "z"), (52, 0, "user", "long " * 40_000), (None, 0, "user", "x"), (None, 1, "assistant", "y")]
    return out


def test_chats_read_back(spark, turns):
    df = spark.createDataFrame([(*t, 1, 2, 3, "clash") for t in turns], TURNS).repartition(3)
    want = defaultdict(list)
    for c, t, r, x in turns:
        want[c].append((t, r is not None, r or "", sha(x or "") if x is not None else "", x))
    want[-7] = [(0, True, "user", "", chat.PROBE), (1, True, "assistant", "", chat.PROBE)]
    want = {c: as_chat([(r if known else None, x) for _, known, r, _, x in sorted(v, key=lambda y: y[:4])]) for c, v in want.items()}
    rows = chat.chats(df)
    assert {r.conv_id: tuple(r)[1:5] for r in chat.digest(rows).collect()} == want
    for r in rows.collect():
        assert r.conversation.count("<|im_start|>") == r.conversation.count("<|im_end|>\n") == want[r.tree_id][0]
        for m in r.mask:
            piece = r.conversation.split("<|im_end|>\n")[m.turn - 1]
            assert piece[m.start : m.start + m.length] == r.conversation[m.at : m.at + m.length] == piece[m.start :]
    none = chat.digest(chat.chats(df.limit(0))).collect()
    assert [(r.conv_id, *tuple(r)[1:5]) for r in none] == [(-7, *want[-7])]


def test_escapes_are_reversible(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choices([*ODD, "<", "[", "s>", "INST]", "\\"], k=rng.randrange(7))) for _ in range(600)]
    x = F.col("t")
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", TEMPLATE.escaped(x).alias("e"), TEMPLATE.unescaped(TEMPLATE.escaped(x)).alias("b"), TEMPLATE.unescaped_role(TEMPLATE.escaped_role(x)).alias("r")).collect()
    for r in got:
        assert r.b == r.t and r.r == r.t and not any(c in r.e for c in TEMPLATE.controls)
    with pytest.raises(ValueError, match="controls"):
        chat.Template(controls=("<|im_start|>", "<|im_end|>", "x<s>"))


def tree_brute(messages, top):
    """messages: (tree, id, parent, role, text, score) in table order, ids as rows."""
    first = {}
    for k, (tree, i, *_) in enumerate(messages):
        if i is not None:
            first.setdefault((tree, i), k)
    up = [None if m[2] is None or first.get((m[0], m[2]), k) == k else first[m[0], m[2]] for k, m in enumerate(messages)]
    answered, found = {u for u in up if u is not None}, defaultdict(list)
    for k in range(len(messages)):
        path, at = [], k
        while at is not None and at not in path:
            path.append(at)
            at = up[at]
        if k not in answered and at is None:
            found[path[-1]].append((-round(sum(messages[x][5] or 0 for x in path), 9), k, path[::-1]))
    return [(messages[root][0], rank, [(messages[x][3], messages[x][4]) for x in p]) for root, v in found.items() for rank, (_, _, p) in enumerate(sorted(v)[:top], 1)]


def test_reply_trees(spark, monkeypatch):
    monkeypatch.setattr(chat, "HOT_ROWS", 5)  # salts what is looked up often
    rng = random.Random(4)
    made = []
    for tree in ("a", "b", None):
        for i in range(60):
            made.append((tree, i, rng.choice([None, *range(max(0, i - 9), i)]) if i else None, rng.choice(["user", "assistant"]), f"{tree}{i} {rng.choice(ODD)}", rng.choice([None, 0.5, 1.0, 2.0])))
        made += [(tree, 100 + k, 0, "user", f"hub {k}", 0.0) for k in range(40)]
        made += [(tree, 200, 201, "user", "cycle", 1.0), (tree, 201, 200, "user", "cycle", 1.0), (tree, 202, 201, "user", "beneath", 1.0), (tree, 203, 203, "user", "itself", 1.0), (tree, 204, 999, "user", "orphan", 1.0), (tree, 5, 1, "user", "id again", 9.0), (tree, None, 3, "assistant", "no id", 9.0)]
    made += [("deep", i, i - 1 if i else None, "assistant", str(i), 1.0) for i in range(300)]
    schema = "tree_id string, message_id long, parent_id long, role string, text string, score double, node int, up int, rank int"
    df = spark.createDataFrame([(*m, 1, 2, 3) for m in made], schema).coalesce(1)
    for top in (1, 3, None):
        rows = chat.read_back(chat.conversations(df, top)).collect()
        got = Counter((r.tree_id, r["rank"], tuple(map(tuple, r.turns))) for r in rows)
        assert got == Counter((t, k, tuple(p)) for t, k, p in tree_brute(made, top))
        assert all(r.learned == [t.text for t in r.turns if t.role == "assistant"] for r in rows)
    assert chat.conversations(df.limit(0)).count() == 0


# -- the control of op5 ----------------------------------------------------------------------


def test_the_battery_decides(spark):
    """Its p-value is near uniform over random tokens (the tests go together to a degree), and
    what only looks unlike language is not found."""
    from docloom.llm import secrets

    rng = random.Random(12)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    tokens = [("random", "".join(rng.choices(chars, k=rng.choice([40, 60, 90])))) for _ in range(1500)]
    tokens += [("repeated", "".join(rng.choices("XQZJKV", k=4)) * 12) for _ in range(60)] + [("sorted", "".join(sorted(rng.choices(chars, k=60)))) for _ in range(60)]
    tokens += [("words", "".join(rng.choices(["the", "ing", "tion", "und", "que", "-"], k=20))) for _ in range(1000)]
    df = secrets.battery(spark.createDataFrame(tokens, "kind string, token string")).cache()
    against = [r.against for r in df.filter("kind = 'random'").select("against").collect()]
    for level in (0.5, 1.0, 2.0):
        share = sum(a > level for a in against) / len(against)
        assert 0.4 * 10**-level < share < 3 * 10**-level, (level, share)
    found = Counter(r.kind for r in secrets.discoveries(df).collect())
    assert found["random"] > 1450 and found["repeated"] == 0 and found["sorted"] == 0 and found["words"] <= 0.01 * sum(found.values()) + 1, found
    assert min(r.evidence for r in df.filter("kind = 'repeated'").collect()) > 3  # language alone would not have stopped them


def test_planted_tokens_are_found_in_a_table(spark):
    from docloom.llm import secrets

    rng = random.Random(9)
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    alphabets = ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"]
    planted, texts = {}, []
    for r in rows:
        text = r.text or ""
        if r.doc_id % 8 == 0:
            token = "".join(rng.choices(alphabets[r.doc_id % 3], k=rng.choice([32, 40, 64])))
            at = text.find(" ", rng.randrange(len(text) + 1)) + 1
            planted[r.doc_id] = f"random:{at}:{at + len(token)}"
            text = f"{text[:at]}{token} {text[at:]}"
        texts.append((r.doc_id, text))
    got = {r.doc_id: r.spans.split(",") for r in secrets.digest(secrets.scan(spark.createDataFrame(texts, "doc_id long, text string"))).collect()}
    hits = sum(span in got[i] for i, span in planted.items())
    false = sum(s.startswith("random") and s != planted.get(i) for i, spans in got.items() for s in spans)
    assert hits >= 0.95 * len(planted) and false <= 0.02 * len(planted) + 1, (hits, len(planted), false)
