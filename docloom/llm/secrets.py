"""Secret scans: patterns, and a battery of randomness tests for what no pattern names.

Base kinds are patterns. The method adds kind ``random``: long runs of encoding
characters outside the base spans whose symbols look like random data.

Per token the encoding is inferred (digits, hex of one case, base32, or the character
classes it uses) and with it the alphabet, in its order. Three tests are made on the
symbols' ranks in that alphabet: chi-squared uniformity (Wilson-Hilferty), runs above and
below the alphabet's middle, and serial correlation at lag 1. Their p-values are combined
by Fisher's method into one of the whole battery: how often random symbols fare so badly.

Short tokens of words pass such tests by chance, so each also gets the probability that a
language gives letters and digits so unlike its own: the mean log-likelihood of its symbols
under the letter frequencies of European languages, whose spread shrinks with the token's
length; and so many runs of capitals, small letters and digits. The control ranks tokens by
both at once: what speaks against language less what the battery has against randomness, from a
p-value of 0.1 down. This is never less than language's own p-value, so a
Benjamini-Hochberg step over all tokens of one length class bounds the share of words among
the discoveries; and a token that the battery rejects as a whole (0.001) is none. Ranks
come from a histogram, so that no task ever sorts all tokens, and the table of cuts has one
row per length class.
A run of digits counts there as one symbol, since words hold years and numbers; strings of
digits alone so say nothing, and are left to the base kind hex.

Built of DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import with_row_key, written

#: Fixed patterns of the contract, in its order of kinds; with the shortest match, or group 2.
PATTERNS = {
    "assign": r"(?i:(password|passwd|secret|token|api_?key))[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
#: Found by these instead, where the whole match has a least length: a greedy run holds
#: one match, and only its length decides.
LEAST = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
KINDS = [*PATTERNS, "random"]

#: The whole battery rejects randomness below a p-value of 0.001, and says nothing against
#: it above 0.1 (as -log10).
REJECT, DOUBT = 3.0, 1.0
#: Shares of letters a to z in European languages, per cent, and of each digit in words.
LETTERS = [8.6, 1.4, 3.3, 4.5, 14.3, 1.4, 1.7, 3.0, 7.0, 0.4, 0.6, 4.8, 2.7, 7.6, 6.0, 2.3, 0.7, 6.8, 7.3, 6.9, 4.5, 1.2, 1.0, 0.3, 0.9, 0.6]
DIGIT = 0.005
#: Words vary more than letters drawn one by one: their spread counts this many times.
SPREAD = 1.25
#: Share of a word's neighbours of unlike class: names in mixed case, with numbers in them.
CHANGES = 0.15


def _spans(pattern: str, kind: int, keep: str = "true") -> str:
    """SQL: array<struct<start, kind, end, token>> of the matches, in code points. The
    pieces between matches give the positions, so the text is searched a fixed number of
    times however many matches it has."""
    quoted = pattern.replace("'", r"\x27")
    fold = (
        f"aggregate(arrays_zip(split(text, r'{quoted}', -1), regexp_extract_all(text, r'{quoted}', 0), {keep}), "
        "named_struct('at', 0, 'out', cast(array() as array<struct<start: int, kind: int, end: int, token: string>>)), "
        "(s, x) -> named_struct('at', s.at + length(x.`0`) + coalesce(length(x.`1`), 0), 'out', "
        f"if(x.`1` is null or length(x.`2`) < 6, s.out, concat(s.out, array(named_struct('start', s.at + length(x.`0`), 'kind', {kind}, 'end', s.at + length(x.`0`) + length(x.`1`), 'token', x.`1`))))), s -> s.out)"
    )
    return f"if(text rlike r'{quoted}', {fold}, cast(array() as array<struct<start: int, kind: int, end: int, token: string>>))"


def _base(kind: str) -> Column:
    pattern, k = LEAST.get(kind, PATTERNS[kind]), KINDS.index(kind)
    group = 2 if kind == "assign" else 0
    quoted = pattern.replace("'", r"\x27")
    return F.expr(_spans(pattern, k, f"regexp_extract_all(text, r'{quoted}', {group})"))


def _tail(z: Column) -> Column:
    """-log10 of the lower tail of the normal distribution, for z below 0; 0 above.
    (Abramowitz and Stegun 7.1.26 beside the tail's leading term for large arguments.)"""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.31938153 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, F.lit(0.0)).otherwise((x * x / 2 + 0.9189385332) / 2.302585093 - F.log10(poly))


def _battery() -> Column:
    """-log10 of the p-value of the three tests, two-sided each, by Fisher's method: the
    tail of chi-squared with six degrees of freedom. Runs and serial correlation go together
    to a degree, so small values come two to three times as often as they say."""
    each = [F.greatest(_tail(-F.abs(c)) - math.log10(2), F.lit(0.0)) for c in ("chi2_z", "runs_z", "serial_z")]
    x = sum(each[1:], each[0]) * math.log(10)
    return F.greatest((x - F.ln(1 + x + x * x / 2)) / math.log(10), F.lit(0.0))


def _language() -> tuple[list[float], float, float]:
    """Bits that each of a-z0-9 speaks for language against an even draw, and their mean
    and standard deviation in language."""
    share = [x / sum(LETTERS) * (1 - 10 * DIGIT) for x in LETTERS] + [DIGIT] * 10
    bits = [math.log2(36 * x) for x in share]
    mean = sum(x * b for x, b in zip(share, bits, strict=True))
    return bits, mean, math.sqrt(sum(x * (b - mean) ** 2 for x, b in zip(share, bits, strict=True)))


def battery(tokens: DataFrame) -> DataFrame:
    """Adds encoding, k, n, chi2_z, runs_z, serial_z, against (-log10 of the p-value of
    these three together, that random symbols fare so badly) and evidence (-log10 of the
    probability that language gives symbols so unlike its own) to rows with a token."""
    bare = F.translate(F.rtrim("token", F.lit("=")), "-_", "+/")
    df = tokens.withColumn("bare", bare)
    t = F.col("bare")
    classes = [("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("[a-z]", "abcdefghijklmnopqrstuvwxyz"), ("[0-9]", "0123456789"), ("[+/]", "+/")]
    encoding = F.when(t.rlike("^[0-9]+$"), "digits").when(t.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(t.rlike("^[A-Z2-7]+$") & t.rlike("[2-7]"), "base32").otherwise("base64")
    used = F.concat(*[F.when(t.rlike(c), F.lit(chars)).otherwise("") for c, chars in classes])
    known = {"digits": F.lit("0123456789"), "hex": F.when(t.rlike("[A-F]"), "0123456789ABCDEF").otherwise("0123456789abcdef"), "base32": F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")}
    df = df.withColumn("encoding", encoding).withColumn("alphabet", F.coalesce(*[F.when(F.col("encoding") == e, a) for e, a in known.items()], used)).withColumn("k", F.length("alphabet").cast("double"))
    df = df.withColumn("v", F.expr("transform(filter(split(bare, ''), c -> instr(alphabet, c) > 0), c -> cast(instr(alphabet, c) - 1 as double))")).filter("size(v) >= 16").withColumn("n", F.size("v").cast("double"))
    squares = F.expr("aggregate(array_distinct(v), 0D, (s, x) -> s + power(size(filter(v, y -> y = x)), 2))")
    df = df.withColumn("chi2", F.col("k") / F.col("n") * squares - F.col("n"))
    free = F.col("k") - 1
    df = df.withColumn("chi2_z", (F.pow(F.greatest("chi2", F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free)))
    df = df.withColumn("high", F.expr("transform(v, x -> if(x > (k - 1) / 2, 1, 0))"))
    df = df.withColumn("n1", F.expr("aggregate(high, 0, (s, x) -> s + x)").cast("double")).withColumn("n0", F.col("n") - F.col("n1"))
    df = df.withColumn("runs", F.expr("1D + size(filter(sequence(2, size(high)), i -> high[i - 1] <> high[i - 2]))"))
    expected = 2 * F.col("n1") * F.col("n0") / F.col("n") + 1
    spread = F.sqrt((expected - 1) * F.greatest(expected - 2, F.lit(0.01)) / (F.col("n") - 1))
    df = df.withColumn("runs_z", F.when((F.col("n1") > 0) & (F.col("n0") > 0), (F.col("runs") - expected) / spread).otherwise(F.lit(99.0)))
    df = df.withColumn("mean", F.expr("aggregate(v, 0D, (s, x) -> s + x) / n"))
    df = df.withColumn("var", F.expr("aggregate(v, 0D, (s, x) -> s + (x - mean) * (x - mean))"))
    df = df.withColumn("serial", F.expr("aggregate(sequence(2, size(v)), 0D, (s, i) -> s + (v[i - 1] - mean) * (v[i - 2] - mean))"))
    df = df.withColumn("serial_z", F.when(F.col("var") > 0, (F.col("serial") / F.col("var") + 1 / F.col("n")) * F.sqrt("n")).otherwise(F.lit(99.0)))
    bits, mean, deviation = _language()
    each = F.expr(f"transform(filter(split(regexp_replace(lower(bare), '[0-9]+', '0'), ''), c -> c rlike '[a-z0-9]'), c -> element_at(array({', '.join(f'{b:.6f}D' for b in bits)}), instr('abcdefghijklmnopqrstuvwxyz0123456789', c)))")
    df = df.withColumn("bits", each).withColumn("language_z", F.expr("aggregate(bits, 0D, (s, x) -> s + x)") / F.greatest(F.size("bits"), F.lit(1)) - mean)
    df = df.withColumn("language_z", F.col("language_z") * F.sqrt(F.size("bits").cast("double")) / (SPREAD * deviation))
    # runs of one class (capitals, small letters, digits): changes between neighbours against what words show, by Chernoff's bound
    df = df.withColumn("changes", F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("bare", "[0-9]+", "0"), "[A-Z]+", "A"), "[a-z]+", "a"), "[^0Aa]", "")) - 1)
    gaps = F.col("n") - 1
    rate = F.least(F.greatest(F.col("changes") / gaps, F.lit(CHANGES)), F.lit(0.999))
    bound = gaps * (rate * F.ln(rate / CHANGES) + (1 - rate) * F.ln((1 - rate) / (1 - CHANGES))) / math.log(10)
    total = _tail(F.col("language_z")) + bound
    df = df.withColumn("evidence", F.greatest(F.lit(0.0), total - F.log10(1 + total * math.log(10))))  # Fisher's combination of the two
    df = df.withColumn("against", _battery())
    return df.drop("bare", "alphabet", "v", "high", "n1", "n0", "runs", "mean", "var", "serial", "bits", "changes")


def discoveries(tested: DataFrame, rate: float = 0.01) -> DataFrame:
    """Those rows of battery() that look random, at the false discovery rate within each
    class of lengths (doublings): ranked by their evidence less what the tests have against
    randomness, rounded down to hundredths, so ties share a rank."""
    score = F.greatest(F.col("evidence") - F.greatest(F.col("against") - DOUBT, F.lit(0.0)), F.lit(0.0))
    binned = tested.withColumn("length_class", F.floor(F.log2("n"))).withColumn("bin", F.least(F.floor(score * 100), F.lit(30000)))
    counts = binned.groupBy("length_class", "bin").count()
    by = Window.partitionBy("length_class")
    ranks = counts.withColumn("rank", F.sum("count").over(by.orderBy(F.desc("bin")))).withColumn("m", F.sum("count").over(by))
    cuts = ranks.filter(F.pow(F.lit(10.0), -F.col("bin") / 100) <= rate * F.col("rank") / F.col("m")).groupBy("length_class").agg(F.min("bin").alias("cut"))
    return binned.join(F.broadcast(cuts), "length_class").filter((F.col("bin") >= F.col("cut")) & (F.col("against") < REJECT))


def scan(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, base and found, arrays of (start,
    kind, end, token) by start and kind; found holds the base spans and the random ones.

    Positions are code points, ends exclusive. A null or empty text has no spans;
    repeated rows are scanned each; a null doc_id stays null; other columns are not
    read; an empty table gives no rows. Texts are read once and not shuffled.
    """
    keyed = with_row_key(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    base = F.array_sort(F.concat(*[_base(kind) for kind in PATTERNS]))
    quoted = TOKEN
    tokens = F.expr(_spans(quoted, KINDS.index("random"), f"regexp_extract_all(text, r'{quoted}', 0)"))
    free = F.expr("filter(tokens, t -> not exists(base, b -> b.start < t.end and t.start < b.end))")
    found = written(keyed.select("_row", "doc_id", base.alias("base"), tokens.alias("tokens")).withColumn("tokens", free), "secret-candidates")
    one = found.select("_row", F.explode("tokens").alias("t")).select("_row", "t", "t.token")
    random = discoveries(written(battery(one), "randomness"), rate).groupBy("_row").agg(F.collect_list("t").alias("more"))
    out = found.join(random, "_row", "left")
    return out.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start: int, kind: int, end: int, token: string>>")))).alias("found"))


def listed(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', element_at(array({names}), s.kind + 1), s.start, s.end)), ',')")


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns from scan()."""
    count = [F.expr(f"size(filter(base, s -> s.kind = {i}))").cast("long").alias(f"n_{k}") for i, k in enumerate(PATTERNS)]
    return scanned.select("doc_id", *count, F.sha2(listed("base"), 256).alias("base_sha256"), listed("found").alias("spans"))
