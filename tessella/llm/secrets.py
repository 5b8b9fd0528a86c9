"""Secret scans in DataFrame operations only: keyword rules, and a randomness test battery over long tokens.

Rules find assignments, access keys and hex strings. The battery takes every run of 20 or more token characters, infers
its encoding from its characters, and tests it against uniform random draws from that encoding's alphabet: chi-squared
uniformity (from the pairs of equal symbols), runs about the middle of the alphabet, and lag-1 serial correlation. The three are
combined into one probability by the Cauchy combination, as they are not independent. Over all tokens of the corpus, for each encoding and class of lengths, a
Benjamini-Hochberg step then finds those that are not random, where FDR bounds the share of random ones among them. The others
look random, and are secrets if the battery could have told: tokens so short that text that people write in their encoding
would often pass are left alone.

Defined results: a null text is empty and has no spans; rows that repeat doc_id and text each get the same spans; a null
doc_id is a document like others; other columns are not read. Starts and ends are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import broadcast_if_small, free_name, row_key, stored, text_or_empty

#: kind: (pattern, group that is measured, its least length, a cheap test that every text with a match passes). Fixed values.
RULES = {
    "assign": (
        r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8,
        "(?i)passw|secret|token|api_?key",
    ),
    "access": (r"AKIA[A-Z0-9]+", 0, 16, "AKIA"),
    "hex": (r"[0-9a-f]+", 0, 32, "[0-9a-f]{32}"),
}
KINDS = [*RULES, "random"]
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"

#: encoding: (pattern of the whole token, alphabet in order, collision rate of text that people write in it).
#: Collision rates: twice the uniform rate where digits are structured, about 0.065 for letters of natural languages.
ENCODINGS = {
    "decimal": (r"^[0-9]+$", "0123456789", 0.2),
    "hex": (r"^[0-9a-f]+$", "0123456789abcdef", 0.125),
    "hex_upper": (r"^[0-9A-F]+$", "0123456789ABCDEF", 0.125),
    "lower": (r"^[a-z]+$", "abcdefghijklmnopqrstuvwxyz", 0.065),
    "base32": (r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.065),
    "base64": (
        r"^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.055,
    ),
    "base64url": (
        r"^[A-Za-z0-9_=-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 0.055,
    ),
    "mixed": (
        r"^.+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_=", 0.055,
    ),
}
FDR = 0.001
#: Standard deviations by which written text of a token's length exceeds the pairs of equal symbols of random draws, at least:
#: the battery then sees it as not random, at 0.001, with a probability of 0.99.
TOLD = 5.5
#: Draws for each symbol of the alphabet from which the chi-squared law holds; with fewer, pairs of equal symbols follow Poisson's.
DENSE = 5
#: Steps of -ln p in which the Benjamini-Hochberg step counts, up to 60.
BINS_PER_UNIT = 10


def _matches(kind: str, pattern: str, test: str, group: int) -> Column:
    """An array of (kind, i, before, m, measured): the match and the length of the text between it and the last one."""
    text = text_or_empty()
    found = F.arrays_zip(
        F.split(text, pattern, -1).alias("before"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"),
    )
    rows = F.transform(
        found,
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(x["before"]).alias("before"), x["m"].alias("m"),
            F.length(x["g"]).alias("measured"),
        ),
    )
    return F.when(text.rlike(test), F.filter(rows, lambda x: x["m"].isNotNull()))


def _found(documents: DataFrame) -> DataFrame:
    """(doc_key, kind, m, start, end, measured) of every match of the rules and every long token, stored."""
    patterns = [(kind, p, test, group) for kind, (p, group, _, test) in RULES.items()] + [("random", TOKEN, TOKEN, 0)]
    nothing = F.array().cast("array<struct<kind:string,i:int,before:int,m:string,measured:int>>")
    every = F.concat(*[F.coalesce(_matches(*x), nothing) for x in patterns])
    rows = documents.select(row_key().alias("doc_key"), F.inline(every)).dropDuplicates(["doc_key", "kind", "i"])
    order = Window.partitionBy("doc_key", "kind").orderBy("i")
    rows = rows.withColumn("end", F.sum(F.col("before") + F.length("m")).over(order))
    return stored(
        rows.select("doc_key", "kind", "m", (F.col("end") - F.length("m")).alias("start"), "end", "measured"), "matches"
    )


def upper_tail(z: Column) -> Column:
    """Of the standard normal distribution, by the series of Abramowitz and Stegun 26.2.17."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2) / (2 * math.pi) ** 0.5 * series
    return F.when(z >= 0, upper).otherwise(1 - upper)


def chi_squared_tail(x: Column, df: Column) -> Column:
    """The upper tail, by the cube root of Wilson and Hilferty."""
    return upper_tail((F.pow(x / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))


def poisson_tail(k: Column, mean: Column) -> Column:
    """The probability of k or more: that chi-squared with 2 k degrees is at most twice the mean."""
    df = F.greatest(2 * k, F.lit(2.0))
    return F.when(k <= 0, 1.0).otherwise(1 - chi_squared_tail(2 * mean, df))


def combined(*p: Column) -> Column:
    """One probability by the Cauchy combination, which holds for tests that depend on one another, as runs and serial correlation do."""
    parts = [F.greatest(F.least(x, F.lit(0.99)), F.lit(1e-15)) for x in p]
    mean = sum((F.tan((0.5 - x) * math.pi) for x in parts), F.lit(0.0)) / len(p)
    return F.when(mean > 0, F.atan(1 / mean) / math.pi).otherwise(0.5 - F.atan(mean) / math.pi)


def battery(tokens: DataFrame) -> DataFrame:
    """Add to tokens (m) their encoding, n, p_uniform, p_runs, p_serial, p_random of the three, and told: if they are long enough."""
    kind = F.lit(None).cast("string")
    for name, (pattern, _, _) in reversed(ENCODINGS.items()):
        kind = F.when(F.col("m").rlike(pattern), name).otherwise(kind)
    alphabet, rate = F.lit(""), F.lit(0.0)
    for name, (_, letters, collisions) in ENCODINGS.items():
        alphabet = F.when(F.col("encoding") == name, letters).otherwise(alphabet)
        rate = F.when(F.col("encoding") == name, collisions).otherwise(rate)
    body = tokens.withColumn("encoding", kind).withColumn("alphabet", alphabet).withColumn("rate", rate)
    body = body.withColumn("a", F.length("alphabet").cast("double")).withColumn(
        "s", F.expr("transform(split(m, ''), c -> cast(instr(alphabet, c) - 1 as double))")
    )
    body = body.withColumn("s", F.expr("filter(s, x -> x >= 0)")).withColumn("n", F.size("s").cast("double"))
    # Sums over symbols and over neighbours.
    body = (
        body.withColumn("counts", F.expr("transform(sequence(0, cast(a as int) - 1), k -> size(filter(s, x -> x = k)))"))
        .withColumn("same", F.expr("aggregate(counts, 0D, (t, o) -> t + cast(o as double) * (o - 1))"))
        .withColumn("next", F.expr("zip_with(slice(s, 1, greatest(size(s) - 1, 0)), slice(s, 2, greatest(size(s) - 1, 0)), (x, y) -> struct(x, y))"))
        .withColumn("high", F.expr("cast(size(filter(s, x -> x >= a / 2)) as double)"))
        .withColumn("runs", F.expr("1D + size(filter(next, p -> (p.x >= a / 2) <> (p.y >= a / 2)))"))
        .withColumn("mean", F.expr("aggregate(s, 0D, (t, x) -> t + x) / greatest(n, 1D)"))
        .withColumn("var", F.expr("aggregate(s, 0D, (t, x) -> t + (x - mean) * (x - mean)) / greatest(n, 1D)"))
        .withColumn("cov", F.expr("aggregate(next, 0D, (t, p) -> t + (p.x - mean) * (p.y - mean)) / greatest(n, 1D)"))
    )
    n, a, low = F.col("n"), F.col("a"), F.col("n") - F.col("high")
    pairs = F.greatest(n * (n - 1), F.lit(1.0))
    square = a * (F.col("same") + n) / F.greatest(n, F.lit(1.0)) - n
    p_uniform = F.when(n < DENSE * a, poisson_tail(F.col("same") / 2, pairs / 2 / a)).otherwise(chi_squared_tail(square, a - 1))
    excess = pairs * (F.col("rate") - 1 / a) / F.sqrt(2 * pairs / a * (1 - 1 / a))
    middle = 1 + 2 * F.col("high") * low / F.greatest(n, F.lit(1.0))
    spread = F.greatest((middle - 1) * (middle - 2) / F.greatest(n - 1, F.lit(1.0)), F.lit(1e-9))
    z_runs = (F.col("runs") - middle) / F.sqrt(spread)
    z_serial = F.col("cov") / F.greatest(F.col("var"), F.lit(1e-9)) * F.sqrt(n) + 1 / F.sqrt(F.greatest(n, F.lit(1.0)))
    one_sided = F.col("high") * low == 0
    tested = body.select(
        *tokens.columns, "encoding", "n", (excess >= TOLD).alias("told"), p_uniform.alias("p_uniform"),
        F.when(one_sided, 0.0).otherwise(F.least(2 * upper_tail(F.abs(z_runs)), F.lit(1.0))).alias("p_runs"),
        F.least(2 * upper_tail(F.abs(z_serial)), F.lit(1.0)).alias("p_serial"),
    )
    return tested.withColumn("p_random", combined(F.col("p_uniform"), F.col("p_runs"), F.col("p_serial")))


def _discoveries(tokens: DataFrame, fdr: float) -> DataFrame:
    """The tokens that look random: long enough, and not found structured. fdr bounds the expected share of random tokens among those."""
    tested = battery(tokens).withColumn("lengths", F.floor(F.log2(F.greatest(F.col("n"), F.lit(1.0)))).cast("int"))
    step = F.floor(F.least(-F.log(F.greatest(F.col("p_random"), F.lit(1e-26))), F.lit(60.0)) * BINS_PER_UNIT).cast("int")
    tested = stored(tested.withColumn("bin", step), "battery")  # rounds p up
    group = ["encoding", "lengths"]
    bins = tested.groupBy(*group, "bin").agg(F.count("*").alias("k"))
    smaller = Window.partitionBy(*group).orderBy(F.desc("bin"))  # at most 60 * BINS_PER_UNIT rows
    least = (
        bins.withColumn("rank", F.sum("k").over(smaller)).withColumn("all", F.sum("k").over(Window.partitionBy(*group)))
        .filter(F.exp(-F.col("bin") / BINS_PER_UNIT) <= F.col("rank") * fdr / F.col("all"))
        .groupBy(*group).agg(F.min("bin").alias("least"))
    )
    structured = F.coalesce(F.col("bin") >= F.col("least"), F.lit(False))
    return tested.join(F.broadcast(least), group, "left").filter(F.col("told") & ~structured)  # a row for each encoding and power of two


def find_secrets(documents: DataFrame, fdr: float = FDR) -> DataFrame:
    """All spans: doc_key, kind (a rule's or random), start, end."""
    found = _found(documents)
    keep = F.lit(False)
    for kind, (_, _, least, _) in RULES.items():
        keep |= (F.col("kind") == kind) & (F.col("measured") >= least)
    random = _discoveries(found.filter("kind = 'random'"), fdr)
    span = ["doc_key", "kind", "start", "end"]
    return found.filter(keep).select(span).unionByName(random.select(span))


def secret_spans(documents: DataFrame, fdr: float = FDR) -> DataFrame:
    """(doc_key, spans): each document's spans, by start and then by kind. Documents without a span have no row."""
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    one = F.struct("start", order.alias("order"), "end", "kind")
    return find_secrets(documents, fdr).groupBy("doc_key").agg(F.sort_array(F.collect_list(one)).alias("spans"))


def redact(documents: DataFrame, fdr: float = FDR, mark: str = "[SECRET]") -> DataFrame:
    """The documents with each span, or run of overlapping spans, replaced by mark, and n_chars brought up to date if there."""
    key, own = free_name("_key", documents), free_name("_spans", documents)
    spans = stored(secret_spans(documents, fdr).toDF(key, own), "spans")
    pieces = F.expr(
        f"aggregate({own}, struct(0L as done, cast('' as string) as out), (acc, s) -> struct("
        "greatest(acc.done, s.end) as done,"
        "if(s.start < acc.done, acc.out, concat(acc.out, substring(text, cast(acc.done + 1 as int), cast(s.start - acc.done as int)), mark)) as out),"
        "acc -> concat(acc.out, substring(text, cast(acc.done + 1 as int))))".replace("mark", "'" + mark.replace("'", "\\'") + "'")
    )
    out = documents.join(broadcast_if_small(spans), row_key() == F.col(key), "left").withColumn(
        "text", F.when(F.col(own).isNull(), F.col("text")).otherwise(pieces)
    )
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col(own).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(documents.schema["n_chars"].dataType))
    return out.select(documents.columns)
