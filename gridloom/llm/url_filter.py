"""URL filter: host rules first, then a character language-model ratio.  DataFrame functions only.

Two variable-order Markov models over the characters of host + path are learned
from the urls that the rules accept and reject: Witten-Bell interpolation of
contexts of 0 to 4 characters,
    p_k = (n_k + T_k * p_(k-1)) / (N_k + T_k),  p_(-1) = 1 / 65536,
with n_k the count after the context, N_k the context's total and T_k its
distinct successors; an unseen context hands p_(k-1) on.  A url's score is the
mean over its characters (and one end) of log p_accepted - log p_rejected.  A
fifth of the ruled urls, by hash, is kept out of the counts; half way between
the mean scores of its accepted and rejected members lies the threshold.

Urls are made distinct before they are cut into characters, and grams before
they are looked up, so copies and hot hosts cost one row.

Edge cases: null urls or ones without "://" have empty host and path and are
judged as the empty string; where the rules accept or reject nothing to learn
from, the method allows; repeated rows are judged alike; extra columns go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import stored, table

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ORDER = 4
FLOOR = 1.0 / 65536
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_START, _END = "\x02", "\x03"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def ruled(urls: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and ruling: of the rules that fit, the longest."""
    rule, ruling = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, ruling = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruling)
    return urls.withColumn("rule", rule).withColumn("ruling", ruling)


def _grams(texts: DataFrame, *carry: str) -> DataFrame:
    """One row per character of text and its end: gram, the character after up to ORDER others."""
    padded = F.concat(F.lit(_START * ORDER), F.col("text"), F.lit(_END))
    cut = texts.select(*carry, padded.alias("padded"), F.explode(F.sequence(F.lit(1), F.length("text") + 1)).alias("at"))
    return cut.select(*carry, F.col("padded").substr(F.col("at"), F.lit(ORDER + 1)).alias("gram"))


def _suffixes(grams: DataFrame, *carry: str) -> DataFrame:
    ks = F.explode(F.array(*[F.lit(k) for k in range(ORDER + 1)]))
    return grams.select("gram", *carry, ks.alias("k")).withColumn("part", F.expr(f"substring(gram, {ORDER + 1} - k)"))


def gram_ratios(learn: DataFrame, wanted: DataFrame) -> DataFrame:
    """gram, ratio = log p_accepted - log p_rejected for the grams in wanted; learn: text, n_accepted, n_rejected."""
    whole = _grams(learn, "a", "b").groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    counts = stored(_suffixes(whole, "a", "b").groupBy("k", "part").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    context = F.expr("substring(part, 1, k)")
    # stored, so that the join below deals both sides itself and can split the grams of a hot context
    totals = counts.groupBy("k", context.alias("context")).agg(
        F.sum("a").alias("total_a"), F.sum("b").alias("total_b"),
        F.count_if(F.col("a") > 0).alias("types_a"), F.count_if(F.col("b") > 0).alias("types_b"),
    )
    totals = stored(totals)
    parts = _suffixes(wanted.select("gram").distinct()).withColumn("context", context)
    found = parts.join(counts, ["k", "part"], "left")
    # the empty context is that of every gram: its totals are one row, which goes to all tasks
    empty = F.broadcast(totals.where("k = 0").drop("k", "context"))
    found = found.where("k > 0").join(totals.where("k > 0").hint("merge"), ["k", "context"], "left").unionByName(found.where("k = 0").join(empty, F.lit(True), "left"))
    zero = F.lit(0).cast("double")
    levels = F.sort_array(F.collect_list(F.struct("k", *[F.coalesce(F.col(c).cast("double"), zero).alias(c) for c in ("a", "total_a", "types_a", "b", "total_b", "types_b")])))
    found = found.groupBy("gram").agg(levels.alias("levels"))

    def p(c: str) -> Column:
        step = lambda p, x: F.when(x[f"total_{c}"] > 0, (x[c] + x[f"types_{c}"] * p) / (x[f"total_{c}"] + x[f"types_{c}"])).otherwise(p)
        return F.aggregate("levels", F.lit(FLOOR), step)

    return found.select("gram", (F.log(p("a")) - F.log(p("b"))).alias("ratio"))


def _held(text: Column) -> Column:
    return F.pmod(F.crc32(text.cast("binary")), F.lit(5)) == 0


def url_filter(pages: DataFrame, rules=RULES, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict, score (null where a rule decides) per page."""
    host, path = host_and_path(F.col(url).cast("string"))
    rows = ruled(pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path")), rules)
    texts = rows.groupBy("host", "path", "ruling").agg(F.count("*").alias("n")).withColumn("text", F.concat("host", "path"))
    texts = stored(texts)
    learn = texts.where("ruling is not null").where(~_held(F.col("text"))).select("text", F.when(F.col("ruling") == "allow", F.col("n")).otherwise(0).alias("a"), F.when(F.col("ruling") == "block", F.col("n")).otherwise(0).alias("b"))
    judge = texts.where(F.col("ruling").isNull() | _held(F.col("text")))
    chars = _grams(judge, "host", "path", "ruling", "n")
    # stored, so that the join deals both sides itself and can split a hot gram
    ratios = stored(gram_ratios(learn, chars))
    scores = stored(chars.join(ratios, "gram").groupBy("host", "path", "ruling", "n").agg(F.avg("ratio").alias("score")))
    learned = learn.agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    mean = lambda verdict: F.sum(F.when(F.col("ruling") == verdict, F.col("score") * F.col("n"))) / F.sum(F.when(F.col("ruling") == verdict, F.col("n")))
    threshold = scores.agg(F.coalesce((mean("allow") + mean("block")) / 2, F.lit(0.0)).alias("threshold")).crossJoin(learned)  # one row each
    able = (F.coalesce("a", F.lit(0)) > 0) & (F.coalesce("b", F.lit(0)) > 0)
    decided = scores.where("ruling is null").select("host", "path", "score").crossJoin(F.broadcast(threshold))  # a single row
    decided = decided.select("host", "path", "score", F.when(able & (F.col("score") < F.col("threshold")), "block").otherwise("allow").alias("judged"))
    return rows.join(decided, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruling", "judged").alias("verdict"), F.when(F.col("ruling").isNull(), F.col("score")).alias("score")
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))
