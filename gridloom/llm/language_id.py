"""Language identification by Bayesian evidence fusion.

For every row and language the log posterior is the sum of
  text      log-likelihood of the bytes' letter trigrams, learned from labelled
            documents (a bounded sample of each language), divided by 3 as trigrams overlap;
  declared  log P(declared markup language | language);
  suffix    log P(address suffix | language);
  host      log prior of the host, smoothed towards its parent, its parent's
            parent and all rows: p = (n + KAPPA * p_parent) / (N + KAPPA).
The last three are counts of the text's own vote over all rows, by grouped
aggregation; counts combine on the map side, so a hot host costs one row a task.

A row is rejected if its text has no letters, if it has MIN_TRIGRAMS or more
and they are likelier under uniform noise than under every language, or if no language reaches MIN_POSTERIOR.

Edge cases: null text is empty and rejected with language null; missing
declared, suffix or host are no evidence; an empty table gives no rows; where no
labelled text exists every row is rejected; repeated rows are judged alike.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import TEXT_ROWS, id_text, mapped, sampled, stored, table
from gridloom.llm.url_filter import host_and_path

BINS = 1 << 15
SAMPLE = 6000
PER_LANGUAGE = 300
LANGUAGES = 400  # names in the labels that are learnt, the most frequent ones; bounds the model
KAPPA = 20.0
MIN_TRIGRAMS = 30
MIN_POSTERIOR = 0.4
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SLICE = 1 << 20


def trigrams(text: str | None):
    """Bins of the letter trigrams of a text, in slices."""
    raw = b" " + (text or "").encode("utf-8", "replace").translate(_FOLD) + b" "
    for i in range(0, max(1, len(raw) - 2), _SLICE):
        x = np.frombuffer(raw[i : i + _SLICE + 2], np.uint8).astype(np.uint32)
        if len(x) < 3:
            return
        a, b, c = x[:-2], x[1:-1], x[2:]
        codes = (a << 16) | (b << 8) | c
        codes = codes[b != 32]
        yield ((codes * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


class TextModel:
    """Log-likelihoods of trigram bins, one column per language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        p = counts + 0.5
        p = p / p.sum(axis=0) if len(languages) else p
        self.logp = np.log(p).astype(np.float32)
        self.floor = -math.log(BINS)

    def score(self, text: str | None) -> tuple[int, np.ndarray]:
        n, total = 0, np.zeros(len(self.languages))
        for bins in trigrams(text):
            n += len(bins)
            total += self.logp[bins].sum(axis=0, dtype=np.float64)
        return n, total


def fit_text(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE) -> TextModel:
    """Counts trigrams of labelled documents, taken by a hash of id and text: of each language about
    sample over the number of languages, but PER_LANGUAGE at least, or all it has.  Every
    language with a label is learnt, of more than LANGUAGES names the most frequent ones."""
    rows = id_text(docs, F.col(lang).cast("string").alias("lang"), text=text, doc_id=doc_id).where("lang is not null")
    known = stored(rows.groupBy("lang").agg(F.count("*").alias("labelled")).orderBy(F.desc("labelled"), "lang").limit(LANGUAGES))
    quota = max(PER_LANGUAGE, sample // max(1, known.count()))
    share = known.select(F.col("lang").alias("known"), (F.lit(float(quota)) / F.col("labelled")).alias("share"))
    rows = rows.join(F.broadcast(share), F.col("lang") == F.col("known")).where(sampled(F.col("share"), "doc_id", "text")).select("doc_id", "text", "lang")  # share: a row per language

    def work(batches):
        sums, seen = {}, {}
        for b in batches:
            for t, l in zip(b["text"], b["lang"], strict=True):
                c = sums.setdefault(l, np.zeros(BINS, np.int64))
                seen[l] = seen.get(l, 0) + 1
                for bins in trigrams(t):
                    c += np.bincount(bins, minlength=BINS)
        for l, c in sums.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"lang": l, "bin": np.append(at, -1), "n": np.append(c[at], seen[l])})

    got = stored(rows.mapInPandas(work, "lang string, bin long, n long"), TEXT_ROWS).groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    kept = sorted(set(got["lang"]))
    counts = np.zeros((BINS, len(kept)))
    for k, l in enumerate(kept):
        g = got[(got["lang"] == l) & (got["bin"] >= 0)]
        counts[g["bin"], k] = g["n"]
    return TextModel(kept, counts)


def _smoothed(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """keys[0] -> array of log priors; keys are a host and its parents, most special first."""
    counts = F.array(*[F.count_if(F.col("vote") == k).cast("double") for k in range(n)])
    votes = rows.where("vote >= 0")
    prior = votes.agg(counts.alias("c")).select(F.transform("c", lambda x: (x + 1) / (F.aggregate("c", F.lit(0.0), lambda a, b: a + b) + n)).alias("p"))
    above: DataFrame | None = None
    for depth in range(len(keys) - 1, -1, -1):
        group = keys[depth:]
        mine = votes.where(F.col(group[0]).isNotNull()).groupBy(*group).agg(counts.alias("c"))
        joined = mine.crossJoin(F.broadcast(prior)) if above is None else mine.join(above, group[1:])  # prior: one row
        total = F.aggregate("c", F.lit(0.0), lambda a, b: a + b)
        mine = joined.select(*group, F.zip_with("c", "p", lambda x, q: (x + KAPPA * q) / (total + KAPPA)).alias("p"))
        above = mine
    return above.select(keys[0], F.transform("p", lambda x: F.log(x)).alias("prior"))


def _given(rows: DataFrame, key: str, n: int) -> DataFrame:
    """key -> array of log P(key | language), add-one smoothed."""
    counts = [F.count_if(F.col("vote") == k).cast("double") for k in range(n)]
    by = rows.where(F.col(key).isNotNull() & (F.col("vote") >= 0)).groupBy(key).agg(F.array(*counts).alias("c"))
    total = by.agg(F.array(*[F.sum(F.col("c")[k]) for k in range(n)]).alias("t"), F.count("*").cast("double").alias("kinds"))
    return by.crossJoin(F.broadcast(total)).select(key, F.zip_with("c", "t", lambda c, t: F.log((c + 1) / (t + F.col("kinds")))).alias(f"{key}_ll"))  # total: one row


def language_id(rows: DataFrame, model: TextModel) -> DataFrame:
    """id, language, posterior, rejected from doc_id, text, declared, suffix, host, domain, zone."""
    n, languages = len(model.languages), model.languages

    def work(batches):
        for b in batches:
            scores = [model.score(t) for t in b["text"]]
            ll = [s / 3 for _, s in scores]
            size = np.array([k for k, _ in scores], dtype=np.int64)
            vote = np.array([int(s.argmax()) if k and n else -1 for k, s in scores], dtype=np.int32)
            noise = np.array([k >= MIN_TRIGRAMS and float(s.max()) / k < model.floor if n else True for k, s in scores], dtype=bool)
            out = b.drop(columns=["text"])
            yield out.assign(ll=ll, size=size, vote=vote, noise=noise)

    cols = "doc_id long, declared string, suffix string, host string, domain string, zone string"
    told = rows.select("doc_id", "text", "declared", "suffix", "host", "domain", "zone")
    told = mapped(told, work, f"{cols}, ll array<double>, size long, vote int, noise boolean")
    zero = F.array(*[F.lit(0.0)] * max(1, n))
    add = lambda a, b: F.zip_with(a, F.coalesce(b, zero), lambda x, y: x + y)
    if n:
        told = told.join(_smoothed(told, ["host", "domain", "zone"], n), "host", "left")
        told = told.join(_given(told, "declared", n), "declared", "left").join(_given(told, "suffix", n), "suffix", "left")
        told = told.withColumn("all", add(add(add(F.col("ll"), F.col("prior")), F.col("declared_ll")), F.col("suffix_ll")))
    else:
        told = told.withColumn("all", zero)
    told = told.withColumn("top", F.array_max("all"))
    told = told.withColumn("posterior", 1 / F.aggregate("all", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    name = F.element_at(F.array(*[F.lit(x) for x in languages or [None]]), F.array_position("all", F.col("top")).cast("int"))
    rejected = (F.col("size") == 0) | F.col("noise") | (F.col("posterior") < MIN_POSTERIOR) | F.lit(n == 0)
    return told.select("doc_id", F.when(F.col("size") > 0, name).alias("language"), "posterior", rejected.alias("rejected"))


def document_rows(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """A document's source stands for its host; its letters for the domain."""
    none = F.lit(None).cast("string")
    host = F.col(source).cast("string")
    return id_text(docs, none.alias("declared"), none.alias("suffix"), host.alias("host"), F.regexp_replace(host, r"\d+$", "").alias("domain"), F.when(host.isNotNull(), "").alias("zone"), text=text, doc_id=doc_id)


def page_rows(pages: DataFrame) -> DataFrame:
    """Declared: the html tag's lang; suffix: last label of the host and a two-letter first folder; host, domain, zone from the url."""
    host, path = host_and_path(F.col("url"))
    html = F.coalesce("html", F.lit(""))
    label = F.element_at(F.split(host, r"\."), -1)
    folder = F.regexp_extract(path, r"^/([a-z]{2})(?:/|$)", 1)
    blank = lambda c: F.when(c != "", c)
    declared = blank(F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)))
    body = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#\w]+;", " ")
    return pages.select(
        F.col("page_id").cast("long").alias("doc_id"), body.alias("text"), declared.alias("declared"), blank(F.concat_ws("/", label, folder)).alias("suffix"),
        blank(host).alias("host"), blank(F.regexp_extract(host, r"([^.]*\.)?[^.]*$", 0)).alias("domain"), blank(label).alias("zone"),
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id(document_rows(docs), fit_text(docs))


def op6_pages_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit_text(table(spark, sf_dir, "documents"))
    return language_id(page_rows(table(spark, sf_dir, "pages")), model).withColumnRenamed("doc_id", "page_id")
