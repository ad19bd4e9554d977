"""Operator 2: quality rules with host verdicts, in DataFrame functions alone.

Each document gets base measures in one narrow pass. Failures are counted by host (one row
per host and task before the shuffle), hosts' rates are shrunk by a beta prior fitted to all
hosts by moments, and the verdicts join back to the documents. A host is rejected, with all its
documents, when its posterior rate lies above a bar with probability CERTAINTY (normal
approximation of the beta posterior): BAR_TIMES the overall rate, but no less than LEAST_BAR and
no more than MOST_BAR. So a host must fail far more often than the corpus, on enough documents,
and a corpus that fails often does not excuse one that fails mostly. A host that holds a third of
all rows costs no more than another: its rows are summed before the shuffle, and the join
back is broadcast if Spark finds the host table small, else split by AQE where skewed.

Defined results: null text has no words and fails; null host is a host of its own; an empty
table gives an empty table; repeated rows count each time; the stage keeps all columns of its
documents as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lucera.llm.common import SPACES, Work, table, whole_rows, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: A host is rejected when its failure rate is above the bar with this certainty (5 % of a normal lies beyond DEVIATIONS).
CERTAINTY, DEVIATIONS = 0.95, 1.644854
BAR_TIMES, LEAST_BAR, MOST_BAR = 3.0, 0.2, 0.5
#: Bounds of the prior's weight in documents.
MIN_PRIOR, MAX_PRIOR = 2.0, 1000.0

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _window_hashes(h: Column, n: Column) -> Column:
    """Sorted (hash, position) of each 8-word window."""
    windows = F.transform(
        F.slice(h, 1, F.greatest(n - (WINDOW - 1), F.lit(0))),
        lambda x, i: F.struct(F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)]).alias("h"), i.alias("p")),
    )
    return F.sort_array(windows)


def _repeated(w: Column) -> Column:
    """Positions, ascending, of windows whose hash another window shares."""
    same = F.filter(w, lambda x, i: (x["h"] == F.get(w, i - 1)["h"]) | (x["h"] == F.get(w, i + 1)["h"]))
    return F.sort_array(F.transform(same, lambda x: x["p"]))


def _covered(p: Column) -> Column:
    """Words under windows that start at these ascending positions."""
    gaps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
    return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base measures and base_failed. Window hashes have 64 bits, compared within one text."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_w", words_of(F.col(text)))
    df = df.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x))).withColumn("n_words", F.size("_w").cast("long"))
    df = df.withColumn("_s", _window_hashes(F.col("_h"), F.col("n_words").cast("int"))).drop("_h", "_w")
    df = df.withColumn("_p", _repeated(F.col("_s"))).drop("_s")
    df = df.withColumn("_l", F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\t-\\r]")))
    df = (
        df.withColumn("word_chars", F.length(F.translate(t, SPACES, "")).cast("long"))
        .withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
        .withColumn("n_repeat_words", _covered(F.col("_p")).cast("long"))
        .drop("_l", "_p")
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def host_rates(measured: DataFrame, host: str = "source") -> DataFrame:
    """One row per host: _host, host_docs, host_failures, host_rate (posterior mean), host_low (what the
    rate exceeds with CERTAINTY), host_bar.

    With p the overall rate, the prior is Beta(p k, (1 - p) k). k follows from the excess of
    the hosts' rates' weighted variance over the binomial one, within fixed bounds.
    """
    hosts = measured.groupBy(F.col(host).alias("_host")).agg(
        F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failures")
    )
    n, f = F.col("host_docs"), F.col("host_failures")
    total = hosts.agg(
        F.sum(n).alias("_n"), F.sum(f).alias("_f"), F.count(F.lit(1)).alias("_k"),
        F.sum(f * f / n).alias("_ss"), F.sum((n * n).cast("double")).alias("_nn"),
    )
    p = F.col("_f") / F.col("_n")
    # between-host variance by moments: (sum n (r-p)^2 - (k-1) p(1-p)) / (N - sum n^2 / N)
    spread = F.col("_ss") - F.col("_n") * p * p
    between = F.try_divide(spread - (F.col("_k") - 1) * p * (1 - p), F.col("_n") - F.col("_nn") / F.col("_n"))
    weight = F.when(between > 0, F.greatest(F.lit(MIN_PRIOR), F.least(F.lit(MAX_PRIOR), p * (1 - p) / between - 1)))
    prior = total.select(p.alias("_p"), F.coalesce(weight, F.lit(MAX_PRIOR)).alias("_w"))
    rate = (f + F.col("_p") * F.col("_w")) / (n + F.col("_w"))
    low = rate - DEVIATIONS * F.sqrt(rate * (1 - rate) / (n + F.col("_w") + 1))
    bar = F.greatest(F.lit(LEAST_BAR), F.least(F.lit(MOST_BAR), BAR_TIMES * F.col("_p")))
    # the prior is one row
    return hosts.crossJoin(F.broadcast(prior)).select(
        "_host", "host_docs", "host_failures", F.round(rate, 6).alias("host_rate"), F.round(low, 6).alias("host_low"), F.round(bar, 6).alias("host_bar")
    )


def with_verdicts(measured: DataFrame, work: Work, host: str = "source") -> DataFrame:
    """Joins the hosts' shrunk rates to the measured documents and sets kept. The rates are written
    first: Spark knows their size when it chooses between broadcast and shuffle."""
    rates = work.save(host_rates(measured, host), "rates")
    joined = measured.join(rates, F.col(host).eqNullSafe(rates["_host"]), "left").drop("_host")
    return joined.withColumn("kept", ~F.col("base_failed") & ~(F.col("host_low") > F.col("host_bar")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    work = Work(spark, "op2")
    measured = work.save(with_measures(docs.select("doc_id", "source", "text")).drop("text"), "measured")
    return with_verdicts(measured, work).select("doc_id", *MEASURES, "base_failed", "kept", "source", "host_docs", "host_failures", "host_rate", "host_low", "host_bar")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents that the rules reject go, for their own measures or their host's verdict. The
    columns of docs stay as they are, also those named like a measure; null texts go, as in op2."""
    work = Work(spark, "rules")
    measured = work.save(with_measures(whole_rows(docs), "_row.text"), "measured")
    return with_verdicts(measured, work, "_row.source").filter("kept").select("_row.*")


ORACLE_MEASURES = r"""
d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i+7], ' ') AS k
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY rid),
m AS (SELECT w.rid, doc_id, source, len(ws) AS n_words,
             CAST(list_sum(list_transform(ws, lambda x: length(x))) AS BIGINT) AS word_chars0,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
      FROM w LEFT JOIN cov ON w.rid = cov.rid),
b AS (SELECT *, coalesce(word_chars0, 0) AS word_chars, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m),
h AS (SELECT source AS hs, count(*) AS n, count(*) FILTER (WHERE base_failed) AS f FROM b GROUP BY source),
tot AS (SELECT sum(n)::DOUBLE AS tn, sum(f)::DOUBLE AS tf, count(*)::DOUBLE AS k, sum(f * f / n) AS ss, sum((n * n)::DOUBLE) AS nn FROM h),
pr AS (SELECT tf / tn AS p, tn, k, ss, nn FROM tot),
pv AS (SELECT p, CASE WHEN tn - nn / tn <> 0 THEN (ss - tn * p * p - (k - 1) * p * (1 - p)) / (tn - nn / tn) END AS v FROM pr),
pw AS (SELECT p, coalesce(CASE WHEN v > 0 THEN greatest(2.0, least(1000.0, p * (1 - p) / v - 1)) END, 1000.0)::DOUBLE AS w FROM pv),
hp AS (SELECT hs, n, f, (f + p * w) / (n + w) AS rate, n + w + 1 AS m, greatest(0.2, least(0.5, 3.0 * p))::DOUBLE AS bar FROM h, pw),
hr AS (SELECT hs, n, f, round(rate, 6) AS rate, round(rate - 1.644854::DOUBLE * sqrt(rate * (1 - rate) / m), 6) AS low, round(bar, 6) AS bar FROM hp),
q AS (SELECT b.*, hr.n AS host_docs, hr.f AS host_failures, rate AS host_rate, low AS host_low, bar AS host_bar, (NOT base_failed AND NOT low > bar) AS kept
      FROM b JOIN hr ON b.source IS NOT DISTINCT FROM hr.hs)
"""

ORACLE = f"""WITH {ORACLE_MEASURES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, source, host_docs, host_failures, host_rate, host_low, host_bar FROM q"""
