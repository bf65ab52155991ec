"""Quality rules judged by host: failures by domain, shrunk by an empirical beta prior, joined back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, stored

#: rule -> test on the measures below
RULES = {
    "few_words": "words < 5",
    "long_words": "chars > 15 * words and words > 0",
    "symbols": "symbols > 0.10 * chars",
    "capitals": "capitals > 0.50 * chars",
    "digits": "digits > 0.30 * chars",
    "same_lines": "lines >= 4 and 10 * distinct_lines < 7 * lines",
    "same_words": "words >= 50 and 5 * distinct_words < words",
    "bare_marks": "words >= 10 and 5 * bare_marks > words",
}
#: Rules whose failure alone condemns a document; the others also meet short notes, tables and long names.
STRONG = ("symbols", "capitals", "same_lines", "same_words", "bare_marks")


def host_of(url: Column) -> Column:
    """The host of an address, in lower case, without user and port; '' where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def measures(text: Column) -> dict[str, Column]:
    """Counts that the rules compare, all evaluated on the JVM; a null text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    lines = F.split(t, "\n")
    return {
        "chars": F.length(t),
        "words": F.size(found),
        "distinct_words": F.size(F.array_distinct(found)),
        "symbols": F.regexp_count(t, F.lit(r"[#$%&*{}<>|~^!]")),
        "capitals": F.regexp_count(t, F.lit("[A-Z]")),
        "digits": F.regexp_count(t, F.lit("[0-9]")),
        # words without letters and digits, as the separators of tables are
        "bare_marks": F.regexp_count(t, F.lit(r"(?<![^ \t\n\x0B\f\r])[^\p{L}\p{N} \t\n\x0B\f\r]++(?![^ \t\n\x0B\f\r])")),
        "lines": F.size(lines),
        "distinct_lines": F.size(F.array_distinct(lines)),
    }


def host_rules(df: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str | Column = "source", blocked_at: float = 0.5, deviations: float = 3.0, fails: int = 2) -> DataFrame:
    """Judge every document by its own failures and by its host: doc_id, host, n_failed, host_rate, host_verdict, keep.

    For each rule, hosts' failure rates give a beta prior by moments (mean m and variance v over hosts; prior
    weight m(1-m)/v - 1). A host's rate is its posterior mean, so a host with few documents stays near the mean; its floor is
    that mean less ``deviations`` posterior standard deviations. host_rate is the highest rate over the rules. A host
    is "blocked", and all its documents go, where a floor is above ``blocked_at``; it is "strict", and any failure is
    enough, where a floor is above the prior's mean, so that it is worse than other hosts beyond chance; otherwise it is
    "open", and a document goes at one failure of a rule in STRONG or at ``fails`` failures in all.

    The prior's weight is held within 1 and 10,000: 1 is a single document, less would let one document outweigh all
    other hosts; at 10,000, which also stands for hosts that don't differ, a host of 10,000 documents still counts for half.

    Null hosts are one host ''. Null and empty texts fail few_words alone. Very long texts are measured whole. Repeated rows
    count each; equal rates and counts need no order. An empty table gives no rows. Only the three named columns are read; ``host`` may
    be an expression such as host_of("url"). Only narrow rows are exchanged; the table of hosts is joined by whichever way its size at run time allows.
    """
    m = measures(F.col("__text"))
    judged = (
        df.select(F.col(doc_id).alias("doc_id"), F.coalesce((F.col(host) if isinstance(host, str) else host).cast("string"), F.lit("")).alias("host"), F.col(text).alias("__text"))
        .select("doc_id", "host", *[c.alias(n) for n, c in m.items()])
        .select("doc_id", "host", *[F.coalesce(F.expr(test), F.lit(False)).cast("int").alias(rule) for rule, test in RULES.items()])
    )
    flags = stored(judged, "rule-flags")  # texts are measured once, for the hosts and for the documents
    hosts = flags.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.sum(r).alias(r) for r in RULES])
    # two numbers a rule, taken to the driver so that the table of hosts keeps the size it has at run time
    stats = hosts.agg(*[e for r in RULES for e in (F.avg(F.col(r) / F.col("n")).alias(f"m_{r}"), F.var_pop(F.col(r) / F.col("n")).alias(f"v_{r}"))]).first()
    rates, floors = [], []
    for r in RULES:
        mean, var = stats[f"m_{r}"] or 0.0, stats[f"v_{r}"] or 0.0
        weight = min(max(mean * (1 - mean) / var - 1, 1.0), 10000.0) if var > 1e-12 else 10000.0
        rate = (F.col(r) + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
        rates.append(rate)
        floors.append((rate - deviations * F.sqrt(rate * (1 - rate) / (F.col("n") + F.lit(weight + 1))), mean))
    verdict = F.when(F.greatest(*[f for f, _ in floors]) > blocked_at, "blocked").when(reduce(lambda a, b: a | b, [f > m for f, m in floors]), "strict").otherwise("open")
    rated = hosts.select("host", F.round(F.greatest(*rates), 6).alias("host_rate"), verdict.alias("host_verdict"))
    add = lambda rules: reduce(lambda a, b: a + b, [F.col(r) for r in rules])
    failed, strong = F.col("n_failed"), F.col("n_strong")
    keep = F.when(F.col("host_verdict") == "blocked", F.lit(False)).when(F.col("host_verdict") == "strict", failed == 0).otherwise((strong == 0) & (failed < fails))
    return (
        flags.select("doc_id", "host", add(RULES).alias("n_failed"), add(STRONG).alias("n_strong")).join(rated, "host")
        .select("doc_id", "host", "n_failed", "host_rate", "host_verdict", keep.alias("keep"))
    )
