"""Quality scores by hierarchical empirical Bayes.

A document's own evidence comes from a classifier of bounded size: the tokens
whose presence tells bad documents from good ones most surely, near copies counted once. Its site adds a
prior: the share of bad labels of its path, shrunk to that of its host, which is
shrunk to that of all hosts. How strongly sparse sites are shrunk is estimated
from the spread between sites by grouped aggregation. Prior and evidence meet
in log odds. A document's own label is left out of the counts of its path and host, so that
its score says the same as that of a document without a label.

The labelled documents that the classifier is fitted on are a bounded sample
(``fit_rows``, drawn row by row at a rate that the count of labels sets); site
counts cover all labels and scores all documents, each over its whole text. Evidence is kept within ``EVIDENCE_LIMIT``
log odds (one in 3,000): tokens of one text go together, and their sum would claim more certainty than there is.
"""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.operators.staging import stage

FIT_ROWS = 20_000
FEATURES = 2048
LEAST_EVIDENCE = 30.0
LEAST_ODDS = 1.5
EVIDENCE_LIMIT = 8.0
_TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]+")


@lru_cache(maxsize=1)
def _case() -> np.ndarray:
    """1 for each capital, -1 for each small letter, 0 for the other characters."""
    every = list(map(chr, range(0x110000)))
    return np.fromiter(map(str.isupper, every), np.int8, len(every)) - np.fromiter(map(str.islower, every), np.int8, len(every))


def tokens(text: str | None) -> set[str]:
    """Different tokens of a text: words in lower case, runs of marks, a sign of shouting if over half of its cased letters are capitals, and one of stammering if a fifth of its words repeat the one before."""
    if not text:
        return set()
    found = {t.lower() for t in _TOKEN.findall(text)}
    if _case()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].sum(dtype=np.int64) > 0:
        found.add("\x00shout")
    words = text.split()
    if 5 * sum(map(operator.eq, words, words[1:])) > len(words):
        found.add("\x00stammer")
    return found


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, good, bad) of each task's labelled documents, written out whenever the table has grown large."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        names = sorted(counts[0].keys() | counts[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[t] for t in names], pa.int64()) for c in counts)], ["token", "good", "bad"])

    for batch in batches:
        for text, bad in zip(batch.column(0), batch.column(1), strict=True):
            counts[bad.as_py()].update(tokens(text.as_py()))
            if len(counts[0]) + len(counts[1]) > 500_000:
                yield out()
                counts = (Counter(), Counter())
    yield out()


def _signature(text: str | None) -> int:
    """The least hash of a text's five-word runs, which near copies mostly share."""
    words = (text or "").split()
    runs = (" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))
    return min(xxhash.xxh64_intdigest(r) for r in runs) >> 1


def _one_of_copies(sample: DataFrame) -> DataFrame:
    """One of the rows (text, bad) whose texts share a signature: copies are no evidence of their own."""

    @F.arrow_udf("long")
    def signature(batch: pa.Array) -> pa.Array:
        return pa.array([_signature(x) for x in batch.to_pylist()], pa.int64())

    row = F.min_by(F.struct("text", "bad"), F.struct(F.xxhash64("text"), F.col("bad")))
    return sample.withColumn("_sign", signature("text")).groupBy("_sign").agg(row.alias("row")).select("row.text", "row.bad")


def fit_evidence(
    labelled: DataFrame, text_col: str = "text", bad_col: str = "bad", id_col: str | None = None, fit_rows: int = FIT_ROWS, features: int = FEATURES, least_evidence: float = LEAST_EVIDENCE, least_odds: float = LEAST_ODDS
) -> dict[str, float]:
    """Log odds of each chosen token for rows (text, bad).

    About ``fit_rows`` rows are drawn, each by hash of its id and text, so that no text comes in as a whole. At most ``features`` tokens,
    those with the largest log-likelihood ratio, of at least ``least_evidence``; tokens with
    odds below ``least_odds`` either way are left out, as many weak ones that go together would count as strong.
    """
    total, bad = labelled.agg(F.count("*"), F.coalesce(F.sum(bad_col), F.lit(0))).first()
    if not bad or bad == total:
        return {}
    row = [F.coalesce(F.col(text_col), F.lit("")), *([F.col(id_col)] if id_col else [])]
    drawn = F.pmod(F.xxhash64(*row, F.lit("fit")), F.lit(1 << 40)) / float(1 << 40)
    sample = labelled.where(drawn < min(1.0, fit_rows / total)).select(F.col(text_col).alias("text"), F.col(bad_col).cast("int").alias("bad"))
    sample = stage(_one_of_copies(sample), "fit-rows")
    n, n_bad = sample.agg(F.count("*"), F.coalesce(F.sum("bad"), F.lit(0))).first()
    n_good = n - n_bad
    if not n_good or not n_bad:
        return {}
    counts = sample.mapInArrow(_token_counts, "token string, good long, bad long").groupBy("token").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    seen = F.col("good") + F.col("bad")
    term = lambda found, of: F.when(found > 0, found * F.log(found / of)).otherwise(0.0)
    present = term(F.col("bad"), seen * (n_bad / n)) + term(F.col("good"), seen * (n_good / n))
    absent = term(n_bad - F.col("bad"), (n - seen) * (n_bad / n)) + term(n_good - F.col("good"), (n - seen) * (n_good / n))
    ratio = 2 * (present + F.when(seen < n, absent).otherwise(0.0))
    odds = F.log(((F.col("bad") + 0.5) / (n_bad + 1.0)) / ((F.col("good") + 0.5) / (n_good + 1.0)))
    best = counts.select("token", ratio.alias("ratio"), odds.alias("odds")).where((F.col("ratio") >= least_evidence) & (F.abs("odds") >= least_odds)).orderBy(F.col("ratio").desc(), "token").limit(features)
    return {r["token"]: r["odds"] for r in best.collect()}


def evidence(text: str, weights: dict[str, float]) -> Column:
    """Log odds that a text is bad by the tokens it has, within a limit."""
    known = frozenset(weights)

    @F.arrow_udf("double")
    def score(batch: pa.Array) -> pa.Array:
        out = np.array([sum(weights[t] for t in sorted(tokens(x) & known)) for x in batch.to_pylist()], float)
        return pa.array(np.clip(out, -EVIDENCE_LIMIT, EVIDENCE_LIMIT), pa.float64())

    return score(F.col(f"`{text}`").cast("string"))


def _strength(rates: DataFrame, prior: str, n: str = "n", bad: str = "bad") -> float:
    """Labels that a prior counts for, by the method of moments: the less sites differ beyond chance, the more."""
    p = F.col(prior)
    chance = p * (1 - p)
    spread = F.col(n) * (F.col(bad) / F.col(n) - p) * (F.col(bad) / F.col(n) - p)
    groups, total, squares, found, expected = rates.where(F.col(n) > 0).agg(
        F.count("*"), F.sum(n), F.sum(F.col(n) * F.col(n)), F.sum(spread), F.sum(chance)
    ).first()
    if not groups or groups < 2:
        return 10.0
    room = (total - squares / total) * expected / groups
    between = max(0.0, (found - expected) / room) if room > 0 else 0.0
    return float(min(1000.0, max(1.0, 1 / between - 1))) if between > 0 else 1000.0


def site_priors(labelled: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """Counts (host, path, n, bad, host_n, host_bad) of all sites from rows (host, path, bad), and the strengths and rate that priors need."""
    by_path = stage(labelled.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("bad").cast("long").alias("bad")), "by-path")
    total, bad = by_path.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    overall = (bad + 1) / (total + 2)
    by_host = by_path.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("bad").alias("host_bad"))
    by_host = stage(by_host, "by-host")
    m = _strength(by_host.withColumn("prior", F.lit(overall)), "prior", "host_n", "host_bad")
    hosts = by_host.select(F.col("host").alias("_host"), "host_n", "host_bad")
    paths = stage(by_path.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host"), "paths")
    how = {"overall": overall, "host_strength": m}
    how["path_strength"] = _strength(paths.withColumn("prior", _host_prior(how)), "prior")
    return paths, how


def _host_prior(how: dict[str, float], own: Column | int = 0, known: Column | int = 0) -> Column:
    """Share of bad labels of a host, without ``known`` labels of which ``own`` are bad."""
    return (F.col("host_bad") - own + F.lit(how["host_strength"] * how["overall"])) / (F.col("host_n") - known + F.lit(how["host_strength"]))


def quality_scores(docs: DataFrame, labels: DataFrame, sites: DataFrame, limit: float = 0.5, **fit) -> DataFrame:
    """One row per document: (doc_id, host, path, evidence, prior, score, keep).

    ``docs`` has (doc_id, text), ``labels`` (doc_id, quality, toxic), of which bad ones have
    quality 0 or toxic 1, and ``sites`` (doc_id, host, path). ``score`` is the probability that
    a document is good, ``keep`` whether that is above ``limit``. An unlabelled path takes its host's
    prior, an unlabelled host that of all; a document without a site has null host and path, which are a
    site of their own. Labels with both columns null are ignored; a document with
    several labels is bad if one says so, one with several sites belongs to the first. The label of a document is left out of its own prior. Null and empty texts
    have no evidence. Repeated rows each come back, a null id has no label. Without labels of both kinds
    evidence is 0. Empty tables give an empty result; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    is_bad = F.greatest(F.when(F.col("quality") == 0, 1).when(F.col("quality").isNotNull(), 0), F.col("toxic").cast("int"))
    known = labels.select(F.col("doc_id").cast("long").alias("_doc"), is_bad.alias("bad")).where("_doc is not null and bad is not null").groupBy("_doc").agg(F.max("bad").alias("bad"))
    site = sites.select(F.col("doc_id").cast("long").alias("_id"), F.struct("host", "path").alias("site")).where("_id is not null").groupBy("_id").agg(F.min("site").alias("site"))
    site = stage(site.select("_id", "site.host", "site.path"), "sites")
    known = stage(known, "labels")
    # Labels are drawn before they meet the texts, so that few texts travel; the rows are drawn again from those.
    share = min(1.0, 1.2 * fit.get("fit_rows", FIT_ROWS) / max(1, known.count()))
    some = known if share == 1.0 else stage(known.where(F.pmod(F.xxhash64("_doc", F.lit("label")), F.lit(1 << 40)) < int(share * (1 << 40))), "drawn-labels")
    weights = fit_evidence(rows.join(some, F.col("doc_id") == F.col("_doc")).select("doc_id", "text", "bad"), id_col="doc_id", **fit)
    seen = rows.select("doc_id").join(known, F.col("doc_id") == F.col("_doc")).join(site, F.col("doc_id") == F.col("_id"), "left")
    sites_seen, how = site_priors(seen.select("host", "path", "bad"))
    of_path = sites_seen.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "n", F.col("bad").alias("path_bad"))
    of_host = stage(sites_seen.groupBy(F.col("host").alias("_hh")).agg(F.first("host_n").alias("host_n"), F.first("host_bad").alias("host_bad")), "hosts")
    own = rows.select("doc_id", evidence("text", weights).alias("evidence")).join(site, F.col("doc_id") == F.col("_id"), "left")
    own = own.join(known.select("_doc", F.col("bad").alias("own")), F.col("doc_id") == F.col("_doc"), "left")
    own = own.join(of_path, F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")), "left").join(of_host, F.col("host").eqNullSafe(F.col("_hh")), "left")
    is_known, is_bad = F.col("own").isNotNull().cast("int"), F.coalesce("own", F.lit(0))
    host_prior = F.coalesce(_host_prior(how, is_bad, is_known), F.lit(how["overall"]))
    strength = F.lit(how["path_strength"])
    prior = F.coalesce((F.col("path_bad") - is_bad + strength * host_prior) / (F.col("n") - is_known + strength), host_prior)
    score = 1 / (1 + F.exp(F.log(prior / (1 - prior)) + F.col("evidence")))
    return own.select("doc_id", "host", "path", "evidence", prior.alias("prior"), score.alias("score"), (score > limit).alias("keep"))
