"""URL verdicts from rules and from a tree of path templates.

Per host, the segments of a path form a tree. Going down it, a segment with a digit
becomes a wildcard, and so does any segment that fewer than ``support``
pages share under its parent or that has no labels. Siblings are then compared by their counts: each stands
in one of ``BANDS`` bands by its share of bad labels, shrunk to its parent's; neighbouring bands whose shares do not
differ beyond chance are one group, and a group of several siblings is one branch. The paths that
remain are templates. A template is rejected when its smoothed purity, the share
of bad labels shrunk to its host's and that to the whole table's, passes a limit.

Everything is DataFrame functions: levels are aggregates of distinct templates,
not of pages, so a host with a third of all pages is summed up before it moves, and windows hold one parent's bands.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.operators.staging import release, stage

WILDCARD = "*"
BANDS = 64
#: (verdict, host and path)
Rules = Sequence[tuple[str, str]]


def url_host(url: str) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty without one."""
    host = F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: str) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Rules) -> Column:
    """The longest rule that fits, as (rule, verdict); null where none does.

    ``rules`` is a policy list of a few thousand entries at most, which every plan carries.
    """
    if not rules:
        return F.lit(None).cast("struct<rule string, verdict string>")
    found = None
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        this = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, this) if found is None else F.when(fits, this).otherwise(found)
    return found


def branch_names(children: DataFrame, support: int, z: float, weight: float) -> DataFrame:
    """(_h, _t, _s, _name) for rows (host, _template, _segment, n, labelled, bad): what each segment is called below its parent.

    A group of alike siblings that takes in the wildcard, or all siblings there are, is the wildcard; a sibling alone keeps its segment; other groups are numbered.
    """
    plain = F.when((F.col("n") < support) | (F.col("labelled") == 0), F.lit(WILDCARD)).otherwise(F.col("_segment"))
    keys = ("host", "_template")
    sums = [F.sum(c).alias(c) for c in ("labelled", "bad")]
    children = children.withColumn("_plain", plain)
    parent = children.groupBy(*[F.col(k).alias(f"_of{k}") for k in keys]).agg(F.sum("labelled").alias("_all"), F.sum("bad").alias("_all_bad"))
    member = children.groupBy(*keys, "_plain").agg(*sums).where("labelled > 0")
    rate = (F.col("_all_bad") + 1) / (F.col("_all") + 2)
    share = (F.col("bad") + F.lit(weight) * rate) / (F.col("labelled") + F.lit(weight))
    member = member.join(parent, (F.col("host") == F.col("_ofhost")) & (F.col("_template") == F.col("_of_template")))
    member = member.withColumn("_band", F.least(F.floor(share * BANDS), F.lit(BANDS - 1)).cast("int"))
    bands = member.groupBy(*keys, "_band").agg(*sums, F.count("*").alias("_members"), F.min("_plain").alias("_first"), F.max((F.col("_plain") == WILDCARD).cast("int")).alias("_wild"))
    along = Window.partitionBy(*keys).orderBy("_band")
    labelled, bad = F.lag("labelled").over(along), F.lag("bad").over(along)
    pooled = (F.col("bad") + bad + 1) / (F.col("labelled") + labelled + 2)
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / labelled))
    parts = F.coalesce(F.abs(F.col("bad") / F.col("labelled") - bad / labelled) > F.lit(z) * error, F.lit(False))
    bands = bands.withColumn("_parts", parts.cast("int")).withColumn("_group", F.sum("_parts").over(along))
    group, whole = Window.partitionBy(*keys, "_group"), Window.partitionBy(*keys)
    name = (
        F.when((F.max("_wild").over(group) == 1) | (F.max("_group").over(whole) == 0), F.lit(WILDCARD))
        .when(F.sum("_members").over(group) == 1, F.min("_first").over(group))
        .otherwise(F.concat(F.lit(WILDCARD), F.col("_group").cast("string")))
    )
    bands = bands.select(F.col("host").alias("_bh"), F.col("_template").alias("_bt"), F.col("_band").alias("_bb"), name.alias("_name"))
    named = member.join(bands, (F.col("host") == F.col("_bh")) & (F.col("_template") == F.col("_bt")) & (F.col("_band") == F.col("_bb")))
    named = named.select(F.col("host").alias("_h"), F.col("_template").alias("_t"), F.col("_plain").alias("_p"), "_name")
    met = children.join(named, (F.col("host") == F.col("_h")) & (F.col("_template") == F.col("_t")) & (F.col("_plain") == F.col("_p")), "left")
    return met.select(F.col("host").alias("_h"), F.col("_template").alias("_t"), F.col("_segment").alias("_s"), F.coalesce("_name", F.lit(WILDCARD)).alias("_name"))


def path_templates(paths: DataFrame, depth: int | None, support: int, z: float, weight: float) -> DataFrame:
    """(host, path, template) for rows (host, path, n, labelled, bad) of distinct paths.

    Levels are told apart down to the longest path, or ``depth`` of them, with deeper segments as one more wildcard.
    A path leaves the loop when it has no segment left, or when the pages that share its template are fewer than ``support``
    or have no labels of both kinds: then whatever follows merges into wildcards.
    """
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    live = paths.withColumn("_parts", parts).withColumn("_template", F.lit("")).withColumn("_open", F.lit(True))
    size = F.size("_parts") if depth is None else F.least(F.size("_parts"), F.lit(depth + 1))
    done = []
    for level in count():
        ends = (size <= level) | F.lit(level == depth) | ~F.col("_open")
        template = F.concat("_template", F.repeat(F.lit("/" + WILDCARD), size - level))
        done.append(live.where(ends).select("host", "path", "n", "labelled", "bad", template.alias("template")))
        if level == depth or live.where(~ends).isEmpty():
            return reduce(DataFrame.unionByName, done)
        segment = F.get("_parts", F.lit(level))
        plain = F.when(segment.rlike("[0-9]"), F.lit(WILDCARD)).otherwise(segment)
        inner = stage(live.where(~ends).drop("_open").withColumn("_segment", plain), f"level-{level}")
        child = stage(inner.groupBy("host", "_template", "_segment").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")), f"children-{level}")
        names = stage(branch_names(child, support, z, weight), f"names-{level}")
        found = child.join(names, (F.col("host") == F.col("_h")) & (F.col("_template") == F.col("_t")) & (F.col("_segment") == F.col("_s")))
        group = found.groupBy(F.col("host").alias("_gh"), F.concat("_template", F.lit("/"), "_name").alias("_g")).agg(F.sum("n").alias("_n"), F.sum("labelled").alias("_labelled"), F.sum("bad").alias("_bad"))
        group = group.where((F.col("_n") >= support) & (F.col("_bad") > 0) & (F.col("_bad") < F.col("_labelled"))).select("_gh", "_g")
        met = inner.join(names, (F.col("host") == F.col("_h")) & (F.col("_template") == F.col("_t")) & (F.col("_segment") == F.col("_s")))
        met = met.withColumn("_template", F.concat("_template", F.lit("/"), "_name")).join(group, (F.col("host") == F.col("_gh")) & (F.col("_template") == F.col("_g")), "left")
        live = stage(met.withColumn("_open", F.col("_gh").isNotNull()).drop("_h", "_t", "_s", "_name", "_segment", "_gh", "_g"), f"placed-{level}")
        release(inner, child, names)


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: Rules = (),
    id_col: str = "page_id",
    url_col: str = "url",
    key: Column | None = None,
    depth: int | None = None,
    support: int = 20,
    z: float = 2.0,
    weight: float = 10.0,
    limit: float = 0.5,
) -> DataFrame:
    """One row per page: (page_id, host, path, rule, verdict, template, purity).

    ``labels`` has rows (key, bad); bad is 0, 1 or null. ``key`` is a page's key, an expression of its page_id, host and path (page_id
    where it is None). A key with several labels is bad if one of them is. ``weight`` is the number of labels that a prior counts for.
    Without any label the corpus prior is 0, so that only rules block; what has no label itself takes its host's prior, and a host the corpus's. A
    null url, or one without ``://``, has empty host and path, and is judged like others;
    rows that repeat a page each come back; an empty table gives an empty result. Other columns are ignored.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("_url")).select("page_id", url_host("_url").alias("host"), url_path("_url").alias("path"))
    own_key = (F.col("page_id") if key is None else key).cast("long").alias("_key")
    paths = rows.groupBy("host", "path", own_key).agg(F.count("*").alias("n"))
    known = labels.where("key is not null and bad is not null").groupBy(F.col("key").cast("long").alias("_label")).agg(F.max("bad").alias("_bad"))
    counted = paths.join(known, F.col("_key") == F.col("_label"), "left").select(
        "host", "path", "n", F.when(F.col("_bad").isNotNull(), F.col("n")).otherwise(0).cast("long").alias("labelled"), (F.coalesce("_bad", F.lit(0)) * F.col("n")).cast("long").alias("bad")
    )
    counted = stage(counted.groupBy("host", "path").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")]), "paths")
    placed = stage(path_templates(counted, depth, support, z, weight), "templates")
    by_template = placed.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    by_template = stage(by_template, "purity")
    total, bad = by_template.agg(F.coalesce(F.sum("labelled"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    prior = (bad + 1) / (total + 2) if total else 0.0
    by_host = by_template.groupBy(F.col("host").alias("_host")).agg(((F.sum("bad") + F.lit(weight * prior)) / (F.sum("labelled") + weight)).alias("_prior"))
    judged = by_template.join(by_host, F.col("host") == F.col("_host")).select(
        F.col("host").alias("_host"), F.col("template").alias("_template"), ((F.col("bad") + F.lit(weight) * F.col("_prior")) / (F.col("labelled") + weight)).alias("purity")
    )
    judged = stage(judged, "judged")
    per_path = placed.join(judged, (F.col("host") == F.col("_host")) & (F.col("template") == F.col("_template")))
    per_path = stage(per_path.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "template", "purity"), "verdicts")
    met = rows.join(per_path, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left")
    rule = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("purity") >= limit, F.lit("block")).otherwise(F.lit("allow"))
    return met.withColumn("_rule", rule).select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", own).alias("verdict"), "template", F.round("purity", 9).alias("purity"))
