"""URL filter with link-graph trust propagation.

Rules decide first.  For urls that no rule fits, trust and distrust are
propagated over the graph of hosts: personalised PageRank from hosts whose
pages the rules allow, and the same walk on reversed edges from hosts whose
pages the rules block (a host that links to blocked hosts is distrusted).
Both scores are thresholded per host.

Scores are whole numbers (parts per ``SCALE``), so sums do not depend on the
order of the rows and every rerun gives the same verdicts.  Shares are rounded
down, and what reaches a host without an edge to follow goes no further: both
only lower scores (a walk back to the seeds would raise all of them alike).

Defined cases: null urls, and urls without ``://``, have an empty host and path
and no rule; the empty host takes part in no edge and is allowed.  Null html
has no links.  Repeated rows are judged each.  Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, lower_ascii

SCALE = 1_000_000
#: Host of an absolute or scheme-relative link; other links stay on their host.
LINK_HOST = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    """``text`` is host plus path prefix, such as ``example.net/en/``."""

    action: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/"))


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty for null or where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def first_rule(host: Column, path: Column, rules: tuple[Rule, ...], field: str) -> Column:
    """The given field of the longest fitting rule, as one CASE expression; null if none fits."""
    picked = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        picked = F.when(fits, F.lit(getattr(rule, field))).otherwise(picked)
    return picked


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, action (of the rule, else null)."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    host, path = F.col("host"), F.col("path")
    return parts.select("*", first_rule(host, path, rules, "text").alias("rule"), first_rule(host, path, rules, "action").alias("action"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, pages): pages of src with a link to dst, for different non-empty hosts."""
    targets = F.array_distinct(F.regexp_extract_all(lower_ascii(F.col("html")), F.lit(LINK_HOST), 1))
    return (
        pages.select(host_of(F.col("url")).alias("src"), F.explode(targets).alias("dst"))
        .filter("src <> '' and dst <> '' and src <> dst")
        .groupBy("src", "dst")
        .agg(F.count("*").alias("pages"))
    )


def walk_edges(edges: DataFrame) -> DataFrame:
    """Trust goes along an edge, distrust against it; share is in parts per SCALE of what leaves a node."""
    both = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("from"), F.col("dst").alias("to"), "pages").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("from"), F.col("src").alias("to"), "pages")
    )
    total = both.groupBy("kind", "from").agg(F.sum("pages").alias("total"))
    return both.join(total, ["kind", "from"]).select("kind", "from", "to", F.expr(f"pages * {SCALE} div total").alias("share"))


def host_seeds(rated: DataFrame) -> DataFrame:
    """Per host and kind: the part of its pages that rules allow (trust) or block (distrust)."""
    counts = rated.filter("host <> ''").groupBy("host").agg(
        F.count("*").alias("n"), F.count_if(F.col("action") == "allow").alias("trust"), F.count_if(F.col("action") == "block").alias("distrust")
    )
    per_kind = F.expr("stack(2, 'trust', trust, 'distrust', distrust) as (kind, pages)")
    return counts.select("host", "n", per_kind).filter("pages > 0").select("kind", "host", F.expr(f"pages * {SCALE} div n").alias("score"))


def propagate(seeds: DataFrame, edges: DataFrame, damping_percent: int = 85, iterations: int | None = None) -> DataFrame:
    """(kind, host, score) of the personalised walk once nothing changes, or after ``iterations`` steps if given.

    From the seeds on no score ever falls, and whole numbers stop rising: equal totals mean that nothing changed.
    The product of a score and a share is taken in two parts, so it cannot overflow.
    """
    seeds, edges = checkpoint(seeds), checkpoint(walk_edges(edges))
    base = seeds.select("kind", "host", F.expr(f"score * {100 - damping_percent} div 100").alias("score"))
    scores = base
    if edges.isEmpty():
        return base
    total, step = None, 0
    while iterations is None or step < iterations:
        step += 1
        moved = scores.join(edges, (scores["kind"] == edges["kind"]) & (scores["host"] == edges["from"])).select(
            edges["kind"], F.col("to").alias("host"), F.expr(f"((score div {SCALE}) * share + (score % {SCALE}) * share div {SCALE}) * {damping_percent} div 100").alias("score")
        )
        scores = checkpoint(base.unionByName(moved).groupBy("kind", "host").agg(F.sum("score").alias("score")))
        before, total = total, scores.agg(F.count("*"), F.sum("score")).first()
        if total == before:
            break
    return scores


def host_verdicts(scores: DataFrame, damping_percent: int = 85, block_percent: int = 50) -> DataFrame:
    """(host, trust, distrust, blocked).

    A host is blocked when its distrust exceeds its trust by what ``block_percent``
    of its own pages being blocked would give a host without links.
    """
    limit = SCALE * (100 - damping_percent) // 100 * block_percent // 100
    kind = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0)).alias(k)
    return scores.groupBy("host").agg(kind("trust"), kind("distrust")).select("*", (F.col("distrust") - F.col("trust") >= limit).alias("blocked"))


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, damping_percent: int = 85, iterations: int | None = None, block_percent: int = 50) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    The last join carries no html and its smaller side holds one row per seeded or
    reached host; a host with a third of all pages is split by AQE's skew join.
    """
    rated = judged(pages, rules)
    scores = propagate(host_seeds(rated), host_edges(pages), damping_percent, iterations)
    verdicts = checkpoint(host_verdicts(scores, damping_percent, block_percent))
    by_method = F.when(F.coalesce("blocked", F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rated.join(verdicts, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("action", by_method).alias("verdict"), zero("trust"), zero("distrust"))


def filter_urls_sql(rules: tuple[Rule, ...] = RULES, damping_percent: int = 85, iterations: int = 10, block_percent: int = 50) -> str:
    """DuckDB SQL for ``filter_urls``, its walk unrolled."""
    rest = "case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    case = lambda f: "case " + " ".join(f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then '{getattr(r, f)}'" for r in ordered) + " end"
    link = LINK_HOST.replace("'", "''")
    ctes = [
        f"parts as (select page_id, html, {lower.format(f'regexp_extract({rest}, ' + chr(39) + '^([^/?#]*)' + chr(39) + ', 1)')} as host, regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) as path from pages)",
        f"rated as (select *, {case('text')} as rule, {case('action')} as action from parts)",
        f"links as (select page_id, host as src, unnest(list_distinct(regexp_extract_all({lower.format('html')}, '{link}', 1))) as dst from rated)",
        "edges as (select src, dst, count(*) as pages from links where src <> '' and dst <> '' and src <> dst group by all)",
        'ways as (select \'trust\' as kind, src as f, dst as t, pages from edges union all select \'distrust\', dst, src, pages from edges)',
        f"walk as (select kind, f, t, cast(pages * {SCALE} // sum(pages) over (partition by kind, f) as bigint) as share from ways)",
        f"seeds as (select 'trust' as kind, host, count(*) filter (action = 'allow') * {SCALE} // count(*) as score from rated where host <> '' group by host union all select 'distrust', host, count(*) filter (action = 'block') * {SCALE} // count(*) from rated where host <> '' group by host)",
        f"base as (select kind, host, cast(score * {100 - damping_percent} // 100 as bigint) as score from seeds where score > 0)",
        "s0 as (select * from base)",
    ]
    for i in range(iterations):
        step = f"((score // {SCALE}) * share + (score % {SCALE}) * share // {SCALE}) * {damping_percent} // 100"
        ctes.append(f"s{i + 1} as (select kind, host, cast(sum(score) as bigint) as score from (select kind, host, score from base union all select w.kind, t, {step} from s{i} s join walk w on s.kind = w.kind and s.host = w.f) group by kind, host)")
    limit = SCALE * (100 - damping_percent) // 100 * block_percent // 100
    ctes.append(f"v as (select host, coalesce(sum(score) filter (kind = 'trust'), 0) as trust, coalesce(sum(score) filter (kind = 'distrust'), 0) as distrust from s{iterations} group by host)")
    return (
        "with " + ",\n".join(ctes) + f"\nselect page_id, host, path, rule, coalesce(action, case when distrust - trust >= {limit} then 'block' else 'allow' end) as verdict, "
        "cast(coalesce(trust, 0) as bigint) as trust, cast(coalesce(distrust, 0) as bigint) as distrust from rated left join v using (host)"
    )
