"""URL filters: rules first, then a path-template tree for each host. DataFrame operations only.

All segments of a path are walked. Segments that look like ids, and names of little support under their node, become
wildcards. Pages that a rule judges are the labelled ones. At every level up to the host, a branch whose share of blocked
pages does not differ from that of its siblings is merged with them, branches that do differ in the same way are merged
with each other, and a template is rejected by the smoothed share of blocked in all that was merged with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewave.llm._shared import Scratch
from tidewave.llm.skew import spread_join

#: (verdict, rule): the rule's host, and from its first slash on its path.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: Rules become one expression; more than this need another form of matching.
MAX_RULES = 500
LONG_SEGMENT = 24
Z, WEIGHT, PRIOR, CUT = 1.96, 4.0, 0.2, 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty for null and where there is no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def _judged(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        of, _, rest = rule.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _prefixes(paths: DataFrame, segments: str, first: int) -> DataFrame:
    """paths with one row for each prefix of the segments, of `first` or more: depth, node, parent (null for the host)."""
    cut = lambda d: F.array_join(F.slice(segments, 1, d), "/")
    depths = F.filter(F.sequence(F.lit(0), F.size(segments)), lambda d: d >= first)
    x = paths.withColumn("at", F.explode(F.transform(depths, lambda d: F.struct(d.alias("depth"), cut(d).alias("node"), F.when(d > 0, cut(F.greatest(d - 1, F.lit(0)))).alias("parent")))))
    return x.select(*paths.columns, "at.*")


def _share(k: Column, m: Column) -> Column:
    return k / F.greatest(m, F.lit(1))


def _differ(k: Column, m: Column, all_k: Column, all_m: Column) -> Column:
    """Whether k of m differs from the rest of all_k of all_m, by a test of two proportions. False without a rest."""
    p = _share(all_k, all_m)
    deviation = F.sqrt(p * (1 - p) * (1 / F.greatest(m, F.lit(1)) + 1 / F.greatest(all_m - m, F.lit(1))))
    return (all_m > m) & (m > 0) & (F.abs(_share(k, m) - _share(all_k - k, all_m - m)) > Z * deviation)


def _nodes(paths: DataFrame, segments: str) -> DataFrame:
    """host, node, parent, n, pn (pages of the node's subtree and of its parent's), m, k (labelled, blocked), apart and side.

    A node stands apart if its share of blocked differs from that of the rest of its parent's subtree, or from PRIOR where
    the rest has pages but none labelled: one labelled branch says nothing of the others, several alike do. side: whether
    its share is the higher one.
    """
    x = _prefixes(paths, segments, 0).groupBy("host", "node", "parent").agg(F.sum("n").alias("n"), F.sum("labelled").alias("m"), F.sum("blocked").alias("k"))
    above = x.select("host", F.col("node").alias("parent"), F.col("n").alias("pn"), F.col("m").alias("pm"), F.col("k").alias("pk"))
    x = x.join(above, ["host", "parent"])
    k, m, pk, pm = (F.col(c) for c in ("k", "m", "pk", "pm"))
    unlike = F.abs(_share(k, m) - PRIOR) > Z * F.sqrt(PRIOR * (1 - PRIOR) / F.greatest(m, F.lit(1)))
    apart = (m > 0) & F.when(pm > m, _differ(k, m, pk, pm)).otherwise(unlike & (F.col("pn") > F.col("n")))
    side = F.when(pm > m, _share(k, m) > _share(pk - k, pm - m)).otherwise(_share(k, m) > PRIOR)
    return x.select("host", "node", "parent", "n", "pn", "m", "k", apart.alias("apart"), side.alias("side"))


def branches(nodes: DataFrame) -> DataFrame:
    """host, node and branch of the nodes that stand apart: siblings of one side are one branch unless a node differs from them."""
    apart = nodes.where("apart").select("host", "node", "parent", "side", "m", "k")
    sides = apart.groupBy("host", "parent", "side").agg(F.sum("m").alias("sm"), F.sum("k").alias("sk"))
    x = apart.join(sides, ["host", "parent", "side"])
    together = F.concat("parent", F.when(F.col("side"), "//high").otherwise("//low"))
    return x.select("host", "node", F.when(_differ(F.col("k"), F.col("m"), F.col("sk"), F.col("sm")), F.col("node")).otherwise(together).alias("branch"))


def pooled(paths: DataFrame) -> DataFrame:
    """paths (host, key, template as segments, n, labelled, blocked) -> host, key, purity.

    At every level up to the host, what stands in no branch of its own is merged into its parent's; a path's purity is the
    smoothed share of blocked in all that was merged into the nearest branch above it, or into the host.
    """
    near = _prefixes(paths.select("host", "key", "template"), "template", 1).join(branches(_nodes(paths, "template")), ["host", "node"])
    near = near.groupBy("host", "key").agg(F.max_by("branch", "depth").alias("branch"))
    t = paths.join(near, ["host", "key"], "left").withColumn("branch", F.coalesce("branch", F.lit("")))
    merged = t.groupBy("host", "branch").agg(((F.sum("blocked") + WEIGHT * PRIOR) / (F.sum("labelled") + WEIGHT)).alias("purity"))
    return t.join(merged, ["host", "branch"]).select("host", "key", "purity")


def generalised(paths: DataFrame) -> DataFrame:
    """paths (host, key, segments, n, labelled, blocked) with template: segments of little support become wildcards.

    A name stays if the square of its pages reaches the pages of the node it lies under, or if it stands apart by its
    share of blocked; so many rows or many names don't turn a node's well-supported sections into one.
    """
    keep = _nodes(paths, "segments").select("host", "node", ((F.col("n") * F.col("n") >= F.col("pn")) | F.col("apart")).alias("keep"))
    steps = _prefixes(paths.select("host", "key", "segments"), "segments", 1).join(keep, ["host", "node"])
    step = F.struct("depth", F.when(F.col("keep"), F.get("segments", F.col("depth") - 1)).otherwise("*").alias("s"))
    steps = steps.groupBy("host", "key").agg(F.transform(F.array_sort(F.collect_list(step)), lambda x: x["s"]).alias("template"))
    return paths.join(steps, ["host", "key"], "left").withColumn("template", F.coalesce("template", F.array().cast("array<string>")))


def judge(pages: DataFrame, rules: list[tuple[str, str]] | None = None, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """page_id, host, path, rule (or null), verdict, template and purity of every row; repeated rows come as often.

    Null urls and urls without `://` have empty host and path and are judged like others. A page that no rule judges is
    blocked if the purity of its branch reaches CUT; without labelled pages on its host it is allowed, as PRIOR lies below.
    A path of d segments makes d rows, once for each different path of a host; empty segments are left out. Pages are
    counted per host and path before anything is joined, and what is joined back has one row for each of these; those
    that very many pages share are salted. Other columns are ignored, whatever their names.
    """
    rules = RULES if rules is None else rules
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    host, path = parts(F.col(url))
    p = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    p = p.withColumn("j", _judged(F.col("host"), F.col("path"), rules))
    segments = F.transform(F.filter(F.split("path", "/", -1), lambda s: s != ""), lambda s: F.when(s.rlike("[0-9]") | (F.length(s) > LONG_SEGMENT), "*").otherwise(s))
    p = p.withColumn("key", F.array_join(segments, "/"))
    scratch = Scratch(pages.sparkSession, "urls")
    counts = scratch.save(p.groupBy("host", "key").agg(F.count("*").alias("n"), F.count("j.rule").alias("labelled"), F.count(F.when(F.col("j.verdict") == "block", 1)).alias("blocked")), "counts")
    paths = counts.withColumn("segments", F.when(F.col("key") == "", F.array().cast("array<string>")).otherwise(F.split("key", "/", -1)))
    paths = scratch.save(generalised(paths).drop("segments"), "paths")
    found = paths.select("host", "key", "n", F.concat_ws("", F.transform("template", lambda s: F.concat(F.lit("/"), s))).alias("template")).join(pooled(paths), ["host", "key"])
    out = spread_join(p, scratch.save(found, "found"), ["host", "key"], F.struct("page_id", "path"))
    verdict = F.coalesce(F.col("j.verdict"), F.when(F.col("purity") >= CUT, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("j.rule").alias("rule"), verdict.alias("verdict"), "template", F.round("purity", 9).alias("purity"))


def sql(rules: list[tuple[str, str]] | None = None) -> str:
    """The same in SQL over pages(page_id, url)."""
    longest = sorted(rules or RULES, key=lambda r: (-len(r[1]), r[1]), reverse=False)
    fits = lambda r: f"(host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}')"
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in longest) + " END"
    ruled = "CASE " + " ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in longest) + " END"
    share = lambda k, m: f"(({k})::DOUBLE / greatest({m}, 1)::DOUBLE)"

    def differ(k: str, m: str, all_k: str, all_m: str) -> str:
        p = share(all_k, all_m)
        return f"(({all_m}) > ({m}) AND ({m}) > 0 AND abs({share(k, m)} - {share(f'{all_k} - {k}', f'{all_m} - {m}')}) > {Z!r}e0 * sqrt({p} * (1e0 - {p}) * (1e0 / greatest({m}, 1)::DOUBLE + 1e0 / greatest({all_m} - {m}, 1)::DOUBLE)))"

    def nodes(name: str, source: str, segments: str) -> str:
        unlike = f"abs({share('c.k', 'c.m')} - {PRIOR!r}e0) > {Z!r}e0 * sqrt({PRIOR * (1 - PRIOR)!r}e0 / greatest(c.m, 1)::DOUBLE)"
        return f"""{name}_each AS (SELECT host, labelled, blocked, n, {segments} AS s, unnest(range(0, len({segments}) + 1)) AS depth FROM {source}),
{name}_sums AS (SELECT host, coalesce(array_to_string(s[1:depth], '/'), '') AS node, CASE WHEN depth > 0 THEN coalesce(array_to_string(s[1:depth - 1], '/'), '') END AS parent,
    sum(n) AS n, sum(labelled) AS m, sum(blocked) AS k FROM {name}_each GROUP BY ALL),
{name} AS (SELECT c.host, c.node, c.parent, c.n, a.n AS pn, c.m, c.k,
    c.m > 0 AND CASE WHEN a.m > c.m THEN {differ('c.k', 'c.m', 'a.k', 'a.m')} ELSE {unlike} AND a.n > c.n END AS apart,
    CASE WHEN a.m > c.m THEN {share('c.k', 'c.m')} > {share('a.k - c.k', 'a.m - c.m')} ELSE {share('c.k', 'c.m')} > {PRIOR!r}e0 END AS side
    FROM {name}_sums c JOIN {name}_sums a ON a.host = c.host AND a.node = c.parent)"""

    prefixes = lambda source, segments: f"(SELECT host, key, {segments} AS s, unnest(range(1, len({segments}) + 1)) AS depth FROM {source})"
    return f"""
WITH urls AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split_ AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM urls),
ruled AS (SELECT *, {rule} AS rule FROM split_),
p AS (SELECT *, {ruled} AS by_rule, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '[0-9]') OR length(s) > {LONG_SEGMENT} THEN '*' ELSE s END) AS segments FROM ruled),
keyed AS (SELECT *, coalesce(array_to_string(segments, '/'), '') AS key FROM p),
counts AS (SELECT host, key, any_value(segments) AS segments, count(*) AS n, count(rule) AS labelled, count(*) FILTER (WHERE by_rule = 'block') AS blocked FROM keyed GROUP BY host, key),
{nodes('named', 'counts', 'segments')},
steps AS (SELECT e.host, e.key, list(CASE WHEN d.n * d.n >= d.pn OR d.apart THEN e.s[e.depth] ELSE '*' END ORDER BY e.depth) AS template
    FROM {prefixes('counts', 'segments')} e JOIN named d ON d.host = e.host AND d.node = array_to_string(e.s[1:e.depth], '/') GROUP BY e.host, e.key),
paths AS (SELECT counts.*, coalesce(template, []) AS template FROM counts LEFT JOIN steps USING (host, key)),
{nodes('merging', 'paths', 'template')},
sides AS (SELECT host, parent, side, sum(m) AS sm, sum(k) AS sk FROM merging WHERE apart GROUP BY host, parent, side),
branches AS (SELECT host, node, CASE WHEN {differ('k', 'm', 'sk', 'sm')} THEN node ELSE parent || CASE WHEN side THEN '//high' ELSE '//low' END END AS branch
    FROM (SELECT * FROM merging WHERE apart) JOIN sides USING (host, parent, side)),
near AS (SELECT e.host, e.key, max_by(branch, e.depth) AS branch FROM {prefixes('paths', 'template')} e JOIN branches b ON b.host = e.host AND b.node = array_to_string(e.s[1:e.depth], '/') GROUP BY e.host, e.key),
placed AS (SELECT paths.*, coalesce(branch, '') AS branch FROM paths LEFT JOIN near USING (host, key)),
merged AS (SELECT host, branch, (sum(blocked) + {WEIGHT * PRIOR!r}e0) / (sum(labelled) + {WEIGHT!r}e0) AS purity FROM placed GROUP BY host, branch)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN purity >= {CUT} THEN 'block' ELSE 'allow' END) AS verdict,
    coalesce(array_to_string(list_transform(template, lambda s: '/' || s), ''), '') AS template, round(purity, 9) AS purity
FROM keyed JOIN placed USING (host, key) JOIN merged USING (host, branch)
"""
