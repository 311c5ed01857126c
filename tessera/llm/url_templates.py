"""URL filter by a path-template tree (operator 10).

Each host has a tree of path segments. Level by level, segments that vary become a wildcard: those with the shape of a
number or a long hexadecimal, and all the others of a node if they are many and none of them prevails. Neither test depends on how many
pages there are to a segment, so more traffic doesn't change a template. A node of fewer than ``MIN_PAGES`` pages isn't split any
further, so the tree is as deep as frequent paths are. Branches, inner ones as well as leaves, whose labelled
share of good pages does not differ from that of all their siblings are merged with them: a path's template is the deepest node on its way that differs,
or else its whole host; and a template is rejected if its smoothed labelled purity is under a threshold. Explicit
host and path rules come first.

Everything is a DataFrame aggregate or an equi-join: the tree's statistics are
first counted by (host, path), so a host with a third of all pages is combined
on the map side; nodes are written before paths are joined with them, so that the join may split a large host.

Defined results: a null url, or one without ``://``, has an empty host and path
and is judged like any other (its template is the empty host's root); repeated
rows are judged alike and each is returned; an empty table gives an empty
result; extra columns of the input are ignored; a null label counts as no label;
several labels for one id are averaged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, materialise


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)

#: A node with fewer pages is not split.
MIN_PAGES = 4
#: Segments of this shape vary. Others do if a node has at least so many and the most frequent has no more than this share of their pages.
VARIABLE = "^[0-9]+([-_.][0-9]+)*([.][a-z0-9]{1,5})?$|^[0-9a-f]{12,}$"
KIDS, SHARE = 12, 0.5
#: The SQL twin follows this many levels; the operator all.
LEVELS = 8
#: Branches within this many standard errors of their siblings' mean purity are merged.
Z = 2.0
#: Pseudo-count and prior of the purity, and the least purity that is allowed.
ALPHA, PRIOR, PURITY = 8.0, 0.7, 0.5


def host_path(url: Column) -> tuple[Column, Column]:
    """The url's host (A-Z lower-cased) and path; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("url")))
    host = F.coalesce(ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1), F.lit(""))
    return host, path


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict, null if none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is tested first
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def _level(paths: DataFrame, depth: int) -> DataFrame:
    """Settle segment ``depth`` of every (host, path) that has one: itself, ``*`` where it varies, or with all the rest where few pages are left."""
    active = ~F.col("done") & (F.size("segs") > depth)
    paths = paths.withColumn("seg", F.get("segs", F.lit(depth))).withColumn("shape", F.col("seg").rlike(VARIABLE)).withColumn("active", active)
    kids = paths.where("active").groupBy("host", "prefix", "seg", "shape").agg(F.sum("n").alias("n"))
    named = F.when(~F.col("shape"), F.col("n"))
    nodes = kids.groupBy("host", "prefix").agg(F.sum("n").alias("pages"), F.count(named).alias("kids"), F.max(named).alias("top"), F.sum(named).alias("named"))
    varies = (F.col("kids") >= KIDS) & (F.col("top") <= SHARE * F.col("named"))
    nodes = materialise(nodes.select("host", "prefix", (F.col("pages") < MIN_PAGES).alias("few"), F.coalesce(varies, F.lit(False)).alias("varies")), "nodes")
    paths = paths.join(nodes, ["host", "prefix"], "left")
    rest = F.concat(F.lit("/"), F.array_join(F.expr(f"slice(segs, {depth + 1}, greatest(size(segs), 1))"), "/"))
    step = F.when(F.col("few"), rest).when(F.col("shape") | F.col("varies"), "/*").otherwise(F.concat(F.lit("/"), F.col("seg")))
    prefix = F.when(F.col("active"), F.concat("prefix", step)).otherwise(F.col("prefix"))
    chain = F.when(F.col("active"), F.concat("chain", F.array(F.concat("prefix", step)))).otherwise(F.col("chain"))
    done = F.col("done") | ~F.col("active") | F.col("few") | (F.size("segs") <= depth + 1)
    return paths.select("host", "path", "n", "seen", "good", "segs", prefix.alias("prefix"), chain.alias("chain"), done.alias("done"))


def templates(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, path) -> template, with the counts behind its verdict.

    ``pages``: page_id, host, path. ``labels``: page_id, good (0 to 1).
    """
    judged = labels.where("page_id is not null and good is not null").groupBy("page_id").agg(F.avg("good").alias("good"))
    counted = (
        pages.join(judged, "page_id", "left")
        .groupBy("host", "path")
        .agg(F.count(F.lit(1)).alias("n"), F.count("good").alias("seen"), F.sum(F.coalesce("good", F.lit(0.0))).alias("good"))
    )
    segs = F.expr("filter(split(path, '/'), x -> x <> '')")
    none = F.array().cast("array<string>")
    paths = materialise(counted.select("*", segs.alias("segs"), F.lit("").alias("prefix"), none.alias("chain"), F.lit(False).alias("done")), "paths")
    depth = 0
    while paths.where(~F.col("done") & (F.size("segs") > depth)).limit(1).count():
        paths = materialise(_level(paths, depth), "paths")
        depth += 1
    above = F.when(F.col("at") > 0, F.get("chain", F.col("at") - 1)).otherwise("")
    ways = paths.select("host", "path", "seen", "good", "chain", F.posexplode("chain").alias("at", "prefix")).withColumn("above", above)
    nodes = materialise(ways.groupBy("host", "above", "prefix").agg(F.sum("seen").alias("seen"), F.sum("good").alias("good")), "nodes")
    families = materialise(nodes.groupBy("host", "above").agg((F.sum("good") / F.nullif(F.sum("seen"), F.lit(0))).alias("mean")), "families")
    differs = F.abs(F.col("good") / F.col("seen") - F.col("mean")) > Z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / F.col("seen"))
    marked = materialise(nodes.where("seen > 0").join(families, ["host", "above"]).where(differs).select("host", "prefix"), "marked")
    deepest = ways.join(marked, ["host", "prefix"]).groupBy("host", "path").agg(F.max(F.struct("at", "prefix"))["prefix"].alias("template"))
    named = materialise(paths.join(deepest, ["host", "path"], "left").select("host", "path", "seen", "good", F.coalesce("template", F.lit("/")).alias("template")), "named")
    purity = (F.sum("good") + ALPHA * PRIOR) / (F.sum("seen") + ALPHA)
    verdicts = materialise(named.groupBy("host", "template").agg(F.sum("seen").alias("t_seen"), F.when(purity < PURITY, "block").otherwise("allow").alias("by_template")), "verdicts")
    return named.join(verdicts, ["host", "template"]).select("host", "path", "template", "t_seen", "by_template")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """A verdict for every row of ``pages`` (page_id, url).

    Verdicts come from the rules where one fits. All other pages make the templates, with their ``labels`` (page_id, good);
    pages with a rule, and their labels, count in no template.
    """
    host, path = host_path(F.col("url"))
    text, verdict = rule_columns(rules)
    parsed = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path).select("page_id", "host", "path", text.alias("rule"), verdict.alias("by_rule"))
    free = parsed.where("rule is null")
    known = materialise(templates(free.select("page_id", "host", "path"), labels), "templates")  # so that the join may split a frequent url
    out = parsed.join(known, ["host", "path"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_template").alias("verdict"), F.when(F.col("rule").isNull(), F.col("template")).alias("template"))


def oracle(pages: str = "pages", labels: str = "labels", rules=RULES) -> str:
    """The same verdicts as DuckDB SQL over (page_id, url) and (doc_id, quality, toxic)."""
    fits = lambda r: f"(host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')"
    order = sorted(rules, key=lambda r: (-len(r.text), r.text))
    case = lambda f: "case " + " ".join(f"when {fits(r)} then '{f(r)}'" for r in order) + " end"
    sql = f"""
with raw as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) end as rest from {pages}),
hp as (select page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
  coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1), '') as path from raw),
parsed as (select *, {case(lambda r: r.text)} as rule, {case(lambda r: r.verdict)} as by_rule from hp),
judged as (select doc_id as page_id, avg(case when quality = 1 and toxic = 0 then 1.0 else 0.0 end) as good from {labels} where doc_id is not null and quality is not null and toxic is not null group by 1),
counted as (select host, path, count(*) as n, count(good) as seen, sum(coalesce(good, 0.0)) as good from parsed left join judged using (page_id) where rule is null group by 1, 2),
l0 as (select *, list_filter(string_split(path, '/'), lambda x: x <> '') as segs, '' as prefix, cast([] as varchar[]) as chain, false as done from counted)"""
    for d in range(LEVELS):
        sql += f""",
x{d} as (select *, not done and len(segs) > {d} as active, segs[{d + 1}] as seg, coalesce(regexp_matches(segs[{d + 1}], '{VARIABLE}'), false) as shape from l{d}),
k{d} as (select host, prefix, seg, shape, sum(n) as n from x{d} where active group by 1, 2, 3, 4),
v{d} as (select host, prefix, sum(n) < {MIN_PAGES} as few, coalesce(count(*) filter (not shape) >= {KIDS} and max(n) filter (not shape) <= {SHARE} * sum(n) filter (not shape), false) as varies from k{d} group by 1, 2),
s{d} as (select x.*, few, x.prefix || case when few then '/' || array_to_string(segs[{d + 1}:], '/') when shape or varies then '/*' else '/' || seg end as next from x{d} x left join v{d} v on x.host = v.host and x.prefix = v.prefix),
l{d + 1} as (select host, path, n, seen, good, segs, case when active then next else prefix end as prefix, case when active then list_append(chain, next) else chain end as chain, done or not active or few or len(segs) <= {d + 1} as done from s{d})"""
    return sql + f""",
ways as (select host, path, seen, good, chain, unnest(chain) as prefix, unnest(range(len(chain))) as turn from l{LEVELS}),
nodes as (select host, case when turn > 0 then chain[turn] else '' end as above, prefix, sum(seen) as seen, sum(good) as good from ways group by 1, 2, 3),
families as (select host, above, sum(good) / nullif(sum(seen), 0) as mean from nodes group by 1, 2),
marked as (select host, prefix from nodes join families using (host, above) where seen > 0 and abs(good / seen - mean) > {Z} * sqrt(mean * (1 - mean) / seen)),
deepest as (select host, path, max_by(w.prefix, turn) as template from ways w join marked m using (host, prefix) group by 1, 2),
named as (select l.host, l.path, seen, good, coalesce(template, '/') as template from l{LEVELS} l left join deepest d on d.host = l.host and d.path = l.path),
merged as (select host, template, case when (sum(good) + {ALPHA * PRIOR}) / (sum(seen) + {ALPHA}) < {PURITY} then 'block' else 'allow' end as by_template from named group by 1, 2)
select p.page_id, p.host, p.path, p.rule, coalesce(p.by_rule, m.by_template) as verdict, case when p.rule is null then n.template end as template
from parsed p left join named n on n.host = p.host and n.path = p.path left join merged m on m.host = n.host and m.template = n.template"""
