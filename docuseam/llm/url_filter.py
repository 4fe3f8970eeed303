"""URL filters over a tree of path templates, with built-in functions only.

Every host has a tree whose levels are path segments. Segments that look
variable (numbers, hexadecimal, uuids, words with digits) become wildcards at
once. Then, level by level, children of a node become one wildcard branch if
there are many of them and each is rare, and children whose labelled share of
blocked urls does not differ significantly from that of all their siblings
together are merged too. The labels are the verdicts of the rules.

A template's purity is its share of blocked urls among the labelled ones of its
host, smoothed towards the same template's share in the host's registered
domain, which is smoothed towards its share over all hosts, and that towards one
half. So what is known of a template elsewhere decides where a host has few
labels or none. Urls without a rule are rejected if their template is pure
enough and enough labelled urls speak for it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut_lineage, fresh_name, join_hot


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    block: bool

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (UrlRule("net", "/", True), UrlRule("example.net", "/en/", False), UrlRule("example.com", "/de/", True), UrlRule("org", "/fr/", False))


@dataclass(frozen=True)
class TreeParams:
    #: levels of the tree; what follows is one tail wildcard, rules see whole paths
    depth: int = 4
    #: a node with this many children, of this many urls each on average, is variable
    many_children: int = 20
    rare_child: float = 2.0
    #: siblings merge within this many standard errors of the pooled share
    merge_z: float = 1.64
    #: labelled urls that a branch needs to be merged, and a template, over all hosts, to be rejected
    min_labelled: int = 8
    #: weight of the wider share in a smoothed share
    smoothing: float = 4.0
    purity: float = 0.9


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> tuple[Column, Column]:
    """Name of the longest fitting rule, and whether it blocks; null if none fits."""
    name, block = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # longer ones override
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, block = F.when(fits, r.name).otherwise(name), F.when(fits, F.lit(r.block)).otherwise(block)
    return name, block


def registered_domain(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


#: End of a segment: Java's dollar sign would also match before a last line feed.
_EXT = r"(\.[A-Za-z][A-Za-z0-9]{0,4})\z"
_UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"


def lexical_segment(seg: Column) -> Column:
    """Wildcards by the look of a segment; the extension stays."""
    ext = F.regexp_extract(seg, _EXT, 1)
    stem = F.substring(seg, F.lit(1), F.length(seg) - F.length(ext))
    digits = stem.rlike("[0-9]")
    kind = (
        F.when(stem.rlike(r"^[0-9]+\z"), "{n}")
        .when(stem.rlike(_UUID), "{u}")
        .when(stem.rlike(r"^[0-9a-fA-F]{8,}\z") & digits, "{h}")
        .when(digits, "{x}")
        .otherwise(stem)
    )
    return F.concat(kind, ext)


def judge_urls(pages: DataFrame, url: str = "url", rules: tuple[UrlRule, ...] = RULES, params: TreeParams = TreeParams()) -> DataFrame:
    """Add host, path, rule, verdict, template, purity and labelled to every row.

    Null urls and urls without ``://`` get an empty host and path, and are
    allowed unless a rule fits. Repeated rows stay. Input columns of those names
    are replaced, whatever their case; all others stay as they are. An empty
    table gives an empty one.
    """
    own = ("host", "path", "rule", "verdict", "template", "purity", "labelled")
    names = [c for c in pages.columns if c.lower() not in own]
    # the input's columns travel in one struct, so that none of them meets a name used here
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in names], F.lit(0).alias(fresh_name(pages, "filled"))).alias("row"), url_host(F.col(f"`{url}`")).alias("host"), url_path(F.col(f"`{url}`")).alias("path"))
    rule, block = matching_rule(F.col("host"), F.col("path"), rules)
    parts = F.split(F.col("path"), "/", -1)
    parts = F.transform(F.slice(parts, 2, params.depth), lexical_segment)
    tail = F.size(F.split(F.col("path"), "/", -1)) > params.depth + 1
    parts = F.when(tail, F.concat(parts, F.array(F.lit("**")))).otherwise(parts)
    rows = rows.withColumn("rule", rule).withColumn("block", block).withColumn("key", F.array_join(parts, "/"))
    rows = rows.withColumn("leaf", _at("host", "key"))

    leaves = rows.groupBy("leaf", "host", "key").agg(F.count("*").alias("n"), F.count_if("block").alias("bad"), F.count("block").alias("lab"))
    leaves = leaves.withColumn("segs", F.split("key", "/", -1)).withColumn("node", F.lit(""))
    leaves = cut_lineage(leaves)
    for d in range(params.depth + 1):
        leaves = cut_lineage(_grow(leaves, d, params))  # each level reads the last one twice
    judged = _purity(leaves, params).select("leaf", "template", "purity", "labelled")
    out = join_hot(rows, judged, "leaf")
    reject = (F.col("purity") >= params.purity) & (F.col("labelled") >= params.min_labelled)
    says = F.when(F.coalesce("block", reject), "block").otherwise("allow")
    kept = [F.col("row").getField(c).alias(c) for c in names]
    return out.select(*kept, "host", "path", "rule", says.alias("verdict"), "template", F.round("purity", 6).alias("purity"), "labelled")


def _at(*parts: str) -> Column:
    """One key of several columns; a host holds no slash, so it ends at the first one."""
    return F.concat_ws("/", *parts)


def _grow(leaves: DataFrame, d: int, p: TreeParams) -> DataFrame:
    """Decide level ``d`` of the tree: which children of each node become a wildcard."""
    here = leaves.withColumn("seg", F.coalesce(F.get("segs", F.lit(d)), F.lit(""))).withColumn("at", _at("host", "node")).withColumn("kid", F.concat_ws("/", "at", "seg"))
    kids = here.groupBy("at", "kid", "seg").agg(F.sum("n").alias("cn"), F.sum("bad").alias("cb"), F.sum("lab").alias("cl"))
    total = kids.groupBy("at").agg(F.count("*").alias("kids"), F.sum("cn").alias("tn"), F.sum("cb").alias("tb"), F.sum("cl").alias("tl"))
    both = join_hot(kids, total, "at")
    pooled = F.try_divide("tb", "tl")
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), "cl") + F.try_divide(F.lit(1), "tl")))
    similar = (F.col("kids") > 1) & (F.col("cl") >= p.min_labelled) & (F.abs(F.try_divide("cb", "cl") - pooled) <= p.merge_z * error)
    variable = (F.col("kids") >= p.many_children) & (F.col("tn") <= p.rare_child * F.col("kids"))
    shown = F.when((F.col("seg") != "") & (variable | F.coalesce(similar, F.lit(False))), "*").otherwise(F.col("seg"))
    grown = join_hot(here, both.select("kid", shown.alias("shown")), "kid")
    node = F.when(F.size("segs") > d, F.concat(F.col("node"), F.lit("/"), F.col("shown"))).otherwise(F.col("node"))
    return grown.withColumn("node", node).drop("seg", "shown", "at", "kid")


def _purity(leaves: DataFrame, p: TreeParams) -> DataFrame:
    """Smoothed share of blocked urls of each leaf's template: all hosts, then its domain, then its host."""
    out = leaves.withColumnRenamed("node", "template").withColumn("domain", registered_domain(F.col("host"))).withColumn("purity", F.lit(0.5))
    for k, by in enumerate((("template",), ("domain", "template"), ("host", "template"))):
        sums = out.groupBy(_at(*by).alias("of")).agg(F.sum("bad").alias("nb"), F.sum("lab").alias("nl"))
        out = join_hot(out.withColumn("of", _at(*by)), sums, "of")
        out = out.withColumn("purity", (F.col("nb") + p.smoothing * F.col("purity")) / (F.col("nl") + p.smoothing))
        out = (out.withColumn("labelled", F.col("nl")) if not k else out).drop("of", "nb", "nl")
    return out


def url_report(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, params: TreeParams = TreeParams()) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, template, purity, labelled."""
    return judge_urls(pages.select("page_id", "url"), "url", rules, params).drop("url")


def url_report_sql(rules: tuple[UrlRule, ...] = RULES, p: TreeParams = TreeParams()) -> str:
    """The report in DuckDB's SQL."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    fits = lambda r: f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"
    case = lambda f: "CASE " + " ".join(f"WHEN {fits(r)} THEN {f(r)}" for r in ordered) + " END"
    stem = f"s[1:length(s) - length(regexp_extract(s, '{_EXT}', 1))]"
    lexical = (
        f"(CASE WHEN regexp_matches({stem}, '^[0-9]+\\z') THEN '{{n}}' WHEN regexp_matches({stem}, '{_UUID}') THEN '{{u}}' "
        f"WHEN regexp_matches({stem}, '^[0-9a-fA-F]{{8,}}\\z') AND regexp_matches({stem}, '[0-9]') THEN '{{h}}' "
        f"WHEN regexp_matches({stem}, '[0-9]') THEN '{{x}}' ELSE {stem} END) || regexp_extract(s, '{_EXT}', 1)"
    )
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    ctes = [
        f"u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{lower}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)",
        f"r AS (SELECT page_id, host, path, {case(lambda r: repr(r.name))} AS rule, {case(lambda r: str(r.block).lower())} AS block, string_split(path, '/')[2:] AS raw FROM u)",
        f"k AS (SELECT *, array_to_string(list_transform(raw[1:{p.depth}], lambda s: {lexical}), '/') || CASE WHEN len(raw) > {p.depth} THEN '/**' ELSE '' END AS key FROM r)",
        "l AS (SELECT host, key, count(*) AS n, count(*) FILTER (block) AS bad, count(block) AS lab, string_split(key, '/') AS segs, '' AS node0 FROM k GROUP BY host, key)",
    ]
    last = "l"
    for d in range(p.depth + 1):
        node = f"node{d}"
        ctes += [
            f"h{d} AS (SELECT *, coalesce(segs[{d + 1}], '') AS seg FROM {last})",
            f"c{d} AS (SELECT host, {node}, seg, sum(n) AS cn, sum(bad) AS cb, sum(lab) AS cl FROM h{d} GROUP BY ALL)",
            f"t{d} AS (SELECT host, {node}, count(*) AS kids, sum(cn) AS tn, sum(cb) AS tb, sum(cl) AS tl FROM c{d} GROUP BY ALL)",
            f"""w{d} AS (SELECT host, {node}, seg, CASE WHEN seg <> '' AND ((kids >= {p.many_children} AND tn <= {p.rare_child} * kids) OR coalesce(kids > 1 AND cl >= {p.min_labelled}
              AND abs(cb / nullif(cl, 0) - tb / nullif(tl, 0)) <= {p.merge_z} * sqrt(tb / nullif(tl, 0) * (1 - tb / nullif(tl, 0)) * (1 / nullif(cl, 0) + 1 / nullif(tl, 0))), false)) THEN '*' ELSE seg END AS shown FROM c{d} JOIN t{d} USING (host, {node}))""",
            f"g{d} AS (SELECT * EXCLUDE (seg, shown), CASE WHEN len(segs) > {d} THEN {node} || '/' || shown ELSE {node} END AS node{d + 1} FROM h{d} JOIN w{d} USING (host, {node}, seg))",
        ]
        last = f"g{d}"
    tree = last
    shares = []
    for k, by in enumerate(("template", "domain, template", "host, template")):
        wide = f"(sum(bad) OVER w{k} + {p.smoothing} * {shares[-1] if shares else 0.5}::DOUBLE) / (sum(lab) OVER w{k} + {p.smoothing})"
        shares.append(f"p{k}")
        ctes.append(f"s{k} AS (SELECT *, {wide} AS p{k}{', (sum(lab) OVER w0)::BIGINT AS labelled' if not k else ''} FROM {f's{k - 1}' if k else f'(SELECT * EXCLUDE (node{p.depth + 1}), node{p.depth + 1} AS template, array_to_string(string_split(host, chr(46))[-2:], chr(46)) AS domain FROM {tree})'} WINDOW w{k} AS (PARTITION BY {by}))")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT page_id, host, path, rule, CASE WHEN coalesce(block, p2 >= {p.purity} AND labelled >= {p.min_labelled}) THEN 'block' ELSE 'allow' END AS verdict,
  template, round(p2, 6) AS purity, labelled FROM k JOIN s2 USING (host, key)"""
