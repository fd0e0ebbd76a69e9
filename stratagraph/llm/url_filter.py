"""URL filter with redirect equivalence (operator 5).

Rules name a host and the start of a path; a rule fits its host and all subdomains, and of the
rules that fit, the longest wins. URLs no rule fits inherit: redirects and canonical links tie
pages into components of aliases, and a component that holds a blocked URL blocks its members,
unless it also holds a URL that a rule explicitly allows. That holds for every URL of a component,
whether a page of its own or only the target of a link. A rule's own verdict is never changed.

All of it is DataFrame expressions. Host, path and alias name of a URL are bound as columns step
by step, so no expression is repeated. Rules join on host suffixes (a rule list under Spark's own
broadcast threshold is broadcast, a longer one is shuffled). Html is read once, for its links.
Verdicts are summed over distinct URLs before they meet components, and where a blocked URL or
component meets its rows the join is salted, so neither a common host, nor one URL repeated, nor
one huge component gathers its rows anywhere. URLs that cannot be aliases (no host) join nothing.

Null URLs, and those without ``://``, have an empty host and path, no rule and no aliases, and
are allowed. Null html has no links; of several canonical links or refreshes all count. Repeated
rows each get their own result row; null keys are kept. An empty table gives an empty result.
URLs and html of any length are read whole. Further columns of the table are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Tasks over which the rows of one URL or component are dealt.
SALTS = 16


def parsed(rows: DataFrame, url: str, prefix: str = "") -> DataFrame:
    """Add host, path and node (names prefixed) of the URL in column ``url``.

    A node is what aliases are compared by: host, path and query; scheme and fragment play no part.
    """
    host, path, node, rest, tail = (prefix + x for x in ("host", "path", "node", "rest", "tail"))
    place = F.instr(F.col(url), "://")
    step = rows.withColumn(rest, F.when(place > 0, F.substring(F.col(url), place + 3, F.length(url))))
    step = step.withColumn(host, F.coalesce(F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), UPPER, LOWER), F.lit("")))
    step = step.withColumn(tail, F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^#]*)", 1), F.lit("")))
    step = step.withColumn(path, F.substring_index(tail, "?", 1))
    return step.withColumn(node, F.when(F.col(host) != "", F.concat(host, F.when(F.col(tail) == "", F.lit("/")).otherwise(F.col(tail))))).drop(rest, tail)


def apply_rules(urls: DataFrame, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Add ``rule`` (host and path of the winning rule) and ``rule_verdict`` to rows that have
    ``row``, ``host`` and ``path``; both null where no rule fits. Longest rule wins, then the
    longer host, then the smaller text."""
    spark = urls.sparkSession
    given = spark.createDataFrame([(h, p, v) for h, p, v in rules], "rule_host string, rule_path string, rule_verdict string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = urls.filter("host <> ''").select("row", "path", F.explode(suffixes).alias("rule_host")).join(given, "rule_host").filter(F.expr("startswith(path, rule_path)"))
    length = F.length("rule_host") + F.length("rule_path")
    won = fits.groupBy("row").agg(F.min_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict"), F.struct((-length).alias("n"), (-F.length("rule_host")).alias("h"), F.concat("rule_host", "rule_path").alias("r"))).alias("won"))
    return urls.join(won.select("row", "won.rule", "won.rule_verdict"), "row", "left")


def plain_text(link: Column) -> Column:
    """A link with its entities undone: numeric ones of ASCII characters, and the five that any markup has."""
    found = F.array_distinct(F.regexp_extract_all(link, F.lit(r"&#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"), F.lit(0)))
    code = lambda e: F.when(F.lower(e).startswith("&#x"), F.conv(F.regexp_extract(e, r"[xX]([0-9a-fA-F]+)", 1), 16, 10).cast("int")).otherwise(F.regexp_extract(e, r"([0-9]+)", 1).cast("int"))
    out = F.aggregate(found, link, lambda text, e: F.when(code(e).between(1, 127), F.replace(text, e, F.char(code(e)))).otherwise(text))
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.trim(out)


def without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments."""
    parts = F.split(F.regexp_replace(path, r"\A/", ""), "/")
    none = F.array().cast("array<string>")
    kept = F.aggregate(parts, none, lambda a, s: F.when(s == ".", a).when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))))
    kept = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.rlike(r"(\A|/)\.\.?(/|\z)"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Alias edges (src, dst) that pages declare: canonical links and meta refreshes. Links are taken by the rules
    of URLs: relative to the page's folder, its path (those of a query alone) or itself (those of a fragment
    alone, which tie nothing), with dot segments removed; schemes without a host tie nothing."""
    tag = lambda text, mark, part: F.transform(F.regexp_extract_all(text, F.lit(mark), F.lit(0)), lambda t: F.regexp_extract(t, part, 1))
    canonical = tag(html, r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)")
    refresh = tag(html, r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)")
    marked = pages.filter(F.col(html).rlike(r"(?i)canonical|refresh")).select(F.col(url).alias("from_url"), F.explode(F.concat(canonical, refresh)).alias("link")).filter("link <> ''")
    found = parsed(marked.withColumn("link", plain_text(F.col("link"))).filter("link <> '' and not startswith(link, '#')"), "from_url", "from_")
    base = found.withColumn("scheme", F.concat(F.substring_index("from_url", "://", 1), F.lit("://"))).withColumn("folder", F.regexp_extract("from_path", r"(?s)\A.*/", 0))
    absolute = (
        F.when(F.col("link").rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), F.col("link"))
        .when(F.startswith("link", F.lit("//")), F.concat(F.substring_index("scheme", "//", 1), "link"))
        .when(F.startswith("link", F.lit("/")), F.concat("scheme", "from_host", "link"))
        .when(F.startswith("link", F.lit("?")), F.concat("scheme", "from_host", "from_path", "link"))
        .otherwise(F.concat("scheme", "from_host", F.when(F.col("folder") == "", F.lit("/")).otherwise(F.col("folder")), "link"))
    )
    pieces = [F.regexp_extract("whole", r"(?s)\A([^:/?#]+://[^/?#]*)([^?#]*)(.*)", k) for k in (1, 2, 3)]
    there = base.select("from_node", absolute.alias("whole")).filter(F.col("whole").contains("://")).select("from_node", *[p.alias(n) for p, n in zip(pieces, ("head", "middle", "tail"))])
    return parsed(there.select("from_node", F.concat("head", without_dots(F.col("middle")), "tail").alias("to_url")), "to_url", "to_").select(F.col("from_node").alias("src"), F.col("to_node").alias("dst"))


def url_links(redirects: DataFrame) -> DataFrame:
    """Alias edges from redirects given as URLs (src, dst)."""
    both = parsed(parsed(redirects.select("src", "dst"), "src", "from_"), "dst", "to_")
    return both.select(F.col("from_node").alias("src"), F.col("to_node").alias("dst"))


def _among(rows: DataFrame, few: DataFrame, column: str, salt: str) -> DataFrame:
    """``rows`` left-joined with ``few`` (unique ``column``, blocked): each of the few is there once a
    salt, and the rows of one value are dealt over all salts."""
    dealt = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(dealt, [column, "salt"], "left").drop("salt")


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]], redirects: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str | None = "html") -> DataFrame:
    """``key``, host, path, rule, verdict, via (``rule``, ``alias`` or ``none``) for every row.

    ``redirects``: further alias edges as URLs (src, dst), say from a crawl log.
    """
    named = pages.select(F.col(key).alias("page_key"), F.col(url).alias("page_url"), *([F.col(html).alias("page_html")] if html else []))
    edges = page_links(named, "page_url", "page_html") if html else pages.sparkSession.createDataFrame([], "src string, dst string")
    if redirects is not None:
        edges = edges.unionByName(url_links(redirects))
    aliases = materialize(connected_components(edges), "aliases")
    rows = parsed(named.select("page_key", "page_url"), "page_url").select("page_key", "host", "path", "node", F.lit(True).alias("is_page"))
    # A node is a URL without its scheme. Rules apply to all of them: targets of links need not be pages.
    targets = parsed(aliases.select(F.lit(None).cast(pages.schema[key].dataType).alias("page_key"), F.concat(F.lit("x://"), "node").alias("page_url")), "page_url")
    every = materialize(rows.unionByName(targets.select("page_key", "host", "path", "node", F.lit(False).alias("is_page"))).withColumn("row", F.monotonically_increasing_id()), "urls")
    ruled = materialize(apply_rules(every, rules), "ruled")
    # The rule of a URL depends on its node alone, so each node counts once.
    by_node = ruled.filter("rule is not null").select("node", "rule_verdict").distinct().join(aliases, "node")
    verdicts = by_node.groupBy("component").agg(F.bool_or(F.col("rule_verdict") == "allow").alias("allows"), F.bool_or(F.col("rule_verdict") == "block").alias("blocks"))
    blocked = verdicts.filter("blocks and not allows").select("component", F.lit(True).alias("blocked"))
    spread = _among(aliases, blocked, "component", "node").filter("blocked").select("node", "blocked")
    of_pages = ruled.filter("is_page")
    alone = F.col("rule").isNotNull() | F.col("node").isNull()
    open_ = _among(of_pages.filter(~alone), spread, "node", "row")
    every_page = of_pages.filter(alone).withColumn("blocked", F.lit(None).cast("boolean")).unionByName(open_)
    return every_page.select(
        F.col("page_key").alias(key),
        "host",
        "path",
        "rule",
        F.coalesce("rule_verdict", F.when(F.col("blocked"), "block"), F.lit("allow")).alias("verdict"),
        F.when(F.col("rule").isNotNull(), "rule").when(F.col("blocked"), "alias").otherwise("none").alias("via"),
    )


_PARTS = """
with urls as (
    select page_id, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages
), parts as (
    select page_id, url,
           translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
           coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
    from urls
), rules(h, p, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits as (
    select page_id, h || p as rule, v, row_number() over (partition by page_id order by length(h) + length(p) desc, length(h) desc, h || p) as n
    from parts join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
)"""
_GROUP = r"\A/[a-z]+/[0-9]{1,2}"
ORACLE_SQL = {
    "op5_url_filter": _PARTS + """
select parts.page_id, host, path, rule, coalesce(v, 'allow') as verdict, case when rule is null then 'none' else 'rule' end as via
from parts left join fits on fits.page_id = parts.page_id and n = 1
""",
    "url_alias_verdicts": _PARTS + """
, mirrors as (select page_id, host, path, regexp_extract(path, '^/[a-z]+/[0-9]{1,2}') as g, rule, v from parts left join fits using (page_id) where coalesce(n, 1) = 1),
groups as (select g, bool_or(coalesce(v, '') = 'block') and not bool_or(coalesce(v, '') = 'allow') as blocked from mirrors where g <> '' and host <> '' group by g)
select page_id, host, path, rule, coalesce(v, case when host <> '' and blocked then 'block' end, 'allow') as verdict,
       case when rule is not null then 'rule' when host <> '' and coalesce(blocked, false) then 'alias' else 'none' end as via
from mirrors left join groups using (g)
""",
}


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES)


def url_alias_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same judgement with redirects beside the pages: pages whose paths begin alike redirect to
    the one of them with the smallest URL, so verdicts spread over components."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    mirrors = parsed(pages.select("url"), "url").filter("host <> ''").select("url", F.regexp_extract("path", _GROUP, 0).alias("g")).filter("g <> ''")
    first = mirrors.groupBy("g").agg(F.min("url").alias("dst"))
    return judge(pages, RULES, mirrors.join(first, "g").select(F.col("url").alias("src"), "dst"))
