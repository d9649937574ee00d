"""Block and allow rules for urls, with block decisions carried over to aliases.

A rule is a host and the start of a path; it fits that host and all its subdomains, and the longest
fitting rule decides. Urls that lead to each other (a page's canonical link, a page's immediate
redirect, or given edges) are aliases: a url that no rule fits is blocked if a rule blocks a url of its
alias class. An explicit allow of the url itself goes before whatever its aliases say.

A link may be relative, and its tag may name its attributes in any order and quoting; a ``<base>`` tag is not read.

Alias classes are connected components over urls without scheme and fragment, computed by joins. Only
pages that name another url take part in them. A short rule list becomes one ``CASE``, so that judging
the pages needs no shuffle; a long one is joined on the host's suffixes.

Defined results: a null url, or one without ``://``, has empty host and path and no aliases; null html
names no alias; a very long page is read whole; of equally long rules an allow goes before a block, then the first by text; rows that
repeat are judged each on their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.components import connected
from lectern.llm.native import let
from lectern.session import discard, materialize

#: More rules than these are joined rather than compiled.
MAX_COMPILED = 256

#: A refresh after at most so many seconds is a redirect.
MAX_DELAY = 10

#: A whole link or meta tag; quoted values may hold any character.
_TAG = r"""(?i)(<(?:link|meta)\s(?:[^>"']+|"[^"]*"|'[^']*')*>)"""
_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"
_REFRESH = r"""(?i)^\s*([0-9]{1,9})(?:\.[0-9]*)?\s*[;,\s]\s*(?:url\s*=)?\s*["']?\s*([^"']*)"""
_ENTITIES = {"&#38;": "&amp;", "&#x26;": "&amp;", "&#47;": "/", "&#x2F;": "/", "&#x2f;": "/", "&amp;": "&"}


def _attribute_pattern(name: str) -> str:
    """A tag's value of one attribute, perhaps with quotes, wherever it stands in the tag."""
    return rf"""(?i)["'\s/]{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(url: Column) -> Column:
    """Host and what follows it up to a fragment, an empty path as ``/``: the name under which aliases meet."""
    tail = F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1), F.lit(""))
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail))))


def _split(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def _ordered(rules: dict[str, str]) -> list[tuple[str, str]]:
    """Longest first; of equally long ones, allow before block, then by text."""
    if wrong := set(rules.values()) - {"allow", "block"}:
        raise ValueError(f"a rule allows or blocks, not {sorted(wrong)}")
    return sorted(rules.items(), key=lambda x: (-len(x[0]), x[1], x[0]))


def fitting(df: DataFrame, rules: dict[str, str], host: str = "host", path: str = "path") -> DataFrame:
    """``df`` with the columns rule and action (null where no rule fits) for its host and path."""
    if len(rules) <= MAX_COMPILED:
        rule = action = F.lit(None).cast("string")
        for name, kind in reversed(_ordered(rules)):
            h, p = _split(name)
            fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
            rule, action = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(action)
        return df.withColumns({"rule": rule, "action": action})
    listed = [(n, *_split(x), x, kind) for n, (x, kind) in enumerate(_ordered(rules))]
    table = df.sparkSession.createDataFrame(listed, "n int, h string, p string, rule string, action string")
    pairs = df.select(F.col(host).alias("h0"), F.col(path).alias("p0")).distinct()
    labels = let(F.split("h0", r"\."), lambda x: F.transform(F.sequence(F.lit(1), F.size(x)), lambda i: F.array_join(F.slice(x, i, F.size(x)), ".")))
    met = pairs.select("h0", "p0", F.explode(labels).alias("h")).join(table, "h").where(F.col("p0").startswith(F.col("p")))
    best = met.groupBy("h0", "p0").agg(F.min(F.struct("n", "rule", "action")).alias("b")).select("h0", "p0", "b.rule", "b.action")
    return df.join(best, (F.col(host) == F.col("h0")) & (F.col(path) == F.col("p0")), "left").drop("h0", "p0")


def _plain_path(path: Column) -> Column:
    """A path without its dot segments."""
    segments = F.split(F.regexp_replace(path, "^/", ""), "/")
    up = lambda a, x: F.when(x == "..", F.regexp_replace(a, "/[^/]*$", "")).when(x == ".", a).otherwise(F.concat(a, F.lit("/"), x))
    folder = F.when(F.element_at(segments, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.aggregate(segments, F.lit(""), up), folder)


def _resolved(to: Column, host: Column, path: Column) -> Column:
    """The whole url that ``to`` means on a page; null if it names no other page of the web."""
    cut = lambda x, part: F.regexp_extract(x, r"^([^?#]*)(.*)$", part)
    given = F.when(to.startswith("/"), cut(to, 1)).otherwise(F.concat(F.regexp_replace(path, "[^/]*$", ""), cut(to, 1)))
    return (
        F.when((to == "") | to.startswith("#"), F.lit(None).cast("string"))
        .when(to.startswith("//"), F.concat(F.lit("x:"), to))
        .when(to.rlike(_SCHEME + "//"), to)
        .when(to.rlike(_SCHEME), F.lit(None).cast("string"))
        .when(to.startswith("?"), F.concat(F.lit("x://"), host, path, to))
        .otherwise(F.concat(F.lit("x://"), host, _plain_path(given), cut(to, 2)))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): addresses of a page and of the page that its html names as canonical or redirects to."""
    html, url = F.col("html").cast("string"), F.col("url").cast("string")

    def target(tag: Column) -> Column:
        value = lambda name: F.btrim(F.regexp_extract(tag, _attribute_pattern(name), 1), F.lit("\"' \t\n\r\f"))
        content = value("content")
        soon = F.coalesce(F.nullif(F.regexp_extract(content, _REFRESH, 1), F.lit("")).cast("int") <= MAX_DELAY, F.lit(False))
        return (
            F.when(tag.rlike("(?i)^<link") & F.array_contains(F.split(F.lower(value("rel")), r"\s+"), "canonical"), value("href"))
            .when(tag.rlike("(?i)^<meta") & (F.lower(value("http-equiv")) == "refresh") & soon, F.regexp_extract(content, _REFRESH, 2))
        )

    found = pages.where(html.rlike("(?i)canonical|refresh")).select(
        address_of(url).alias("a"), host_of(url).alias("host"), F.coalesce(F.nullif(path_of(url), F.lit("")), F.lit("/")).alias("path"),
        F.explode(F.transform(F.regexp_extract_all(html, F.lit(_TAG), 1), target)).alias("to"),
    )
    to = F.btrim("to")
    for entity, char in _ENTITIES.items():
        to = F.replace(to, F.lit(entity), F.lit(char))
    links = found.where("a is not null").select("a", address_of(_resolved(to, F.col("host"), F.col("path"))).alias("b"))
    return links.where("b is not null")


def judge(pages: DataFrame, rules: dict[str, str], edges: DataFrame | None = None) -> DataFrame:
    """host, path, rule and verdict of each row of ``pages`` (page_id, url, html).

    ``rules`` maps a rule such as ``example.com/en/`` to ``allow`` or ``block``. ``edges`` (a, b) are
    more pairs of urls that are aliases.
    """
    url = F.col("url").cast("string")
    judged = fitting(pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), address_of(url).alias("address")), rules)
    links = alias_edges(pages)
    if edges is not None:
        links = links.union(edges.select(address_of(F.col("a").cast("string")), address_of(F.col("b").cast("string"))))
    links = materialize(links.where("a <> b").distinct(), "aliases")
    own = F.col("action")
    if links.isEmpty():
        discard(links)
        verdict = F.coalesce(own, F.lit("allow"))
        return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
    classes = materialize(connected(links), "alias-classes")
    named = fitting(classes.withColumns({"h": F.regexp_extract("node", r"^([^/?#]*)", 1), "p": F.regexp_extract("node", r"^[^/?#]*([^?#]*)", 1)}), rules, "h", "p")
    bad = named.where("action = 'block'").select("component").distinct()
    blocked = classes.join(bad, "component", "left_semi").select(F.col("node").alias("address"), F.lit("block").alias("carried"))
    blocked = materialize(blocked, "blocked")
    discard(links, classes)
    verdict = F.coalesce(own, F.col("carried"), F.lit("allow"))
    return judged.join(blocked, "address", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def oracle_sql(rules: dict[str, str]) -> str:
    """The same in DuckDB SQL; components by a recursive query."""
    values = ", ".join(f"({n}, '{_split(x)[0]}', '{_split(x)[1]}', '{x}', '{kind}')" for n, (x, kind) in enumerate(_ordered(rules)))

    quote = lambda x: x.replace("'", "''")

    def rest(url: str) -> str:
        return f"CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"

    def host(url: str) -> str:
        return f"coalesce(translate(regexp_extract({rest(url)}, '^([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '')"

    def address(url: str) -> str:
        tail = f"coalesce(regexp_extract({rest(url)}, '^[^/?#]*([^#]*)', 1), '')"
        return f"CASE WHEN {host(url)} <> '' THEN {host(url)} || CASE WHEN starts_with({tail}, '/') THEN '' ELSE '/' END || {tail} END"

    def value(name: str) -> str:
        return f"trim(regexp_extract(t, '{quote(_attribute_pattern(name))}', 1), '\"'' ' || chr(9) || chr(10) || chr(12) || chr(13))"

    decoded = "trim(target)"
    for entity, char in _ENTITIES.items():
        decoded = f"replace({decoded}, '{entity}', '{char}')"

    def fits(h: str, p: str) -> str:
        return f"(SELECT arg_min(r, n) FROM rules WHERE ({h} = h OR ends_with({h}, '.' || h)) AND starts_with({p}, p))"

    return f"""
WITH RECURSIVE rules(n, h, p, r, act) AS (VALUES {values}),
p0 AS (SELECT row_number() OVER () AS row_id, page_id, {host("url")} AS host, coalesce(regexp_extract({rest("url")}, '^[^/?#]*([^?#]*)', 1), '') AS path, {address("url")} AS address, html FROM pages),
tags AS (SELECT address AS a, host, CASE WHEN path = '' THEN '/' ELSE path END AS path, unnest(regexp_extract_all(html, '{quote(_TAG)}', 1)) AS t FROM p0 WHERE address IS NOT NULL),
named AS (SELECT a, host, path, CASE
  WHEN regexp_matches(t, '(?i)^<link') AND list_contains(regexp_split_to_array(lower({value("rel")}), '\\s+'), 'canonical') THEN {value("href")}
  WHEN regexp_matches(t, '(?i)^<meta') AND lower({value("http-equiv")}) = 'refresh' AND TRY_CAST(regexp_extract({value("content")}, '{quote(_REFRESH)}', 1) AS INT) <= {MAX_DELAY} THEN regexp_extract({value("content")}, '{quote(_REFRESH)}', 2) END AS target FROM tags),
links AS (SELECT a, host, path, {decoded} AS target FROM named),
joined AS (SELECT *, string_split(regexp_replace(CASE WHEN starts_with(target, '/') THEN '' ELSE regexp_replace(path, '[^/]*$', '') END || regexp_extract(target, '^([^?#]*)', 1), '^/', ''), '/') AS s FROM links),
whole AS (SELECT a, CASE WHEN target = '' OR starts_with(target, '#') THEN NULL WHEN starts_with(target, '//') THEN 'x:' || target WHEN regexp_matches(target, '{_SCHEME}//') THEN target
  WHEN regexp_matches(target, '{_SCHEME}') THEN NULL WHEN starts_with(target, '?') THEN 'x://' || host || path || target
  ELSE 'x://' || host || list_reduce(list_prepend('', s), lambda u, x: CASE WHEN x = '..' THEN regexp_replace(u, '/[^/]*$', '') WHEN x = '.' THEN u ELSE u || '/' || x END)
    || CASE WHEN s[-1] IN ('.', '..') THEN '/' ELSE '' END || regexp_extract(target, '^[^?#]*(.*)$', 1) END AS target FROM joined),
one AS (SELECT DISTINCT a, {address("target")} AS b FROM whole),
edges AS (SELECT a, b FROM one WHERE a <> b UNION SELECT b, a FROM one WHERE a <> b),
reach(node, other) AS (SELECT a, a FROM edges UNION SELECT reach.node, edges.b FROM reach JOIN edges ON reach.other = edges.a),
decided AS (SELECT other, {fits("regexp_extract(other, '^([^/?#]*)', 1)", "regexp_extract(other, '^[^/?#]*([^?#]*)', 1)")} AS r FROM (SELECT DISTINCT other FROM reach)),
carried AS (SELECT DISTINCT node FROM reach JOIN decided USING (other) JOIN rules USING (r) WHERE act = 'block'),
judged AS (SELECT page_id, host, path, address, {fits("host", "path")} AS rule FROM p0)
SELECT page_id, host, path, rule, coalesce(act, CASE WHEN node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN rules ON rules.r = judged.rule LEFT JOIN carried ON carried.node = judged.address
"""
