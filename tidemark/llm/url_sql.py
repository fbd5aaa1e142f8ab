"""SQL for the URL filters: the links of pages, their components, and the rules."""

from __future__ import annotations

from collections.abc import Sequence

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _attribute(name: str) -> str:
    value = r"""("[^"]*"|''[^'']*''|[^\s"''>]+)"""
    found = rf"regexp_extract(tag, '(?is)\b{name}\s*=\s*{value}', 1)"
    quotes = "'\"'''"
    return f"trim(replace(translate({found}, {quotes}, ''), '&amp;', '&'))"


def _node(url: str) -> str:
    """Columns h, p and node of a URL."""

    def part(pattern: str) -> str:
        return f"coalesce(regexp_extract({url}, '{pattern}', 1), '')"

    h = f"translate({part('(?s)^.*?://([^/?#]*)')}, '{_UPPER}', '{_LOWER}')"
    p, q = part("(?s)^.*?://[^/?#]*([^?#]*)"), part(r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)")
    return f"{h} AS h, {p} AS p, CASE WHEN {h} <> '' THEN {h} || CASE WHEN {p} = '' THEN '/' ELSE {p} END || {q} END AS node"


def _ruled(table: str, key: str) -> str:
    """The longest fitting rule of each row of a table with h and p."""
    fits = "(x.h = r.host OR ends_with(x.h, '.' || r.host)) AND starts_with(x.p, r.path)"
    return f"SELECT DISTINCT ON (x.{key}) x.{key}, r.host || r.path AS rule, r.verdict FROM {table} x JOIN rules r ON {fits} ORDER BY x.{key}, length(r.host || r.path) DESC, r.o"


def sql(rules: Sequence[tuple[str, str, str]]) -> str:
    shown = ", ".join(str((i, *r)) for i, r in enumerate(rules))
    return rf"""
WITH RECURSIVE rules(o, host, path, verdict) AS (VALUES {shown}),
pages_ AS (SELECT row_number() OVER () AS r, page_id, {_node("url")} FROM pages),
tags AS (
  SELECT url, tag, regexp_extract(url, '^(.*?)://', 1) AS scheme, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS root, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages WHERE contains(url, '://') AND regexp_matches(html, '(?i)canonical|http-equiv'))),
wanted AS (
  SELECT *, CASE WHEN regexp_matches(tag, '(?i)^<link') AND list_contains(regexp_split_to_array(lower({_attribute("rel")}), '[ \t\n\f\r]+'), 'canonical') THEN {_attribute("href")}
    WHEN regexp_matches(tag, '(?i)^<meta') AND lower({_attribute("http-equiv")}) = 'refresh' THEN trim(regexp_extract({_attribute("content")}, '(?i)url\s*=\s*(.*)$', 1)) END AS t FROM tags),
targets AS (
  SELECT url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.\-]*://') THEN t WHEN starts_with(t, '//') THEN scheme || ':' || t WHEN starts_with(t, '/') THEN root || t
    WHEN starts_with(t, '#') OR starts_with(t, '?') THEN root || path || t ELSE root || CASE WHEN contains(path, '/') THEN regexp_extract(path, '(?s)^(.*/)', 1) ELSE '/' END || t END AS target
  FROM wanted WHERE t <> ''),
sources AS (SELECT target, node AS a FROM (SELECT target, {_node("url")} FROM targets)),
ends AS (SELECT DISTINCT a, node AS b FROM (SELECT a, {_node("target")} FROM sources) WHERE a IS NOT NULL AND node IS NOT NULL),
edges AS (SELECT a, b FROM ends UNION SELECT b, a FROM ends),
reach AS (SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
nodes AS (SELECT b AS name, {_node("'x://' || b")} FROM (SELECT DISTINCT b FROM edges)),
said AS ({_ruled("nodes", "name")}),
bad AS (SELECT a FROM reach LEFT JOIN said ON reach.b = said.name GROUP BY a HAVING bool_or(coalesce(verdict = 'block', false)) AND NOT bool_or(coalesce(verdict = 'allow', false))),
own AS ({_ruled("pages_", "r")})
SELECT page_id, h AS host, p AS path, rule, coalesce(own.verdict, CASE WHEN bad.a IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM pages_ LEFT JOIN own USING (r) LEFT JOIN bad ON bad.a = pages_.node"""
