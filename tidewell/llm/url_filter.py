"""URL filter with redirect equivalence.

Rules name a host and a path prefix; the longest fitting rule decides. Urls that are the same resource under other names
(canonical links and refresh redirects in pages, and given redirects) are linked, and distributed connected components join
them into classes. A url without a rule of its own takes its class's decision: allow if any member is explicitly allowed, else
block if any member is blocked, else allow. So blocks reach aliases, and an explicit allow, of the url itself or in its class,
comes first. Only urls that stand in a link are in the graph; a page's html is read for its links and never shuffled.

Defined cases: null urls and urls without ``://`` have an empty host and path, fit no rule, have no aliases and are allowed;
null html has no links; links in comments, scripts and styles don't count; a link is resolved against the page's ``<base>``, if
it names one, else its url, and ``.`` and ``..`` in its path are followed; tags of any length and number of attributes are read in
time proportional to the page, and one whose quotes don't close ends at the first ``>``; repeated rows are judged each; links to the page
itself don't count; an empty table gives an empty result; other columns are ignored. The list of rules is a parameter and is held in the plan, so it is for thousands of rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import cut, map_texts
from tidewell.llm.components import connected_components
from tidewell.llm.tags import TagEnds, attributes

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values of the contract.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def key_of(rest: Column) -> Column:
    """A url's node in the graph: host, path and query, whatever the scheme and the fragment."""
    return F.concat(host_of(rest), F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1))


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits (of equals the one with the longer host), or null."""
    row = lambda r: F.struct(F.lit(len(r.name)).alias("size"), F.lit(len(r.host)).alias("host_size"), F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
    fits = lambda r: ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
    found = F.array_max(F.array_compact(F.array(*[F.when(fits(r), row(r)) for r in rules])))
    return found if rules else F.lit(None).cast("struct<size:int,host_size:int,rule:string,verdict:string>")


SILENT = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b.*?(?:</\1\s*+>|\Z)", re.I | re.S)
NAMING = re.compile(r"<(link|meta|base)\b", re.I)
REFRESH = re.compile(r"\burl\s*+=\s*+[\"']?\s*+([^\"'\s>]++)", re.I)
#: The references that stand for characters of urls.
REFERENCES = [(re.compile(p), c) for p, c in (("&(?i:quot|#0*34|#x0*22);?", '"'), ("&(?i:lt|#0*60|#x0*3c);?", "<"), ("&(?i:gt|#0*62|#x0*3e);?", ">"), ("&(?:#0*47|#[xX]0*2[fF]);?", "/"), ("&(?:#0*58|#[xX]0*3[aA]);?", ":"), ("&(?i:amp|#0*38|#x0*26);?", "&"))]
HOST_PATH = re.compile(r"([^/?#]*)([^?#]*)([^#]*)", re.S)
TO_LOWER = str.maketrans(UPPER, LOWER)


def decoded(value: str | None) -> str | None:
    """An attribute's value with its references decoded; null if it is empty."""
    value = (value or "").strip(" ")
    if "&" in value:
        for pattern, char in REFERENCES:
            value = pattern.sub(char, value)
    return value or None


def linked_urls(html: str) -> tuple[list[str], str | None]:
    """The targets of canonical links and refresh redirects, as written, and the page's base."""
    read = SILENT.sub(" ", html)
    last, ends, at, to, base = read.rfind(">") + 1, TagEnds(read), 0, [], None
    while (m := NAMING.search(read, at, last)) is not None:
        at, name = ends.after(m.end()), m[1].lower()
        has = attributes(read[m.end() : at - 1])
        target = None
        if name == "link" and "canonical" in (decoded(has.get("rel")) or "").lower().split():
            target = decoded(has.get("href"))
        elif name == "meta" and (decoded(has.get("http-equiv")) or "").lower() == "refresh":
            found = REFRESH.search(decoded(has.get("content")) or "")
            target = found[1] if found else None
        elif name == "base":
            base = base or decoded(has.get("href"))
        if target:
            to.append(target)
    return to, base


def followed(rest: str) -> str:
    """``rest`` (host, path and more) without ``.`` and ``..`` steps in its path."""
    host, path, _ = HOST_PATH.match(rest).groups()
    steps = path[1:].split("/")
    if not path or not {".", ".."} & set(steps):
        return rest
    kept: list[str] = []
    for x in steps:
        if x == "..":
            del kept[-1:]
        elif x != ".":
            kept.append(x)
    if steps[-1] in (".", ".."):
        kept.append("")
    return f"{host}/{'/'.join(kept)}{rest[len(host) + len(path) :]}"


def resolved(target: str, rest: str) -> str | None:
    """``target`` as what follows a scheme, seen from the page at ``rest``; null if it isn't on the web."""
    host, path, _ = HOST_PATH.match(rest).groups()
    if re.match("https?://", target, re.I):
        out = target[target.index("://") + 3 :]
    elif target.startswith("//"):
        out = target[2:]
    elif re.match("[A-Za-z][A-Za-z0-9+.-]*+:", target):
        return None
    elif target.startswith("/"):
        out = host + target
    elif target.startswith("#"):
        out = rest
    elif target.startswith("?"):
        out = host + path + target
    else:
        out = host + (path[: path.rindex("/") + 1] if path else "/") + target
    return followed(out)


def node_of(rest: str) -> str:
    """As :func:`key_of`."""
    host, path, query = HOST_PATH.match(rest).groups()
    return host.translate(TO_LOWER) + path + query


def page_links(pages: DataFrame) -> DataFrame:
    """``u, v``: nodes of pages and of what they name as themselves. Only pages that may hold such links go to Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for url, html in zip(batch.column(0), batch.column(1)):
                rest = url.as_py().split("://", 1)[1]
                to, base = linked_urls(html.as_py())
                seen_from = (resolved(base, rest) if base else None) or rest
                ends = (resolved(t, seen_from) for t in to)
                found += [(u, v) for u, v in ((node_of(rest), node_of(e)) for e in ends if e is not None) if u != v]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], names=["u", "v"])

    may = F.col("html").rlike(r"(?i)<link|<meta") & F.col("html").rlike(r"(?i)canonical|refresh") & (F.instr("url", "://") > 0)
    return map_texts(pages.filter(may).select("url", "html"), run, "u string, v string")


def decide(pages: DataFrame, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict``. ``redirects`` has urls ``source`` and ``target``."""
    edges = page_links(pages)
    if redirects is not None:
        given = redirects.select(key_of(after_scheme(F.col("source"))).alias("u"), key_of(after_scheme(F.col("target"))).alias("v"))
        edges = edges.unionByName(given.filter("u is not null and v is not null and u != v"))
    nodes = connected_components(edges)
    own = fitting_rule(host_of(F.col("node")), path_of(F.col("node")), rules)
    nodes = nodes.withColumn("own", own["verdict"])
    classes = nodes.groupBy("component").agg(F.bool_or(F.col("own") == "allow").alias("allowed"), F.bool_or(F.col("own") == "block").alias("blocked"))
    classes = classes.filter("allowed or blocked").select("component", F.when(F.col("allowed"), "allow").otherwise("block").alias("class_verdict"))
    decided = cut(nodes.join(classes, "component").select(F.col("node").alias("key"), "class_verdict", "component"))

    rest = after_scheme(F.col("url"))
    judged = pages.select(F.col("page_id").cast("long").alias("page_id"), rest.alias("rest"))
    judged = judged.select("page_id", F.coalesce(host_of(F.col("rest")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("rest")), F.lit("")).alias("path"), key_of(F.col("rest")).alias("key"))
    judged = judged.withColumn("own", fitting_rule(F.col("host"), F.col("path"), rules))
    if decided.limit(1).count():
        judged = judged.join(decided, "key", "left")
    else:
        judged = judged.withColumns({"class_verdict": F.lit(None).cast("string"), "component": F.lit(None).cast("string")})
    verdict = F.coalesce(F.col("own")["verdict"], "class_verdict", F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("own")["rule"].alias("rule"), verdict.alias("verdict"), F.col("component").alias("alias_class"))
