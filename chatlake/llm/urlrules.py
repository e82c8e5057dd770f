"""URL filters: pattern rules found through their rarest literal token.

Every rule is a regular expression with literal tokens. The index files it under the one of its tokens that the table's
URLs hold least often; a URL's tokens fetch the rules filed under them, and only those rules' expressions run. Rules without a
token of their own run on every URL. Among fitting rules the longest wins; where none fits, the default patterns decide, found in
the same way.

Rules come from code (`host_rule`) or from lines of a filter list (`parse_rule`). Up to MOST_RULES of them travel to the tasks; of
a longer list those with a token become a table of (token, rule), which is joined to the URLs' tokens by a shuffle, with equal results.

Defined cases: a null URL, or one without `://`, has empty host and path, fits no host rule and is allowed; equally long fitting
rules are decided by name, the last in code-point order; very long URLs are judged whole; rows with equal ids are each judged; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, written


TOKEN = re.compile(r"[A-Za-z0-9]+")
#: Rules that travel to every task; each some hundred bytes.
MOST_RULES = 50_000
#: Blocked by default: (name, pattern, literal tokens of which one is in every match).
DEFAULT_PATTERNS = [
    ("download", r"\.(?:exe|apk|msi)(?:\Z|[?#])", ("exe", "apk", "msi")),
    ("adult", r"://(?:[^/?#]*[.-])?(?:porn|xxx)[.-]", ("porn", "xxx")),
    ("casino", r"[/.-]casino[/.-]", ("casino",)),
    ("tracker", r"[?&](?:gclid|fbclid)=", ("gclid", "fbclid")),
]


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    weight: int
    any_token: bool = False


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains, with a path that starts with `path`."""
    return Rule(f"{host}{path}", rf"^://(?:[^/?#]*\.)?(?i:{re.escape(host)}){re.escape(path)}" + ("" if path else r"(?=[/?#]|\Z)"), tuple(t.lower() for t in TOKEN.findall(host)), verdict, len(host) + len(path))


SEPARATOR = r"(?:[^\w.%-]|\Z)"
_OPTIONS = re.compile(r"\$(?P<names>~?[a-z-]+(?:=[^,]*)?(?:,~?[a-z-]+(?:=[^,]*)?)*)\Z")


def parse_rule(line: str) -> Rule | None:
    """A line of a filter list: `||host^` and `|` anchor, `*` stands for anything, `^` for a separator or the end, `@@` allows, and
    what stands between slashes is a regular expression if it has a sign of one (`/ads/` is a part of a path).

    Of options, `match-case`, `document` and `all` are known; a rule with another concerns parts of pages, or what a URL doesn't tell,
    and gives None, as do comments, headings and rules on elements.
    """
    text = line.strip()
    if not text or text[0] in "![" or "##" in text or "#@#" in text:
        return None
    verdict, body = ("allow", text[2:]) if text.startswith("@@") else ("block", text)
    names: set[str] = set()
    if found := _OPTIONS.search(body):
        names, body = set(found["names"].split(",")), body[: found.start()]
    if names - {"match-case", "document", "all"} or not body.strip("|*^"):
        return None
    if len(body) > 2 and body[0] == body[-1] == "/":  # a regular expression, which has no token of its own
        try:
            re.compile(body[1:-1])
        except re.error:
            return None
        if re.search(r"[\\\[\](){}+?|^$]|\.\*", body[1:-1]):
            return Rule(text, body[1:-1] if "match-case" in names else f"(?i:{body[1:-1]})", (), verdict, len(body) - 2)
    host, start, end = body.startswith("||"), body.startswith("|") and not body.startswith("||"), body.endswith("|")
    core = body[2 if host else int(start) : len(body) - end]
    middle = "".join(".*" if c == "*" else SEPARATOR if c == "^" else re.escape(c) for c in core)
    pattern = (r"\A[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?" if host else r"\A" if start else "") + middle + (r"\Z" if end else "")
    # a token counts if the rule says what stands on either side of it
    closed = ("^" if host or start else "*") + core + ("^" if end else "*")
    tokens = re.findall(r"(?<![A-Za-z0-9*])[A-Za-z0-9]+(?![A-Za-z0-9*])", closed)
    return Rule(text, pattern if "match-case" in names else f"(?i:{pattern})", tuple(t.lower() for t in tokens), verdict, len(core))


def token_counts(urls: DataFrame, url_col: str, wanted: set[str]) -> dict[str, int]:
    """How many URLs hold each of the rules' tokens; as many rows as the rules have tokens."""
    tokens = urls.select(F.explode(F.array_distinct(F.split(F.lower(F.col(url_col)), "[^a-z0-9]+"))).alias("token"))
    known = urls.sparkSession.createDataFrame([(t,) for t in sorted(wanted)], "token string")
    return {r.token: r["count"] for r in tokens.join(F.broadcast(known), "token", "left_semi").groupBy("token").count().collect()}


def index_rules(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Rules by token; those without a token are under the empty one."""
    index: dict[str, list[Rule]] = defaultdict(list)
    for rule in rules:
        rarest = rule.tokens if rule.any_token else [min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default="")]
        for token in rarest:
            index[token].append(rule)
    return dict(index)


def split_url(url: str | None) -> tuple[str, str]:
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = re.search(r"[/?#]|$", rest).start()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    return host, re.match(r"[^?#]*", rest[end:])[0]


def seen_by(rule: Rule, url: str, host: str, path: str) -> str:
    """What a rule's expression sees: host rules the first :// with host and path, patterns the whole URL."""
    return f"://{host}{path}" if rule.pattern.startswith("^://") else url


def _best(fits: list[Rule]) -> Rule | None:
    return max(fits, key=lambda r: (r.weight, r.name), default=None)


def judge_urls(pages: DataFrame, rules: list[Rule], defaults: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule (null where none fits), verdict, matched (a default pattern's name)."""
    if sum(bool(r.tokens) for r in rules) > MOST_RULES:
        return judged_by_join(pages, rules, defaults, id_col, url_col)
    return judged_in_tasks(pages, rules, defaults, id_col, url_col)


def judged_in_tasks(pages: DataFrame, rules: list[Rule], defaults: list[Rule], id_col: str, url_col: str) -> DataFrame:
    """judge_urls with all rules in every task. Rules without a token run on every URL, in any form."""
    counts = token_counts(pages, url_col, {t for r in [*rules, *defaults] for t in r.tokens})
    own, fallback = index_rules(rules, counts), index_rules(defaults, counts)

    def judge(batches):
        compiled: dict[str, re.Pattern] = {}

        def best(index, url, host, path, tokens):
            fits = []
            for token in ("", *tokens):
                for rule in index.get(token, ()):
                    pattern = compiled.get(rule.pattern) or compiled.setdefault(rule.pattern, re.compile(rule.pattern))
                    if pattern.search(seen_by(rule, url, host, path)):
                        fits.append(rule)
            return _best(fits)

        for batch in (part for whole in batches for part in slices(whole)):
            out = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                tokens = {t.lower() for t in TOKEN.findall(url or "")}
                rule = best(own, url, host, path, tokens) if url and "://" in url else None
                default = None if rule else best(fallback, url or "", host, path, tokens)
                out.append((host, path, rule and rule.name, rule.verdict if rule else default.verdict if default else "allow", default and default.name))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], names=["id", "host", "path", "rule", "verdict", "matched"])

    kind = pages.schema[id_col].dataType.simpleString()
    judged = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).mapInArrow(judge, f"id {kind}, host string, path string, rule string, verdict string, matched string")
    return judged.withColumnRenamed("id", id_col)


def judged_by_join(pages: DataFrame, rules: list[Rule], defaults: list[Rule], id_col: str, url_col: str) -> DataFrame:
    """judge_urls for a list of rules of any length: rules meet URLs by a join on the rules' rarest token."""
    spark = pages.sparkSession
    loose = [r for r in rules if not r.tokens]  # every URL has to meet these
    table = written(spark.createDataFrame([(i, r.name, r.pattern, list(r.tokens), r.verdict, r.weight) for i, r in enumerate(rules) if r.tokens], "rid int, name string, pattern string, tokens array<string>, verdict string, weight int"), "url-rules")
    urls = written(pages.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(url_col).alias("url")), "urls")
    held = urls.where(F.contains("url", F.lit("://"))).select("uid", "url", F.explode(F.array_distinct(F.transform(F.split("url", "[^A-Za-z0-9]+"), F.lower))).alias("token")).where("token <> ''")
    seen = held.groupBy("token").agg(F.count("*").alias("n"))
    each = table.select("rid", F.explode(F.array_distinct("tokens")).alias("token")).join(seen, "token", "left")
    rarest = each.groupBy("rid").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), -F.char_length("token"), "token")).alias("token"))
    index = written(table.drop("tokens").join(rarest, "rid"), "url-index")

    def match(batches):
        compiled: dict[str, re.Pattern] = {}
        for batch in (part for whole in batches for part in slices(whole)):
            ok = []
            for url, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if len(compiled) > MOST_RULES:
                    compiled.clear()
                pattern = compiled.get(text) or compiled.setdefault(text, re.compile(text))
                ok.append(pattern.search(f"://{''.join(split_url(url))}" if text.startswith("^://") else url) is not None)
            yield batch.filter(pa.array(ok, pa.bool_())).select(["uid", "name", "verdict", "weight"])

    met = held.join(index, "token").select("uid", "url", "pattern", "name", "verdict", "weight")
    fits = met.mapInArrow(match, "uid long, name string, verdict string, weight int")
    best = fits.groupBy("uid").agg(F.max(F.struct("weight", "name", "verdict")).alias("best"))
    others = judged_in_tasks(urls, loose, defaults, "uid", "url")
    weights = spark.createDataFrame([(r.name, r.weight) for r in {r.name: r for r in loose}.values()], "rule string, w int")
    both = others.join(weights, "rule", "left").join(best, "uid", "left").join(urls.select("uid", "id"), "uid")
    wins = F.col("best").isNotNull() & (F.col("rule").isNull() | (F.struct(F.col("best.weight"), F.col("best.name")) > F.struct("w", "rule")))
    return both.select(F.col("id").alias(id_col), "host", "path", F.when(wins, F.col("best.name")).otherwise(F.col("rule")).alias("rule"), F.when(wins, F.col("best.verdict")).otherwise(F.col("verdict")).alias("verdict"), F.when(~wins | wins.isNull(), F.col("matched")).alias("matched"))


CONTRACT_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def default_rules() -> list[Rule]:
    return [Rule(name, pattern, tokens, "block", len(pattern), True) for name, pattern, tokens in DEFAULT_PATTERNS]


def op6_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge_urls(pages, [host_rule(*r) for r in CONTRACT_RULES], default_rules()).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r AS (
  SELECT *, CASE
      WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(coalesce(url, ''), '\.(?:exe|apk|msi)(?:$|[?#])') OR regexp_matches(coalesce(url, ''), '://(?:[^/?#]*[.-])?(?:porn|xxx)[.-]')
      OR regexp_matches(coalesce(url, ''), '[/.-]casino[/.-]') OR regexp_matches(coalesce(url, ''), '[?&](?:gclid|fbclid)=') THEN 'block'
    ELSE 'allow' END AS verdict
FROM r
"""
