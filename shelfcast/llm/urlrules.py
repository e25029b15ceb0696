"""URL filters by pattern rules, found through their rarest literal token.

A rule is a regular expression over the url. It is filed under the one of its literal
tokens that the fewest urls hold; a url looks up its own tokens, and only the rules filed
under those are run.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

# Ranks: a rule that is asked for goes before the method's own ones, and of those an exception
# before a block.
BLOCKS, EXCEPTION, ASKED = 0, 1, 2


@dataclass(frozen=True)
class Rule:
    """``tokens`` must stand whole in every url that matches ``pattern``.

    Of the matching rules the highest rank wins, then the longest ``name``, then its text.
    """

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int = BLOCKS


def host_path_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule for a host with all its subdomains and every path that starts as given.

    All labels of the host stand whole in a url that fits; of the path only what a
    separator follows.
    """
    whole = re.findall(r"[a-z0-9]+(?=[^A-Za-z0-9])", path.lower())
    labels = re.findall(r"[a-z0-9]+", host)
    # The first "://" of a url opens its host.
    pattern = r"(?s)^(?:(?!://).)*://(?:[^/?#]*\.)?(?i:" + re.escape(host) + ")" + re.escape(path)
    return Rule(host + path, verdict, pattern, tuple(dict.fromkeys([*labels, *whole])), ASKED)


BASE = [
    host_path_rule("org", "/", "allow"),
    host_path_rule("example.org", "/es/", "block"),
    host_path_rule("example.org", "/en/1", "block"),
    host_path_rule("com", "/fr/", "allow"),
    host_path_rule("com", "/de/", "block"),
]


def word_rule(word: str) -> Rule:
    """Blocks urls that hold a word between separators, wherever it stands."""
    return Rule(f"word:{word}", "block", rf"(?i)(?:^|[^a-z0-9]){word}(?:[^a-z0-9]|$)", (word,))


def session_rule(name: str) -> Rule:
    return Rule(f"param:{name}", "block", rf"(?i)[?&]{name}=", (name,))


def file_rule(ending: str) -> Rule:
    return Rule(f"ext:{ending}", "block", rf"(?i)^[^?#]*\.{ending}(?:[?#]|$)", (ending,))


WORDS = "porn xxx sex casino poker viagra torrent warez login signup cart checkout".split()
SESSIONS = ["sessionid", "phpsessid"]
ENDINGS = "jpg jpeg png gif zip exe mp3 mp4 pdf".split()
# The method's own rules: places that training text should not come from, printouts and
# sessions that repeat pages found elsewhere, and files that hold no text. Every rule has a
# token of its own, so none runs on every url.
OWN = [
    *map(word_rule, WORDS),
    Rule("param:print", "block", r"(?i)[?&]print=(?:1|true|yes)(?:[&#]|$)", ("print",)),
    *map(session_rule, SESSIONS),
    *map(file_rule, ENDINGS),
]


def filter_rules(text: str) -> list[Rule]:
    """Rules from the lines of a filter list.

    A line is text to be found in a url, in any case. ``*`` stands for any text and ``^`` for
    a separator (neither letter, digit nor one of ``_-.%``) or the end; ``||`` at the front is
    the start of the host or of one of its labels, ``|`` the start or the end of the url, and
    ``@@`` makes the line an exception. Lines that begin with ``!`` and empty ones are
    comments; options after ``$`` are refused.
    """
    rules = []
    for line in map(str.strip, text.splitlines()):
        if not line or line.startswith("!"):
            continue
        body, verdict, rank = (line[2:], "allow", EXCEPTION) if line.startswith("@@") else (line, "block", BLOCKS)
        if "$" in body:
            raise ValueError(f"options are not supported: {line}")
        front = re.match(r"\|{0,2}", body).group()
        inner = body[len(front):]
        back = "|" if inner.endswith("|") else ""
        inner = inner.removesuffix("|").lower()
        start = {"||": r"^[^:/?#]*://(?:[^/?#]*\.)?", "|": "^", "": ""}[front]
        body = "".join({"*": ".*", "^": r"(?:[^a-z0-9_.%-]|$)"}.get(c, re.escape(c)) for c in inner)
        # A run stands whole where what is around it can be no letter or digit.
        edges = f"{front or '*'}{inner}{back or '*'}"
        whole = re.findall(r"(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])", edges)
        rules.append(Rule(line, verdict, f"(?is){start}{body}{'$' if back else ''}", tuple(dict.fromkeys(whole)), rank))
    return rules


TOKEN = re.compile("[a-z0-9]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def url_tokens(url: Column) -> Column:
    """Distinct runs of ASCII letters and digits, A-Z lower-cased."""
    lower = F.translate(url, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.filter(F.split(lower, "[^a-z0-9]+"), lambda t: t != ""))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^(?:(?!://).)*://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?:(?!://).)*://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_index(tokens: DataFrame, rules: list[Rule]) -> dict[str, list[Rule]]:
    """Rules by their rarest token, counted over all urls; "" holds rules without one.

    The driver gets one count per token of the rules, never one per url or url token.
    """
    wanted = sorted({t for r in rules for t in r.tokens})
    seen = tokens.select(F.explode("_tokens").alias("t")).filter(F.col("t").isin(wanted))
    counts = dict(seen.groupBy("t").count().collect()) if wanted else {}
    index: dict[str, list[Rule]] = {}
    for rule in rules:
        token = min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default="")
        index.setdefault(token, []).append(rule)
    return index


VERDICTS = "page_id {id}, host string, path string, rule string, verdict string, own_rule string"


def judged(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id``, ``host``, ``path``, the deciding rule and ``verdict``; allow if none fits.

    A null url has no tokens, empty host and path, and is allowed. Rules that decide with
    rank ``ASKED`` are named in ``rule``, the method's own in ``own_rule``. Repeated
    rows are judged one by one, and nothing is shuffled but the token counts.
    """
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("_url"))
    index = rule_index(rows.select(url_tokens(F.col("_url")).alias("_tokens")), rules)
    held = pages.sparkSession.sparkContext.broadcast(index)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filed, compiled = held.value, functools.cache(lambda rule: re.compile(rule.pattern, re.ASCII))
        for batch in batches:
            columns = [[] for _ in range(3)]
            for text in batch.column("_url").to_pylist():
                text = text or ""
                own = ["", *dict.fromkeys(TOKEN.findall(text.translate(LOWER)))]
                best = max((order(r) for t in own for r in filed.get(t, ()) if compiled(r).search(text)),
                           default=(BLOCKS, 0, None, "allow"))
                rank, _, name, verdict = best
                asked = rank == ASKED
                for column, value in zip(columns, (name if asked else None, verdict, None if asked else name)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("page_id", "host", "path")], *[pa.array(c, pa.string()) for c in columns]],
                ["page_id", "host", "path", "rule", "verdict", "own_rule"])

    kind = pages.schema[key].dataType.simpleString()
    return rows.select("page_id", "_url", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path")
                       ).mapInArrow(judge, VERDICTS.format(id=kind))


def order(rule: Rule) -> tuple[int, int, str, str]:
    return rule.rank, len(rule.name), rule.name, rule.verdict


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url; null and odd urls, repeated rows and empty tables as ``judged`` says."""
    return judged(shared.table(spark, sf_dir, "pages"), BASE + OWN)


_OWN_SQL = ",\n      ".join([
    *[f"CASE WHEN regexp_matches(url, '(?i)(^|[^a-z0-9]){w}([^a-z0-9]|$)') THEN 'word:{w}' END" for w in WORDS],
    "CASE WHEN regexp_matches(url, '(?i)[?&]print=(1|true|yes)([&#]|$)') THEN 'param:print' END",
    *[f"CASE WHEN regexp_matches(url, '(?i)[?&]{w}=') THEN 'param:{w}' END" for w in SESSIONS],
    *[rf"CASE WHEN regexp_matches(url, '(?i)^[^?#]*\.{w}([?#]|$)') THEN 'ext:{w}' END" for w in ENDINGS]])
SQL = rf"""
WITH cut AS (
  SELECT page_id, url, strpos(url, '://') AS place FROM pages
), split AS (
  SELECT page_id, url, CASE WHEN place > 0 THEN substr(url, place + 3) ELSE '' END AS rest FROM cut
), parts AS (
  SELECT page_id, url,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM split
), fits AS (
  SELECT *,
    CASE
      WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
      WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
      WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
      WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
      WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/'
    END AS rule,
    list_reverse_sort(list_transform(list_filter([
      {_OWN_SQL}
    ], lambda n: n IS NOT NULL), lambda n: {{'size': length(n), 'name': n}}))[1].name AS own
  FROM parts
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN own IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NULL THEN own END AS own_rule
FROM fits"""
