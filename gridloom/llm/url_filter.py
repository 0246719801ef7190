"""URL allow and block rules: a broadcast trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path) of the contract's query.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
_LOWER = {c: c + 32 for c in range(65, 91)}
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most bytes of rule text that are broadcast as a trie, whose objects take some ten times as much in a worker.
MAX_RULE_BYTES = 8 << 20
_RULE = "verdict string, host string, path string"


def build_trie(rules: list[tuple[str, str, str]]) -> dict:
    """Nested dicts: host labels from the right, then under "/" the parts of the path between its slashes.

    A path is cut at all its slashes, the first one included, so "" is one empty part and "/" two: the rule's parts but the last
    are levels of the trie, "=" has the last ones (rule and verdict) and "#" their lengths, longest first. Hosts are lower-cased
    (A-Z), as those of URLs are, without empty labels. Of two rules with the same host and path, block wins.
    """
    root: dict = {}
    for verdict, host, path in sorted(rules, key=lambda r: r[0] == "block"):
        node, labels, path = root, [x for x in (host or "").translate(_LOWER).split(".") if x], path or ""
        host = ".".join(labels)
        for label in reversed(labels):
            node = node.setdefault(label, {})
        node = node.setdefault("/", {})
        *whole, last = path.split("/")
        for segment in whole:
            node = node.setdefault(("seg", segment), {})
        node.setdefault("=", {})[last] = (host + path, verdict)
        node["#"] = sorted({len(x) for x in node["="]}, reverse=True) if len(last) not in node.get("#", ()) else node["#"]
    return root


def lookup(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """The longest rule that fits, by the characters of host and path together; of equally long ones that with the longer host."""
    best, node = None, trie
    segments = path.split("/")
    for label in [*reversed(host.split(".")), None]:
        place, found = node.get("/"), None
        for s in segments:
            if place is None:
                break
            found = next((place["="][s[:n]] for n in place.get("#", ()) if n <= len(s) and s[:n] in place["="]), found)
            place = place.get(("seg", s))
        if found and (best is None or len(found[0]) >= len(best[0])):
            best = found
        if label is None or label not in node:
            break
        node = node[label]
    return best


def _joined(parts: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same verdicts by equality joins, for any number of rules.

    Distinct (host, path) pairs are judged once. A host's suffixes meet the hosts of rules, which bring the lengths of their
    paths, and the path's prefixes of just these lengths meet the rules.
    """
    host = F.filter(F.split(F.translate(F.coalesce("host", F.lit("")), _UPPER, _SMALL), r"\."), lambda x: x != "")
    rules = rules.select("verdict", F.array_join(host, ".").alias("_suffix"), F.coalesce("path", F.lit("")).alias("_prefix"))
    rules = rules.groupBy("_suffix", "_prefix").agg(F.max_by("verdict", F.col("verdict") == "block").alias("_verdict"))
    hosts = rules.groupBy("_suffix").agg(F.collect_set(F.length("_prefix")).alias("_lengths"))
    urls = parts.where("host <> ''").select("host", "path").distinct()
    labels = F.split("host", r"\.")
    ends = urls.withColumn("_suffix", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels) + 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    asked = ends.join(hosts, "_suffix").withColumn("_n", F.explode("_lengths")).where(F.col("_n") <= F.length("path"))
    hits = asked.withColumn("_prefix", F.substring("path", F.lit(1), F.col("_n"))).join(rules, ["_suffix", "_prefix"])
    rule = F.concat("_suffix", "_prefix")
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct(rule.alias("rule"), F.col("_verdict").alias("verdict")), F.struct(F.length(rule), F.length("_suffix"))).alias("_b"))
    out = parts.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("_b.rule").alias("rule"), F.coalesce("_b.verdict", F.lit(default)).alias("verdict"))


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] | DataFrame = RULES,
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
    max_rule_bytes: int = MAX_RULE_BYTES,
) -> DataFrame:
    """Host, path, the longest fitting rule and its verdict for each URL; no rule: ``default``.

    A rule (verdict, host, path) fits its host and all subdomains if the URL's path starts with the rule's; an empty host
    fits all hosts. The rule with most characters (host and path together) wins, then that with the longer host, then block.

    Rules of up to ``max_rule_bytes`` of text are broadcast as a trie, without a shuffle; more are joined, with the same
    results. A null URL, or one without ``://``, has an empty host and path and fits no rule. Repeated rows and null ids are
    kept; an empty table gives an empty result; other columns are not read.
    """
    spark = pages.sparkSession
    if isinstance(rules, DataFrame):
        total = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path"))).first()[0] or 0
    else:
        total = sum(len((h or "").encode()) + len((p or "").encode()) for _, h, p in rules)
    after = F.regexp_extract(F.col(url_col), r"(?s)^.*?://(.*)$", 1)
    parts = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.coalesce(F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), _UPPER, _SMALL), F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"),
    )

    if total > max_rule_bytes:
        return _joined(parts, rules if isinstance(rules, DataFrame) else spark.createDataFrame(rules, _RULE), default)
    listed = [tuple(r) for r in rules.select("verdict", "host", "path").collect()] if isinstance(rules, DataFrame) else rules
    trie = spark.sparkContext.broadcast(build_trie(listed))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [lookup(trie.value, h, p) if h else None for h, p in zip(b["host"].to_pylist(), b["path"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([f and f[0] for f in found], pa.string()), pa.array([f[1] if f else default for f in found], pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    return parts.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")
