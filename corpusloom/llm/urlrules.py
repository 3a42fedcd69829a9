"""URL filter rules as a sort-merge range join over reversed-host keys, in column expressions only.

A host is written backwards, each label followed by a dot (``org.example.``), so a rule's host and all its subdomains
are the interval of keys that begin with the rule's key. Intervals of prefixes are nested or apart. Points and rules
are sorted together; a sweep over them keeps the stack of rules whose interval is open, and drops those that have
ended when it meets a key outside of them.

The sweep is cut into blocks by Spark's range partitioning. The stacks at the rules themselves are folded block by
block, and block ends are folded again (by thousands, recursively), so no task holds all rules. A point takes the stack
of the last rule before it - in its block, or carried from an earlier one - without the rules that have ended.

A rule with a path is an interval only among the keys of its own host and path. So there are two sweeps: the first finds
the rule hosts above each host, the second the paths below each of these rule hosts. Distinct (host, path) pairs are
swept, so a URL that a third of all rows repeat is judged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import carried, ordered_blocks
from .common import stored

#: Rules, or blocks of rules, that are folded in one row.
FOLD = 1000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STACK = "array<struct<key:string,value:string>>"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased, with user and port if given) and path of a URL; both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """The host's labels from the last to the first, each with a dot behind it; empty for an empty host."""
    labels = F.reverse(F.split(host, r"\.", -1))
    return F.when(host == "", "").otherwise(F.concat(F.array_join(labels, "."), F.lit(".")))


def _open(stack: Column, key: Column) -> Column:
    """The entries of a stack whose interval holds ``key``: those that end before it are popped."""
    return F.filter(stack, lambda rule: F.startswith(key, rule.key))


def _pushed(rules: Column, entry) -> Column:
    """The stacks at each of the sorted ``rules`` of a block: pop what has ended, push the rule."""

    def step(done, rule):
        before = F.coalesce(F.try_element_at(done, F.lit(-1)), F.array().cast(STACK))
        return F.concat(done, F.array(F.concat(_open(before, rule.key), F.array(entry(rule)))))

    return F.aggregate(rules, F.array().cast(f"array<{STACK}>"), step)


def _entries(units: DataFrame, n: int) -> DataFrame:
    """(block, entry): what the stack holds before each block; rules that have ended since may be among them.

    ``units`` has block (0 to n - 1, some may be missing) and ``tail``, the stack after the block's own rules.
    """
    empty = F.array().cast(STACK)
    group = units.groupBy(F.floor(F.col("block") / FOLD).cast("int").alias("group"))
    rows = group.agg(F.array_sort(F.collect_list(F.struct("block", "tail"))).alias("units"))
    first = F.array(F.struct(F.lit(-1).alias("block"), empty.alias("entry"), empty.alias("after")))

    def step(done, unit):
        after = F.element_at(done, -1).after
        last = F.element_at(unit.tail, -1).key
        return F.concat(done, F.array(F.struct(unit.block.alias("block"), after.alias("entry"), F.concat(_open(after, last), unit.tail).alias("after"))))

    folded = rows.select("group", F.aggregate("units", first, step).alias("done"))
    inner = folded.select("group", F.explode("done").alias("u")).where("u.block >= 0").select("group", "u.block", "u.entry")
    if n <= FOLD:
        return inner.select("block", "entry")
    tails = folded.select(F.col("group").alias("block"), F.element_at("done", -1).after.alias("tail"))
    above = _entries(tails, n // FOLD + 1).select(F.col("block").alias("group"), F.col("entry").alias("above"))
    return inner.join(above, "group").select("block", F.concat("above", "entry").alias("entry"))


def stacked(rules: DataFrame) -> DataFrame:
    """(key, stack) of ``rules`` (key: distinct, value): the rules that are prefixes of each, shortest first, itself last."""
    rules = stored(rules, "rules")
    n = rules.count() // FOLD + 1
    cut = ordered_blocks(rules, ["key"], "rules", n)
    folded = cut.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("rules"))
    folded = stored(folded.select("block", _pushed(F.col("rules"), lambda rule: rule).alias("stacks")), "stacks")
    entry = _entries(folded.select("block", F.element_at("stacks", -1).alias("tail")), n)
    each = folded.join(entry, "block").select("entry", F.explode("stacks").alias("own"))
    key = F.element_at("own", -1).key
    return each.select(key.alias("key"), F.concat(_open(F.col("entry"), key), "own").alias("stack"))


def rules_above(points: DataFrame, rules: DataFrame) -> DataFrame:
    """``points`` (key and further columns) with ``stack``: the ``rules`` (key: distinct, value) that are prefixes of the key."""
    others = [c for c in points.columns if c != "key"]
    kinds = dict(points.dtypes)
    marks = stacked(rules).select("key", *[F.lit(None).cast(kinds[c]).alias(c) for c in others], "stack")
    both = points.select("key", *others, F.lit(None).cast(STACK).alias("stack")).unionByName(marks)
    cut = ordered_blocks(both, ["key", *others], "sweep")
    # a rule comes before the points of its own key
    so_far = Window.partitionBy("block").orderBy("key", F.col("stack").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    tails = cut.groupBy("block").agg(F.max_by("stack", F.when(F.col("stack").isNotNull(), F.col("key"))).alias("tail"))
    swept = cut.withColumn("latest", F.last("stack", ignorenulls=True).over(so_far)).where("stack IS NULL").drop("stack")
    stack = F.coalesce("latest", "before", F.array().cast(STACK))
    return swept.join(carried(tails, "tail"), "block", "left").select("key", *others, _open(stack, F.col("key")).alias("stack"))


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of ``pages`` (page_id, url) by ``rules`` (host, path, verdict).

    A rule fits its host and all subdomains if the URL's path begins with the rule's path. The longest rule wins
    (characters of host and path together; then of the host alone); a URL that no rule fits gets ``default`` and a null
    rule. Of rules that repeat a host and path the one with the greatest verdict counts (block before allow); rules with
    a null are left out, and those whose path is neither empty nor begins with a slash fit nothing. A rule with an
    empty host fits every host. A null URL, and one without ``://``, has an empty host and path. Rows that repeat each get their verdict;
    further columns don't matter and aren't returned; empty tables give no rows or the default.
    """
    host, path = host_and_path(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    low = F.translate("host", UPPER, LOWER)
    known = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL AND (path = '' OR startswith(path, '/'))")
    known = known.groupBy(low.alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    known = stored(known.select(host_key(F.col("host")).alias("key"), "host", "path", "verdict"), "rules")

    pairs = pages.select("host", "path").distinct().select(host_key(F.col("host")).alias("key"), "host", "path")
    hosts = rules_above(pairs, known.select("key").distinct().withColumn("value", F.lit(None).cast("string")))
    # one point for each rule host above: that host's key and the URL's path
    tried = hosts.select("host", "path", F.explode("stack.key").alias("above")).select(F.concat("above", "path").alias("key"), "host", "path")
    whole = F.to_json(F.struct(F.concat("host", "path").alias("rule"), F.length("host").alias("labels"), "verdict"))
    fits = rules_above(tried, known.select(F.concat("key", "path").alias("key"), whole.alias("value"))).where("size(stack) > 0")
    top = F.from_json(F.element_at("stack", -1).value, "rule string, labels int, verdict string").alias("top")
    best = fits.select("host", "path", top).groupBy("host", "path").agg(F.max(F.struct(F.length("top.rule").alias("size"), "top.labels", "top.rule", "top.verdict")).alias("top"))
    rule = best.select("host", "path", F.col("top.rule").alias("rule"), F.col("top.verdict").alias("verdict"))
    return pages.join(rule, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
