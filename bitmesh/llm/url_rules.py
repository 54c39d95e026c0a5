"""Allow and block rules on urls by a sort-merge range join."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitmesh.llm.frames import prepare

#: Ends each label of a host key. It sorts before every other character of a key, so that a host's subdomains follow it without a gap.
END = "\x01"
#: The characters up to this one stand in keys as this one and another, so that END is never part of a label.
ESCAPE = "\x02"
#: Follows END: a key with this in place of its last character sorts right after all keys that start with it.
AFTER = "\x02"
RANGE_ROWS = 50_000
#: Ranges at most: a bound for the borders and for the sample that gives them. Beyond it, ranges get longer, which their sorted sweep allows.
MOST_RANGES = 1 << 14
#: The method's verdict where no rule fits.
DEFAULT = "allow"


def host_and_path(url: str = "url"):
    """Columns ``host`` and ``path`` of a url column, by the contract's literal rules."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.expr(f"substring(coalesce(cast(`{url}` as string), ''), locate('://', coalesce(cast(`{url}` as string), '')) + 3)")).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    lower = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.regexp_replace(rest, r"\A[^/?#]*", ""), r"\A[^?#]*", 0)
    return lower.alias("host"), path.alias("path")


def host_key(host):
    """Labels from the last to the first, each ended by END; a host without labels has the empty key.

    Control characters that would be taken for END or sort below it are escaped: equal keys mean equal hosts, whatever these hold.
    """
    plain = host
    for c, other in ((ESCAPE, "\x05"), (END, "\x04"), ("\x00", "\x03")):
        plain = F.replace(plain, F.lit(c), F.lit(ESCAPE + other))
    turned = F.concat(F.array_join(F.reverse(F.split(plain, r"\.")), END), F.lit(END))
    return F.when(host == "", F.lit("")).otherwise(turned)


class Sweep:
    """Goes through rules and urls in key order and keeps the stack of the rule hosts that the present key lies under."""

    def __init__(self):
        # host key, rules by path, the paths' lengths from the longest on
        self.stack: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []

    def _narrow(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def rule(self, key: str, path: str, rule: tuple[str, str]) -> None:
        self._narrow(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}, []))
        _, paths, lengths = self.stack[-1]
        old = paths.get(path)
        paths[path] = min(old, rule, key=lambda r: r[1] != "block") if old else rule
        if len(path) not in lengths:
            lengths.append(len(path))
            lengths.sort(reverse=True)

    def judge(self, path: str) -> tuple[str, str] | None:
        """The longest rule of the stack that fits; of two as long, that of the longer host."""
        best = None
        for _, paths, lengths in reversed(self.stack):
            for n in lengths:
                if len(path) >= n and (found := paths.get(path[:n])):
                    if best is None or len(found[0]) > len(best[0]):
                        best = found
                    break
        return best

    def judge_run(self, key: str, paths: list[str]) -> list[tuple[str, str] | None]:
        """The rules of all urls of one host: the stack is brought to the host once, each distinct path is judged once."""
        self._narrow(key)
        if not self.stack:
            return [None] * len(paths)
        known = {p: self.judge(p) for p in set(paths)}
        return [known[p] for p in paths]


class Borders:
    """The borders (key, salt) of the ranges, and the range of each url or rule."""

    def __init__(self, cuts: list[tuple[str, int]]):
        self.keys = [k for k, _ in cuts]
        self.salts = np.array([s for _, s in cuts], np.int64)

    def of_urls(self, key: pa.Array, salt: pa.Array) -> np.ndarray:
        """Each distinct key of the batch is looked up once; salts decide among the ranges that one hot key has."""
        coded = key.dictionary_encode()
        back = coded.indices.to_numpy()
        names = coded.dictionary.to_pylist()
        lo, hi = (np.array([find(self.keys, k) for k in names], np.int64)[back] for find in (bisect_left, bisect_right))
        for place in np.unique(lo[hi > lo]).tolist():  # keys that are borders themselves
            at = np.flatnonzero((lo == place) & (hi > lo))
            top = hi[at[0]]
            lo[at] = place + np.searchsorted(self.salts[place:top], salt.to_numpy()[at], "right")
        return lo

    def of_rule(self, key: str) -> range:
        """All ranges that hold keys starting with this one."""
        return range(bisect_left(self.keys, key), bisect_left(self.keys, key[:-1] + AFTER) + 1)


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", default: str = DEFAULT, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of each row of pages, by rules with columns ``host, path, verdict``.

    Hosts become keys of reversed labels, under which a rule's host and all
    its subdomains are one interval. Urls are dealt out into ranges of about
    ``range_rows`` rows, whose borders are quantiles of (key, random salt), so
    that a hot host spreads over several ranges; a rule is sent to each range
    that its interval meets. Each task then sorts rules and urls and sweeps
    over them once.

    Null urls and urls without ``://`` have empty host and path, and fit no
    rule. Repeated urls are judged each. Rules with a null or empty host fit
    nothing; of equal rules, block wins. Hosts and paths may hold any
    character, control characters too. Empty tables give no rows; extra
    columns are ignored.
    """
    spark = pages.sparkSession
    prepare(spark)
    host, path = host_and_path()
    urls = pages.select(F.col(key).cast("long").alias("page_id"), host, path).withColumn("k", host_key(F.col("host")))
    urls = urls.withColumn("spread", F.pmod(F.xxhash64("page_id"), F.lit(1 << 20)).cast("int"))
    count = urls.count()
    ranges = max(1, min(MOST_RANGES, -(-count // range_rows)))
    borders: list[tuple[str, int]] = []
    if ranges > 1:
        # borders only steer the dealing; a bounded sample of about 20 keys a range gives them
        share = min(1.0, 20 * ranges / count)
        some = sorted((r["k"], r["spread"]) for r in urls.where(F.col("spread") < int(share * (1 << 20)) + 1).select("k", F.pmod(F.xxhash64("page_id", F.lit(7)), F.lit(1 << 20)).cast("int").alias("spread")).collect())
        borders = sorted({some[len(some) * i // ranges] for i in range(1, ranges)}) if some else []
    urls = urls.withColumn("spread", F.pmod(F.xxhash64("page_id", F.lit(7)), F.lit(1 << 20)).cast("int"))
    shared = spark.sparkContext.broadcast(borders)  # fewer than MOST_RANGES

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = Borders(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(cuts.of_urls(b["k"], b["spread"])), *b.columns], ["range", *b.schema.names])

    def deal_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = Borders(shared.value)
        for b in batches:
            spans = [cuts.of_rule(k) for k in b["k"].to_pylist()]
            row = np.repeat(np.arange(len(spans)), [len(x) for x in spans])
            to = pa.array([i for x in spans for i in x], pa.int64())
            yield pa.RecordBatch.from_arrays([to, *(c.take(pa.array(row)) for c in b.columns)], ["range", *b.schema.names])

    known = rules.select(F.lower(F.col("host").cast("string")).alias("host"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.col("verdict").cast("string").alias("verdict")).where("host <> ''")
    known = known.select(F.lit(None).cast("long").alias("page_id"), "host", "path", host_key(F.col("host")).alias("k"), F.lit(-1).alias("spread"), "verdict")
    shape = "range long, page_id long, host string, path string, k string, spread int"
    left = urls.mapInArrow(deal, shape).withColumn("verdict", F.lit(None).cast("string"))
    right = known.mapInArrow(deal_rules, shape + ", verdict string")
    both = left.unionByName(right).repartition(max(1, ranges), "range").sortWithinPartitions("range", "k", "spread")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, here = Sweep(), None
        for b in batches:
            n = len(b)
            if not n:
                continue
            ranges, salts = b["range"].to_numpy(), b["spread"].to_numpy()
            key = b["k"].dictionary_encode().indices.to_numpy()
            # runs of one range, one host, and rules or urls
            new = np.r_[True, (ranges[1:] != ranges[:-1]) | (key[1:] != key[:-1]) | ((salts[1:] < 0) != (salts[:-1] < 0))]
            opens = np.r_[np.flatnonzero(new), n].tolist()
            hosts, paths, names, verdicts = (b[c].to_pylist() for c in ("k", "path", "host", "verdict"))
            found: list[tuple[str, str] | None] = [None] * n
            for x, y in zip(opens, opens[1:]):
                if ranges[x] != here:
                    state, here = Sweep(), ranges[x]
                if salts[x] < 0:
                    for i in range(x, y):
                        state.rule(hosts[i], paths[i], (names[i] + paths[i], verdicts[i]))
                else:
                    found[x:y] = state.judge_run(hosts[x], paths[x:y])
            urls = pa.array(salts >= 0)
            rule = pa.array([f[0] if f else None for f in found], pa.string())
            verdict = pa.array([f[1] if f else default for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([c.filter(urls) for c in (b["page_id"], b["host"], b["path"], rule, verdict)], ["page_id", "host", "path", "rule", "verdict"])

    return both.mapInArrow(sweep, "page_id long, host string, path string, rule string, verdict string")


#: The rules of the production query: host, path, verdict (fixed values).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM parts
), rules(rhost, rpath, rverdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fits AS (
  SELECT page_id, rhost || rpath AS rule, rverdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS place
  FROM split JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.rverdict, 'allow') AS verdict
FROM split s LEFT JOIN fits f ON f.page_id = s.page_id AND f.place = 1
"""
