"""URL rules by a sort-merge range join over reversed-host keys.

The labels of a host in reverse, each followed by a dot, make a key of which the keys of all its subdomains are
continuations, so a rule's host is an interval of keys. URLs and rules are sorted by key; a sweep keeps a stack of the
nested rules whose intervals are open.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LAST = "\U0010ffff"


def _rest(url: Column) -> Column:
    """What follows the first ://, or nothing."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def key_of(host: Column) -> Column:
    return F.when(host != "", F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))).otherwise("")


def sweep(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by part, key and kind (rules before URLs): each URL with its longest fitting rule."""
    stack: list[tuple[str, dict[str, tuple], list[int]]] = []  # key, rules by path, lengths of the paths
    part = None
    for batch in rows:
        out = []
        for r in batch.itertuples(index=False):
            if r.part != part:
                part, stack = r.part, []
            while stack and not r.key.startswith(stack[-1][0]):
                stack.pop()
            if r.kind == 0:
                if not stack or stack[-1][0] != r.key:
                    stack.append((r.key, {}, []))
                _, paths, lengths = stack[-1]
                mine = (len(r.rule), len(r.host), r.verdict == "block", r.rule, r.verdict)
                paths[r.path] = max(mine, paths.get(r.path, mine))
                if len(r.path) not in lengths:
                    lengths.append(len(r.path))
                continue
            best = max((paths[r.path[:n]] for _, paths, lengths in stack for n in lengths if n <= len(r.path) and r.path[:n] in paths), default=None)
            out.append((r.id, r.host, r.path, *(best[3:] if best else (None, None))))
        yield pd.DataFrame(out, columns=["id", "host", "path", "rule", "verdict"])


def judge_urls(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", id_col: str = "page_id", url_col: str = "url", sample: int = 20_000) -> DataFrame:
    """One row per input row: the id, host, path, rule, verdict. rules: host, path, verdict.

    A rule fits its host and all subdomains if the path starts with its path; the longest text host + path wins, then
    the longer host, then block. Where none fits, rule is null and verdict is `otherwise`. A null url, or one without
    ://, has an empty host and path, which no rule fits; rules with a null or an empty host are left out, a null path
    is empty. Repeated rows and null ids keep their rows; other columns aren't read; an empty table gives no rows.

    Parts of the key space are cut at quantiles of about `sample` rows, evenly drawn, the only ones that reach the driver: a
    smaller or odd sample makes parts uneven, never results wrong. A cut may fall within one key (rows have a salt), so
    a host with a third of all pages is spread; a rule goes to every part that its interval touches, which for all
    rules together is their number and the parts times the depth of nesting. The sweep holds one stack.
    """
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType
    # ids travel as text: pandas would make floats of whole numbers beside a null
    urls = pages.select(F.col(id_col).cast("string").alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    urls = urls.withColumns({"key": key_of(F.col("host")), "salt": F.xxhash64("id", F.monotonically_increasing_id())})
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    one_in = max(1, urls.count() // sample)
    seen = sorted((r["key"], r["salt"]) for r in urls.select("key", "salt").where(F.pmod(F.xxhash64("salt"), F.lit(one_in)) == 0).limit(4 * sample).collect())
    cuts = sorted({seen[len(seen) * i // parts] for i in range(1, parts)}) if seen else []

    @F.pandas_udf("int")
    def part_of(key: pd.Series, salt: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cuts, x) for x in zip(key, salt)], dtype="int32")

    @F.pandas_udf("array<int>")
    def parts_of(key: pd.Series) -> pd.Series:
        return pd.Series([list(range(bisect_right(cuts, (k, -(2**63)) if k else (k,)), bisect_right(cuts, (k + _LAST, 0)) + 1)) for k in key])

    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host != ''")
    rules = rules.withColumns({"key": key_of(F.col("host")), "rule": F.concat("host", "path")})
    null = lambda t: F.lit(None).cast(t)
    rows = urls.select(part_of("key", "salt").alias("part"), "key", F.lit(1).alias("kind"), "id", "host", "path", null("string").alias("rule"), null("string").alias("verdict"))
    rows = rows.unionAll(rules.select(F.explode(parts_of("key")).alias("part"), "key", F.lit(0).alias("kind"), null("string").alias("id"), "host", "path", "rule", "verdict"))
    swept = rows.repartition("part").sortWithinPartitions("part", "key", "kind").mapInPandas(sweep, "id string, host string, path string, rule string, verdict string")
    return swept.select(F.col("id").cast(kind).alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict"))
