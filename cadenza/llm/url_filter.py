"""URL rules by a Bloom filter cascade (DataFrame functions only).

A rule is a host and a path prefix; it fits the host with all its subdomains. A
URL's keys are its host suffixes joined with its path prefixes of the lengths
that rules have, so a rule fits exactly if its own string is among the keys.

One cascade per verdict: level 1 encodes the listed rules, level 2 the keys of
the corpus that level 1 holds wrongly, level 3 the listed rules that level 2
holds wrongly, and so on until a level holds nothing wrongly. Over the corpus's
own keys the answer is then exact: the first level that says no decides by its
parity. Levels are bit arrays put into the plan as uncorrelated scalar
subqueries, so a URL is judged by bit tests, without a join. A level has
BITS_PER_KEY bits for each key it encodes; the number of listed rules is checked
against MAX_RULES, which bounds what every executor gets.

Defined results: a null url, or one without ``://``, has an empty host and path
and no rule; no rule gives verdict ``default``; of rules that fit the longest
string wins; repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import ascii_lower, stage

BITS_PER_KEY = 12
HASHES = 4
MAX_RULES = 20_000_000
MAX_LEVELS = 64


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(u, parts, 1)), F.regexp_extract(u, parts, 2)


def url_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Every host suffix followed by every path prefix of the given lengths; none for an empty host."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))

    def with_prefix(n: int) -> Column:
        joined = F.transform(suffixes, lambda s: F.concat(s, F.substring(path, 1, n)))
        return F.when(F.length(path) >= n, joined).otherwise(F.array().cast("array<string>"))

    keys = F.flatten(F.array(*[with_prefix(n) for n in path_lengths]))
    return F.when(F.length(host) > 0, keys).otherwise(F.array().cast("array<string>"))


def _bit(key: Column, level: int, j: int, n_bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(n_bits).cast("long"))


class Level:
    """One Bloom filter: its bits as an array<long>, sized by the keys it encodes."""

    def __init__(self, keys: DataFrame, level: int, n_keys: int):
        self.level, self.n_bits = level, max(64, -(-n_keys * BITS_PER_KEY // 64) * 64)
        bits = keys.select(F.explode(F.array(*[_bit(F.col("key"), level, j, self.n_bits) for j in range(HASHES)])).alias("b"))
        words = bits.groupBy(F.shiftright("b", 6).alias("w")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v"))
        self.words = stage(words)

    def array(self, spark: SparkSession) -> Column:
        every = spark.range(self.n_bits // 64).withColumnRenamed("id", "w")
        filled = every.join(self.words, "w", "left").select("w", F.coalesce("v", F.lit(0)).alias("v"))
        return filled.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "v"))), lambda x: x["v"]).alias("a")).scalar()

    def holds(self, key: Column, array: Column) -> Column:
        def test(j: int) -> Column:
            b = _bit(key, self.level, j, self.n_bits)
            return F.bit_get(F.get(array, F.shiftright(b, 6).cast("int")), b.bitwiseAND(F.lit(63)).cast("int")) == 1
        return reduce(lambda x, y: x & y, [test(j) for j in range(HASHES)])


class Cascade:
    """Exact membership of ``listed`` (column key) for every key of ``universe`` (column key)."""

    def __init__(self, listed: DataFrame, universe: DataFrame):
        self.spark = listed.sparkSession
        self.levels: list[Level] = []
        inside, outside = stage(listed.distinct()), universe.join(listed, "key", "left_anti")
        n = inside.count()
        if n > MAX_RULES:
            raise ValueError(f"{n} rules exceed the bound of {MAX_RULES}")
        while n:
            if len(self.levels) == MAX_LEVELS:
                raise RuntimeError("the cascade does not end; raise BITS_PER_KEY")
            level = Level(inside, len(self.levels), n)
            self.levels.append(level)
            wrong = stage(outside.where(level.holds(F.col("key"), level.array(self.spark))))
            inside, outside = wrong, inside
            n = inside.count()

    def has(self, key: Column, arrays: list[Column]) -> Column:
        """Walk the levels: the first that does not hold the key decides."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            answer = F.when(~self.levels[i].holds(key, arrays[i]), F.lit(i % 2 == 1)).otherwise(answer)
        return answer

    def arrays(self) -> list[Column]:
        return [level.array(self.spark) for level in self.levels]


def judge_urls(df: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with host, path, rule and verdict. ``rules``: columns host, path, verdict (allow or block).

    A rule listed under both verdicts blocks. Input columns with these names are replaced.
    """
    rules = rules.select(F.concat(ascii_lower(F.col("host")), F.col("path")).alias("key"), F.length("path").alias("n"), "verdict")
    rules = stage(rules.where("key IS NOT NULL").distinct())
    lengths = [r["n"] for r in rules.select("n").distinct().orderBy("n").collect()]    # path lengths, not rules
    host, path = host_and_path(F.col(url_col))
    replaced = ("host", "path", "rule", "verdict")
    out = df.select(F.struct(F.lit(0).alias("_none"), *[F.col(f"`{c}`") for c in df.columns if c not in replaced]).alias("_row"),
                    host.alias("host"), path.alias("path"))
    keys = url_keys(F.col("host"), F.col("path"), lengths) if lengths else F.array().cast("array<string>")
    universe = stage(out.select(F.explode(keys).alias("key")).distinct())
    cascades = {v: Cascade(rules.where(F.col("verdict") == v).select("key"), universe) for v in ("block", "allow")}
    arrays = {v: c.arrays() for v, c in cascades.items()}
    for v, columns in arrays.items():
        out = out.withColumns({f"_{v}_{i}": a for i, a in enumerate(columns)})

    def listed(verdict: str):
        columns = [F.col(f"_{verdict}_{i}") for i in range(len(arrays[verdict]))]
        return lambda k: cascades[verdict].has(k, columns)

    longest = lambda hits: F.array_max(F.transform(hits, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))
    out = out.withColumn("_keys", keys)
    out = out.withColumns({f"_{v}": longest(F.filter("_keys", listed(v))) for v in arrays})
    block_wins = F.col("_allow").isNull() | (F.col("_block") >= F.col("_allow"))
    blocks = F.col("_block").isNotNull() & block_wins
    return out.withColumns({
        "rule": F.when(blocks, F.col("_block.key")).otherwise(F.col("_allow.key")),
        "verdict": F.when(blocks, F.lit("block")).when(F.col("_allow").isNotNull(), F.lit("allow")).otherwise(F.lit(default)),
    }).select(*[F.col(f"_row.`{c}`").alias(c) for c in df.columns if c not in replaced], *replaced)
