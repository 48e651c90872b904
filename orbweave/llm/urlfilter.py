"""URL filters by a cascade of Bloom filters: exact membership over the corpus's own keys, without a join.

All keys that the corpus's URLs can be looked up by (the host and its parent domains, with the path prefixes
that rules have) are its key universe. A cascade encodes which of them are listed: level 1 is a Bloom filter
of the listed keys, level 2 one of the other keys of the universe that level 1 lets through, level 3 one of the
listed keys that level 2 lets through, and so on until a level lets nothing through. A key of the universe is
listed if the first level that rejects it has an even number, or if none does and their number is odd. Each
level is built where the keys are: tasks set bits, an aggregation ors them, and only the bits travel.

Three lists have a cascade each: rules that block, rules that allow, and blocked domains. The longest rule that
fits a URL gives its verdict; a URL that no rule fits is blocked if its host or a parent domain is listed.

Keys of the corpus and of the lists meet in the one aggregation that makes the corpus's keys distinct, so neither
building a cascade nor looking a URL up is a join. A level has as many bits a key as make its false positives about as
many as its keys, so a cascade's size follows the listed keys and only by its logarithm the universe. With more listed keys than
``SHARD_KEYS`` they are divided by a hash of the key, and URLs are looked up in one pass per shard.

Null URLs and those without ``://`` have an empty host and path, no rule, and are allowed. Repeated URLs and rules are no
special case; a rule that is listed for blocking and allowing is taken as blocking. Other columns are neither read nor
returned; the id column may have any type, and its values may be null.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.common import Cuts, map_batches, map_chunks

#: Least and most bits per key of a level: between one key in 140 and one in 2 * 10^9 passes that shouldn't.
BITS, MOST_BITS = 10, 45
#: Listed keys of a shard; its cascades, of about 2 to 6 bytes a key, are sent to every task.
SHARD_KEYS = 8_000_000
MOST_LEVELS = 64
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    host, path = rest[:end].translate(_UPPER), rest[end:]
    stop = min((i for c in "?#" if (i := path.find(c)) >= 0), default=len(path))
    return host, path[:stop]


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.translate(_UPPER), slash + path


def domains(host: str) -> list[str]:
    """The host and its parent domains, the longest first."""
    out, at = [], 0
    while host and at < len(host):
        out.append(host[at:])
        dot = host.find(".", at)
        if dot < 0:
            break
        at = dot + 1
    return out


def rule_keys(host: str, path: str, prefixes: tuple[int, ...]) -> list[str]:
    """What rules that fit could be written as, the longest first."""
    found = [d + path[:n] for d in domains(host) for n in prefixes if n <= len(path)]
    return sorted(found, key=len, reverse=True)


def _places(key: bytes, level: int, bits: int, hashes: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key, level)
    a, b = h >> 64, h | 1
    return [((a + i * b) & 0xFFFFFFFFFFFFFFFF) % bits for i in range(hashes)]


@dataclass(frozen=True)
class Cascade:
    #: (bits, hashes) of each level.
    levels: tuple[tuple[bytes, int], ...]

    def passes(self, key: bytes, level: int) -> bool:
        data, hashes = self.levels[level]
        return all(data[p >> 3] >> (p & 7) & 1 for p in _places(key, level, 8 * len(data), hashes))

    def __contains__(self, key: bytes) -> bool:
        for level in range(len(self.levels)):
            if not self.passes(key, level):
                return level % 2 == 1
        return len(self.levels) % 2 == 1


def _bits_of(keys: DataFrame, n: int, per_key: int, level: int) -> tuple[bytes, int]:
    """A Bloom filter of the ``n`` strings in the column ``key``, and its number of hashes."""
    size, hashes = max(1, -(-n * per_key // 64)) * 64, max(1, round(0.69 * per_key))

    def run(batches):
        for batch in batches:
            found: dict[int, int] = {}
            for key in batch.column(0).to_pylist():
                for p in _places(key.encode(), level, size, hashes):
                    found[p >> 6] = found.get(p >> 6, 0) | 1 << (p & 63)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(np.array(list(found.values()), np.uint64).view(np.int64))], ["at", "word"])

    words = np.zeros(size // 64, np.int64)
    for r in map_batches(keys.select("key"), run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toLocalIterator():
        words[r["at"]] = r["word"]
    return words.astype("<i8").tobytes(), hashes


def _passing(keys: DataFrame, cascade: Cascade, level: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([cascade.passes(k.encode(), level) for k in batch.column(0).to_pylist()], pa.bool_()))

    return map_batches(keys, run, "key string")


def build(listed: DataFrame, others: DataFrame, cuts: Cuts) -> Cascade:
    """The cascade that tells the distinct strings of ``listed`` from those of ``others`` (a column ``key`` each)."""
    levels: list[tuple[bytes, int]] = []
    inside, outside, n, m = listed, others, listed.count(), others.count()
    while n and len(levels) < MOST_LEVELS:
        per_key = min(MOST_BITS, max(BITS, int(np.ceil(1.4427 * np.log2(max(2, m / n))))))
        levels.append(_bits_of(inside, n, per_key, len(levels)))
        inside, outside = cuts.cut(_passing(outside, Cascade(tuple(levels)), len(levels) - 1)), inside
        n, m = inside.count(), n
    if n:
        raise ValueError("the cascade doesn't end; are the two sets disjoint?")
    return Cascade(tuple(levels))


def _shard(key: bytes, shards: int) -> int:
    """As xxhash64 and pmod in SQL."""
    h = xxhash.xxh64_intdigest(key, 42)
    return (h - (h >> 63 << 64)) % shards


def judge(
    df: DataFrame, block: Iterable[str], allow: Iterable[str], blocklist: DataFrame | Iterable[str], id_col: str = "page_id", url_col: str = "url", shard_keys: int = SHARD_KEYS
) -> DataFrame:
    """id, ``host``, ``path``, ``rule`` and ``verdict`` of every row. ``blocklist``: domains, or a table with a column of them."""
    spark: SparkSession = df.sparkSession
    cuts = Cuts(spark)
    kind = df.schema[id_col].dataType.simpleString()
    work = Cuts(spark)
    rules = {"B": {"".join(split_rule(r)) for r in block}}
    rules["A"] = {"".join(split_rule(r)) for r in allow} - rules["B"]
    prefixes = tuple(sorted({len(split_rule(r)[1]) for r in (*block, *allow)}))
    if not isinstance(blocklist, DataFrame):
        blocklist = spark.createDataFrame([(d,) for d in sorted(set(blocklist))], "domain string")
    domain = F.translate(F.col(f"`{blocklist.columns[0]}`"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    listed = blocklist.select(F.concat(F.lit("D"), domain).alias("key"), F.lit("D").alias("list")).where("key is not null")
    listed = listed.union(spark.createDataFrame([("R" + r, k) for k in "BA" for r in sorted(rules[k])], "key string, list string"))

    def keys(batches):
        """Distinct keys of each batch: R and a rule's, D and a domain's."""
        for batch in batches:
            seen: set[str] = set()
            for url in batch.column(0).to_pylist():
                host, path = split_url(url)
                seen.update("R" + k for k in rule_keys(host, path, prefixes))
                seen.update("D" + k for k in domains(host))
            yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], ["key"])

    own = map_batches(df.select(url_col), keys, "key string").withColumn("list", F.lit(None).cast("string"))
    marked = own.union(listed).groupBy("key").agg(F.max("list").alias("list"))
    n = listed.count()
    shards = max(1, -(-n // shard_keys))
    marked = work.cut(marked.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")))

    out = df.select(F.col(id_col), F.col(url_col).alias("url")).withColumns({"rule": F.lit(None).cast("string"), "list": F.lit(None).cast("string")})
    for shard in range(shards):
        part = marked.where(F.col("shard") == shard)
        made = {}
        for name, kind_of in (("B", "R"), ("A", "R"), ("D", "D")):
            mine = part.where(F.col("key").startswith(kind_of))
            made[name] = build(mine.where(F.col("list") == name).select("key"), mine.where(~F.col("list").eqNullSafe(name)).select("key"), work)
        sent = spark.sparkContext.broadcast(made)

        def look(batch: pa.RecordBatch, shard=shard, sent=sent) -> pa.RecordBatch:
            made, memo = sent.value, {}

            def found(host: str, path: str) -> tuple[str | None, str | None]:
                here = lambda k: shards == 1 or _shard(k, shards) == shard
                for k in rule_keys(host, path, prefixes):
                    key = ("R" + k).encode()
                    if here(key):
                        for name in "BA":
                            if key in made[name]:
                                return k, name
                for d in domains(host):
                    key = ("D" + d).encode()
                    if here(key) and key in made["D"]:
                        return None, "D"
                return None, None

            rules_out, lists_out = [], []
            for url, rule, listed in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                host, path = split_url(url)
                at = host, path[: max(prefixes, default=0)]
                if at not in memo:
                    memo[at] = found(*at)
                now, name = memo[at]
                if name is None or listed in ("A", "B") and (name == "D" or len(now) <= len(rule)):
                    now, name = rule, listed
                rules_out.append(now)
                lists_out.append(name)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rules_out, pa.string()), pa.array(lists_out, pa.string())], [id_col, "url", "rule", "list"])

        out = map_chunks(out, look, f"`{id_col}` {kind}, url string, rule string, list string", "url")
        if shards > 1:
            out = cuts.cut(out)

    work.close()

    def last(batch: pa.RecordBatch) -> pa.RecordBatch:
        halves = [split_url(u) for u in batch.column(1).to_pylist()]
        verdict = ["allow" if x in (None, "A") else "block" for x in batch.column(3).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([h for h, _ in halves], pa.string()), pa.array([p for _, p in halves], pa.string()), batch.column(2), pa.array(verdict, pa.string())], [id_col, "host", "path", "rule", "verdict"])

    return map_chunks(out, last, f"`{id_col}` {kind}, host string, path string, rule string, verdict string", "url")
