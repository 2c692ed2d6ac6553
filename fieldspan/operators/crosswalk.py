"""Entity matching: layered fallbacks, prefix candidates with a similarity score, decision lists."""

from __future__ import annotations

import difflib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T


def first_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One value per key, the smallest: repeated names have a fixed winner."""
    return df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])).groupBy(*keys).agg(F.min(value).alias(value))


def layered(left: DataFrame, dims: DataFrame, suffix: str, renames: dict[str, str] | None = None) -> DataFrame:
    """Adds map_code and how to (cid, prov, name) by code, name, former name, then stem without suffix.

    dims: code, prov, gname, gold. Renames hold for the name passes.
    """
    name = F.trim("name")
    if renames:
        table = F.create_map(*[x for kv in renames.items() for x in map(F.lit, kv)])
        name = F.coalesce(F.try_element_at(table, name), name)
    rows = left.withColumns({"_n": name, "_s": F.regexp_replace(name, suffix, "")})
    d = dims.withColumns({"_g": F.trim("gname"), "_o": F.trim("gold"), "_t": F.regexp_replace(F.trim("gname"), suffix, "")})
    codes = dims.select(F.col("code").alias("cid"), F.col("code").alias("c0")).distinct()
    by = lambda src, key, out: first_by(d, ["prov", src], "code").select("prov", F.col(src).alias(key), F.col("code").alias(out))
    rows = rows.join(codes, "cid", "left").join(by("_g", "_n", "c1"), ["prov", "_n"], "left").join(by("_o", "_n", "c2"), ["prov", "_n"], "left")
    rows = rows.join(by("_t", "_s", "c3"), ["prov", "_s"], "left")
    stem = F.when(F.col("_s") != "", F.col("c3"))
    how = F.when(F.col("c0").isNotNull(), "code").when(F.col("c1").isNotNull(), "name").when(F.col("c2").isNotNull(), "former").when(stem.isNotNull(), "stem").otherwise("unmatched")
    return rows.select("cid", "prov", "name", F.coalesce("c0", "c1", "c2", stem).alias("map_code"), how.alias("how"))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks of two strings."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b)], dtype=float)


def _bits(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of names, a row each, filled up with -1; and the lengths."""
    size = np.array([len(n) for n in names])
    out = np.full((len(names), size.max(initial=0)), -1, np.int32)
    for i, n in enumerate(names):
        out[i, : len(n)] = np.frombuffer(n.encode("utf-32-le", "surrogatepass"), np.int32)
    return out, size


def at_most(name: str, letters: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each other name a number that its similarity to ``name`` doesn't exceed.

    Matching blocks are a common subsequence. The longest one's length comes letter by letter of the
    others, for all of them at once, from a word whose bits stand for the places of ``name``; of a name of more
    than 63 letters, the lengths alone give the bound.
    """
    longest = np.minimum(len(name), size)
    if len(name) < 64:
        places: dict[int, int] = {}
        for i, c in enumerate(name):
            places[ord(c)] = places.get(ord(c), 0) | 1 << i
        known = np.array(sorted(places), np.int32)
        masks = np.array([*(places[c] for c in known.tolist()), 0], np.uint64)
        at = np.minimum(np.searchsorted(known, letters), len(known) - 1)
        own = masks[np.where(known[at] == letters, at, len(known))]
        free = np.full(len(letters), (1 << len(name)) - 1, np.uint64)
        for k in range(letters.shape[1]):
            hit = free & own[:, k]
            free = (free + hit) | (free - hit)
        longest = len(name) - np.bitwise_count(free & np.uint64((1 << len(name)) - 1)).astype(int)
    return 2.0 * longest / (len(name) + size)


def best_by_prefix(left: DataFrame, dims: DataFrame, width: int = 2, block: int = 200) -> DataFrame:
    """The most similar name of the same province and first letters; ties go to the smallest code.

    Equal names of a province are scored once. Blocks of names meet blocks of the directory; a name's
    candidates are scored from the highest bound of their similarity down, until the bounds fall below the best score.
    """
    a = left.withColumn("_p", F.substring("name", 1, width)).where(F.length("name") >= width)
    every = a.select("prov", "_p", "name").where("prov is not null").distinct()
    # of equal names the smallest code wins; a name without any code comes last
    b = dims.groupBy("prov", F.substring("gname", 1, width).alias("_p"), "gname").agg(F.min("code").alias("code")).where("prov is not null")
    dealt = lambda df, name, out, size: df.join(df.groupBy("prov", "_p").agg(F.ceil(F.count(F.lit(1)) / size).alias(f"_n{out[1:]}")), ["prov", "_p"]).withColumn(out, F.pmod(F.xxhash64(name), F.col(f"_n{out[1:]}")))
    a_parts, b_parts = dealt(every, "name", "_a", block), dealt(b, "gname", "_b", 20 * block)
    blocks = a_parts.select("prov", "_p", "_na").distinct().join(b_parts.select("prov", "_p", "_nb").distinct(), ["prov", "_p"])
    both = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = a_parts.join(blocks.select("prov", "_p", both("_nb").alias("_b")), ["prov", "_p"])
    against = b_parts.join(blocks.select("prov", "_p", both("_na").alias("_a")), ["prov", "_p"])
    against = against.select(*[F.col(c).alias(c) for c in against.columns])  # columns of its own, as both come of one table
    kinds = {f.name: f.dataType.simpleString() for f in [*left.schema, *dims.schema]}

    def met(mine: pa.Table, others: pa.Table) -> pa.Table:
        names, codes = others.column("gname").to_pylist(), others.column("code").to_pylist()
        out = []
        letters, size = _bits(names)
        for name in mine.column("name").to_pylist() if names else ():
            bound = at_most(name, letters, size)
            best = None
            for i in np.argsort(-bound, kind="stable").tolist():
                if best and bound[i] < best[0]:
                    break
                score = difflib.SequenceMatcher(None, name, names[i]).ratio()
                rank = (score, codes[i] is not None, -(codes[i] or 0), names[i])
                best = max(best, rank) if best else rank
            out.append((name, None if not best[1] else -best[2], best[3], best[0]))
        at = lambda k, kind: pa.array([o[k] for o in out], kind)
        prov = pa.array([mine.column("prov")[0].as_py()] * len(out) if out else [], mine.schema.field("prov").type)
        return pa.table({"prov": prov, "name": at(0, pa.string()), "code": at(1, others.schema.field("code").type), "gname": at(2, pa.string()), "score": at(3, pa.float64())})

    key = ["prov", "_p", "_a", "_b"]
    found = asked.groupBy(*key).cogroup(against.groupBy(*key)).applyInArrow(met, f"prov {kinds['prov']}, name string, code {kinds['code']}, gname string, score double")
    best = F.max_by(F.struct("code", "gname", "score"), F.struct("score", -F.col("code"), "gname"))
    won = found.groupBy("prov", "name").agg(best.alias("b")).select("prov", "name", "b.*")
    return a.join(won, ["prov", "name"]).groupBy("cid", "name").agg(best.alias("b")).select("cid", "name", "b.code", "b.gname", F.round("b.score", 2).alias("similarity"))


def resolved(rules: list[tuple[str, Column]], last: str) -> Column:
    """The first rule that holds names the action."""
    out = None
    for name, test in rules:
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(last)


def applied(rows: DataFrame, crosswalk: DataFrame, values: list[str]) -> DataFrame:
    """Sums of rows (cid, year, values) under their final codes; NULL only if all parts are."""
    return rows.join(crosswalk.select("cid", "final_code"), "cid").groupBy("final_code", "year").agg(*[F.sum(v).alias(v) for v in values])
