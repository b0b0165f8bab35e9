"""Name resolution against rule tables: alias spans, longest first without overlap, and the best rule of a kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A character of the CJK block, by which an alias counts as CJK.
CJK = "[一-鿿]"
# What must stand before, or may stand after, an alias of one CJK character.
SINGLE_BEFORE, SINGLE_AFTER = "金属", ("纤维", "卷", "材", "板", "丝", "锭", "粉", "管")


def occurrences(names: DataFrame, rules: DataFrame, guarded: bool = True) -> DataFrame:
    """Where active rules stand in distinct names: name, rule_id, start, size. names: name; rules: rule_id, alias, status. One plan, whatever the number of rules.

    A CJK alias counts wherever it stands; if it is one character and ``guarded``, only as the whole name or next to a word for metal or a shape. Any
    other alias counts where no ASCII letter or digit stands next to it. Names and aliases meet in an equi-join: a CJK alias' first CJK character is its
    key; for others, between such edges, a run of ASCII letters and digits in an alias is a whole run of the name too, so the longest run is the key, or
    the first character where there is none. Runs and single other characters never are the same text. A name's places are then looked through for the
    aliases it met.
    """
    active = rules.where("status = 'active' and alias <> ''").select("alias", "rule_id").distinct()
    names = names.select("name").where("name <> ''").distinct()
    runs = lambda c: F.regexp_extract_all(c, F.lit("[0-9A-Za-z]+"), F.lit(0))
    longest = F.array_max(F.transform(runs("alias"), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    single = F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.substr(F.col("name"), i, F.lit(1)))
    keys = F.array_distinct(F.concat(runs("name"), F.filter(single, lambda c: ~c.rlike("[0-9A-Za-z]"))))
    own = F.coalesce(F.nullif(F.regexp_extract("alias", CJK, 0), F.lit("")), longest, F.substring("alias", 1, 1))
    pairs = names.withColumn("key", F.explode(keys)).join(active.withColumns({"cjk": F.col("alias").rlike(CJK), "key": own}), "key")

    name, size, padded = F.col("name"), F.length("alias"), F.concat(F.lit(" "), F.col("name"), F.lit(" "))
    free = lambda at: ~F.substr(padded, at, F.lit(1)).rlike("[0-9A-Za-z]")
    after = F.array(*map(F.lit, SINGLE_AFTER))
    beside = lambda i: (F.length("name") == 1) | F.endswith(F.substr(name, F.lit(1), i), F.lit(SINGLE_BEFORE)) | F.exists(after, lambda w: F.startswith(F.substr(name, i + 2), w))
    anywhere = (lambda i: (size > 1) | beside(i)) if guarded else (lambda i: F.lit(True))
    here = lambda i: (F.substr(name, i + 1, size) == F.col("alias")) & F.when(F.col("cjk"), anywhere(i)).otherwise(free(i + 1) & free(i + size + 2))
    starts = F.when(F.length("name") >= size, F.filter(F.sequence(F.lit(0), F.length("name") - size), here))
    return pairs.select("name", "rule_id", F.explode(starts).alias("start"), size.alias("size"))


def match_rules(names: DataFrame, rules: DataFrame) -> DataFrame:
    """Spans of active rules in distinct names that don't overlap, the longest first, then the first, then by rule: name, rule_id, start, size."""
    return _pack(occurrences(names, rules).groupBy("name").agg(F.collect_list(F.struct("size", "start", "rule_id")).alias("ms")))


def _pack(found: DataFrame) -> DataFrame:
    """Greedy selection of non-overlapping spans by a fold over the matches, longest first."""
    key = lambda m: F.struct((-m["size"]).alias("a"), m["start"].alias("b"), m["rule_id"].alias("c"))
    order = F.array_sort(F.transform("ms", key))
    empty = F.array().cast("array<struct<a:int,b:int,c:string>>")
    overlaps = lambda x, y: (x["b"] < y["b"] - y["a"]) & (y["b"] < x["b"] - x["a"])
    kept = F.aggregate(order, empty, lambda acc, x: F.when(F.exists(acc, lambda y: overlaps(x, y)), acc).otherwise(F.array_append(acc, x)))
    return found.select("name", F.explode(kept).alias("m")).select("name", F.col("m.c").alias("rule_id"), F.col("m.b").alias("start"), (-F.col("m.a")).alias("size"))


def best_rule(matches: DataFrame) -> DataFrame:
    """Per name the rule of the longest match, then the smallest rule id."""
    return matches.groupBy("name").agg(F.min_by("rule_id", F.struct(-F.col("size"), "rule_id")).alias("rule_id"))
