"""Resolving raw organisation names to entities, with evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.names import normal_name, token_set_ratio
from lodeworks.operators.ordered import ranked


def numbered(keys: DataFrame, key: str, prefix: str, name: str) -> DataFrame:
    """(key, name): ids like ``E-00001`` in order of the distinct non-null keys, whatever the partitioning."""
    distinct = keys.where(F.col(key).isNotNull()).select(key).distinct()
    return ranked(distinct, [key], "_n").select(key, F.format_string(prefix + "-%05d", F.col("_n")).alias(name))


def most_common(df: DataFrame, key: str, value: str, order: str, name: str) -> DataFrame:
    """(key, name): the most frequent non-null value of each key, among equals the one seen first by ``order``."""
    counts = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("p"))
    return counts.groupBy(key).agg(F.max_by(value, F.struct("n", (-F.col("p")).alias("p"))).alias(name))


def _words(df: DataFrame, i: str) -> DataFrame:
    return df.select(F.col("id").alias(i), F.explode(F.array_distinct(F.split("norm", " "))).alias("w"))


def sharing_rare_words(asked: DataFrame, known: DataFrame, most: int = 400) -> DataFrame:
    """(a, b): ids of asked and known names (id, norm) that share a word which at most ``most`` known names have."""
    held = _words(known, "b")
    rare = held.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") <= most)
    return _words(asked, "a").join(held.join(rare.select("w"), "w"), "w").select("a", "b").distinct()


def _cut(w: Column) -> Column:
    """A word, and the word without each of its letters."""
    shorter = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    return F.explode(F.array_distinct(F.concat(F.array(w), shorter)))


def candidates(asked: DataFrame, known: DataFrame, most: int = 400) -> DataFrame:
    """(a, b): ids of asked and known names (id, norm) that are worth comparing.

    They share a word which at most ``most`` known names have, or the asked name has a word that no known name has, of four letters
    or more, and the known name one of those rare words that is one letter more, less or other. Words that more names have
    say little and would pair names by the million; a name without a rare word is compared with those known names, also
    without one, that have the same two rarest of such words, whether or not it has unknown words besides.
    """
    held = _words(known, "b")
    counts = held.groupBy("w").agg(F.count("*").alias("n"))
    rare = counts.where(F.col("n") <= most).select("w")
    by_word = sharing_rare_words(asked, known, most)

    unknown = _words(asked, "a").where(F.length("w") >= 4).join(counts.select("w"), "w", "left_anti")
    keys = unknown.select("w").distinct().select(F.col("w").alias("u"), _cut(F.col("w")).alias("key"))
    near = keys.join(rare.where(F.length("w") >= 4).select("w", _cut(F.col("w")).alias("key")), "key").where(F.levenshtein("u", "w", 1) >= 0).select("u", "w").distinct()
    by_letter = unknown.withColumnRenamed("w", "u").join(near, "u").join(held, "w").select("a", "b")

    def two(df: DataFrame, i: str) -> DataFrame:
        """The pair of its rarest words, of names that have no rare word."""
        w = _words(df, i).join(counts, "w").groupBy(i).agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("s"))
        return w.where((F.size("s") > 1) & (F.get("s", F.lit(0))["n"] > most)).select(i, F.array_sort(F.array(F.get("s", F.lit(0))["w"], F.get("s", F.lit(1))["w"])).alias("ww"))

    by_pair = two(asked, "a").join(two(known, "b"), "ww").select("a", "b")
    return by_word.unionByName(by_letter).unionByName(by_pair).distinct()


def match_names(asked: DataFrame, known: DataFrame, least: float = 0.92, margin: float = 0.02, most: int = 400) -> DataFrame:
    """(id, entity, score, outcome) of each asked name (id, norm) against known names (id, norm, entity).

    ``exact``: one entity has the same normal form. ``ambiguous``: several have it, or the best two scores of different
    entities lie within ``margin``. ``fuzzy``: the best score is ``least`` or more. Else ``unresolved``. Scores below
    ``least - margin`` decide nothing and are not worked out, so they come out null.
    """
    exact = asked.join(known.select("norm", "entity").distinct(), "norm").groupBy("id").agg(F.count("*").alias("n"), F.min("entity").alias("entity"))
    solved = exact.select("id", F.when(F.col("n") == 1, F.col("entity")).alias("entity"), F.lit(1.0).alias("score"), F.when(F.col("n") == 1, "exact").otherwise("ambiguous").alias("outcome"))
    open_ = asked.join(exact, "id", "left_anti")
    pairs = candidates(open_, known, most).join(open_.select(F.col("id").alias("a"), F.col("norm").alias("na")), "a").join(known.select(F.col("id").alias("b"), F.col("norm").alias("nb"), "entity"), "b")
    scored = pairs.withColumn("score", token_set_ratio("na", "nb", least - margin)).where("score is not null").groupBy("a", "entity").agg(F.max("score").alias("score"))
    w = Window.partitionBy("a").orderBy(F.desc("score"), "entity")
    top = scored.withColumn("rn", F.row_number().over(w)).where("rn <= 2").groupBy("a").agg(F.max(F.when(F.col("rn") == 1, F.struct("score", "entity"))).alias("x"), F.max(F.when(F.col("rn") == 2, F.col("score"))).alias("second"))
    good = F.col("x.score") >= least
    clear = F.col("second").isNull() | (F.col("x.score") - F.col("second") > margin)
    fuzzy = top.select(F.col("a").alias("id"), F.when(good & clear, F.col("x.entity")).alias("entity"), F.col("x.score").alias("score"), F.when(good & clear, "fuzzy").when(good, "ambiguous").otherwise("unresolved").alias("outcome"))
    rest = open_.join(top.select(F.col("a").alias("id")), "id", "left_anti").select("id", F.lit(None).cast(known.schema["entity"].dataType).alias("entity"), F.lit(None).cast("double").alias("score"), F.lit("unresolved").alias("outcome"))
    return solved.unionByName(fuzzy).unionByName(rest)


def variants(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, variants, names, rows): keys whose name is spelled in more than one way; names sorted by frequency, then spelling."""
    g = df.where(F.col(key).isNotNull() & F.col(name).isNotNull()).groupBy(key, name).agg(F.count("*").alias("n"))
    out = g.groupBy(key).agg(F.count("*").alias("variants"), F.sum("n").alias("rows"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(name).alias("name")))).alias("s"))
    return out.where("variants > 1").select(key, "variants", F.array_join(F.col("s.name"), ";").alias("names"), "rows")


def conflicts(df: DataFrame, name: str, key: str) -> DataFrame:
    """(name, keys, ids, counts): names that stand under more than one key; keys by frequency, then in order, and their rows."""
    g = df.where(F.col(key).isNotNull() & F.col(name).isNotNull()).groupBy(name, key).agg(F.count("*").alias("n"))
    out = g.groupBy(name).agg(F.count("*").alias("keys"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(key).alias("k")))).alias("s"))
    return out.where("keys > 1").select(name, "keys", F.array_join(F.col("s.k"), ";").alias("ids"), F.array_join(F.transform("s", lambda x: (-x["n"]).cast("string")), ";").alias("counts"))


def shared_forms(df: DataFrame, form: str, key: str) -> DataFrame:
    """(form, keys, ids): normal forms that several keys have, which may be one parent's children; ids in order."""
    g = df.where(F.col(key).isNotNull() & F.col(form).isNotNull()).select(form, key).distinct()
    return g.groupBy(form).agg(F.count("*").alias("keys"), F.array_join(F.array_sort(F.collect_list(key)), ";").alias("ids")).where("keys > 1")


def graded(flagged: DataFrame, parents: DataFrame, key: str, parent: str) -> DataFrame:
    """One row: how flagged pairs (a, b), a < b, agree with the parents of keys, which were held back.

    Only pairs of which both parents are known count as right or wrong. True pairs are counted from the sizes of families and
    not listed. Each key has one parent (the greatest, if the table says several).
    """
    known = parents.where(F.col(key).isNotNull() & F.col(parent).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(parent).alias("p"))
    families = known.groupBy("p").agg(F.count("*").alias("n")).where("n > 1")
    true = families.agg(F.count("*").alias("families"), F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("bigint"), F.lit(0)).alias("true_pairs"))
    side = lambda c: known.select(F.col("k").alias(c), F.col("p").alias(f"p{c}"))
    both = flagged.select("a", "b").distinct().join(side("a"), "a", "left").join(side("b"), "b", "left")
    seen = F.col("pa").isNotNull() & F.col("pb").isNotNull()
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    g = both.agg(F.count("*").alias("flagged"), n(seen & (F.col("pa") == F.col("pb"))).alias("tp"), n(seen & (F.col("pa") != F.col("pb"))).alias("fp"))
    g = g.select("*", true.select("families").scalar().alias("families"), true.select("true_pairs").scalar().alias("true_pairs")).withColumn("fn", F.col("true_pairs") - F.col("tp"))
    share = lambda x, y: F.col(x) / F.greatest(F.col(x) + F.col(y), F.lit(1))
    return g.withColumns({"precision": share("tp", "fp"), "recall": share("tp", "fn")})


def first_seen(df: DataFrame, key: str, value: str, order: str, name: str) -> DataFrame:
    """(key, name): of each non-null key the value of its first row by ``order``, which has no ties; null if that row has none."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))).alias("m")).select(key, F.col("m.v").alias(name))


def pairs_within(df: DataFrame, group: str, member: str) -> DataFrame:
    """(group, a, b), a < b, of the distinct members of each group: for labels that are to be compared pair by pair."""
    m = df.where(F.col(group).isNotNull() & F.col(member).isNotNull()).select(group, member).distinct()
    return m.select(group, F.col(member).alias("a")).join(m.select(group, F.col(member).alias("b")), group).where("a < b")


def with_norms(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the normal form of a name."""
    return df.withColumn("norm", normal_name(F.col(name)))
