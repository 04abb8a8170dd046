"""Budgets, adjacent dedup, top-k and samples in a stated order (OP-32, OP-45 to OP-49b, OP-61, OP-61b)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graftwork.functions.hashing import seeded_score
from graftwork.operators.staging import Rounds


#: Keys up to this many are broadcast, a larger budget is joined by shuffle.
MAX_BROADCAST = 100_000


def ordered_budget(rows: DataFrame, budget: int, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """All rows, with `queried` true for the first `budget` of each group in the order.

    Without groups no rank is computed over one partition: a distributed top-k
    finds the budget's rows, ties going by all other columns that have an
    order, and the table is joined with these. Rows equal in every column
    can't be told apart; of the last key's repeats as many are marked as the
    budget holds, the others not.
    """
    if by:
        nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        return rows.withColumn("queried", nth <= budget)
    if budget <= 0:
        return rows.withColumn("queried", F.lit(False))
    sorts = [c for c, t in rows.dtypes if "map<" not in t and t != "variant"]
    top = Rounds(rows.sparkSession, "budget").save(rows.orderBy(*order, *sorts).limit(budget).withColumn("_nth", F.monotonically_increasing_id()))
    last = top.orderBy(F.desc("_nth")).limit(1)
    keys = top.select(*sorts).distinct().withColumn("_in", F.lit(True))
    equal = lambda other: [rows[c].eqNullSafe(other[c]) for c in sorts]
    keys = F.broadcast(keys) if budget <= MAX_BROADCAST else keys
    marked = rows.join(keys, equal(keys), "left").select(*[rows[c] for c in rows.columns], F.coalesce("_in", F.lit(False)).alias("queried"))
    edge = F.broadcast(last.select(*sorts))
    repeats = rows.join(edge, equal(edge), "left_semi")
    here = top.join(edge, [top[c].eqNullSafe(edge[c]) for c in sorts], "left_semi").count()
    total = repeats.count()
    if total == here:
        return marked
    # the last key has more rows than the budget: they are made anew, `here` of them marked
    many = rows.sparkSession.range(total).withColumnRenamed("id", "_nth")
    made = many.join(F.broadcast(repeats.limit(1))).select(*rows.columns, (F.col("_nth") < here).alias("queried"))
    return marked.join(edge, [marked[c].eqNullSafe(edge[c]) for c in sorts], "left_anti").unionByName(made)


def file_priority(is_root: Column, is_retained: Column) -> Column:
    return F.when(is_root, 0).when(is_retained, 1).otherwise(2)


def sorted_adjacent_dedup(rows: DataFrame, order: list[str], same: list[str], by: list[str], ordinal: str) -> DataFrame:
    """Sort (nulls first, input order on ties), then drop each row that equals its predecessor on `same`.

    Equal rows that another one separates both stay.
    """
    w = Window.partitionBy(*by).orderBy(*[F.col(c).asc_nulls_first() for c in order], F.col(ordinal))
    before = F.lag(F.struct(*same)).over(w)
    nth = F.row_number().over(w)
    return rows.withColumn("_dup", (nth > 1) & F.struct(*same).eqNullSafe(before)).filter(~F.col("_dup")).drop("_dup")


def full_dedup(rows: DataFrame, same: list[str], ordinal: str) -> DataFrame:
    """The first row, by input order, of each distinct key."""
    return rows.groupBy(*same).agg(F.min_by(F.struct(*[F.col(c) for c in rows.columns]), ordinal).alias("_r")).select("_r.*")


def first_seen(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """(key, first ordinal): distinct values in the order of their first sight."""
    return rows.groupBy(key).agg(F.min(ordinal).alias(ordinal))


def prioritised(rows: DataFrame, rank: Column, ordinal: list[str], limit: int) -> DataFrame:
    """The first `limit` rows by rank, stable in the ordinal."""
    return rows.orderBy(rank, *ordinal).limit(limit)


LEVELS = {"error": 0, "warning": 1}
DECISIONS = {"prunable": 0, "unclassified": 1, "blocked_by_unknown": 2, "used": 3, "retained": 4}


def rank_of(column: str, ranks: dict[str, int]) -> Column:
    out = F.lit(len(ranks))
    for value, rank in reversed(ranks.items()):
        out = F.when(F.col(column) == value, rank).otherwise(out)
    return out


def diagnostics_first(rows: DataFrame, limit: int, level: str = "level", ordinal: str = "ord") -> DataFrame:
    return prioritised(rows, rank_of(level, LEVELS), [ordinal], limit)


def decision_samples(rows: DataFrame, limit: int) -> DataFrame:
    return prioritised(rows, rank_of("decision", DECISIONS), ["id"], limit)


def capped_preview(rows: DataFrame, key: str, value: str, order: str, cap: int = 5) -> DataFrame:
    """Per key: the first values, and a text with how many more there are."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order))
    ranked = rows.withColumn("_nth", nth).groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_nth") <= cap, F.struct("_nth", value)))).alias("_first"))
    shown = F.array_join(F.transform("_first", lambda x: x[value].cast("string")), ", ")
    more = F.when(F.col("n") > cap, F.concat(F.lit(", … "), (F.col("n") - cap).cast("string"), F.lit(" more"))).otherwise("")
    return ranked.select(key, "n", F.concat(shown, more).alias("preview"))


def shared_cap(producers: list[DataFrame], cap: int) -> DataFrame:
    """The first `cap` rows of several producers' rows (ord, text), earlier producers first."""
    rows = producers[0].withColumn("producer", F.lit(0))
    for i, p in enumerate(producers[1:], 1):
        rows = rows.unionByName(p.withColumn("producer", F.lit(i)))
    return rows.orderBy("producer", "ord").limit(cap)


def seeded_sample(rows: DataFrame, ident: Column, seed: int, count: int, ordinal: str) -> DataFrame:
    """The `count` rows with the least seeded hashes, unsigned, input order on ties."""
    return rows.withColumn("score", seeded_score(ident, seed)).orderBy("score", ordinal).limit(count)


def stratified_sample(rows: DataFrame, stratum: str, preferred: list[str], ident: Column, seed: int, count: int, ordinal: str) -> DataFrame:
    """One row of each preferred stratum, in that order, then the rest by hash until `count`."""
    scored = rows.withColumn("score", seeded_score(ident, seed))
    nth = F.row_number().over(Window.partitionBy(stratum).orderBy("score", ordinal))
    rank = rank_of(stratum, {k: i for i, k in enumerate(preferred)})
    picked = scored.withColumn("_rank", F.when((nth == 1) & F.col(stratum).isin(preferred), rank).otherwise(len(preferred)))
    return picked.orderBy("_rank", "score", ordinal).limit(count).drop("_rank")


def pinned(candidates: DataFrame, pins: DataFrame, fields: list[str]) -> DataFrame:
    """(pin, matches, ok) of each pin: candidates that agree in every field that the pin sets; ok is exactly one.

    Pins are a hand-written list. Those that set the same fields meet the
    candidates in one equi-join on these. A pin written twice, or two that ask
    for the same, raise.
    """
    rows = pins.select("pin", *fields).collect()
    asked = [tuple(r[f] for f in fields) for r in rows]
    if len(set(asked)) < len(asked) or len({r.pin for r in rows}) < len(rows):
        raise ValueError("a pin is given twice")
    found = None
    for mask in sorted({tuple(v is not None for v in a) for a in asked}):
        own = [f for f, m in zip(fields, mask) if m]
        some = pins.filter(F.expr("true" if not fields else " and ".join(f"`{f}` is {'not null' if m else 'null'}" for f, m in zip(fields, mask))))
        hits = candidates.join(F.broadcast(some.select("pin", *own)), own) if own else candidates.join(F.broadcast(some.select("pin")))
        found = hits.select("pin") if found is None else found.unionByName(hits.select("pin"))
    if found is None:
        return pins.select("pin", F.lit(0).cast("bigint").alias("matches"), F.lit(False).alias("ok"))
    n = pins.select("pin").join(found.groupBy("pin").agg(F.count("*").alias("n")), "pin", "left")
    return n.select("pin", F.coalesce("n", F.lit(0)).alias("matches"), (F.coalesce("n", F.lit(0)) == 1).alias("ok"))
