"""Matching noisy names to a reference list.

Inputs and reference are made distinct first, so the work follows the number of different names. Tiers run in order and each
sees only what the earlier ones left. Equality and containment are joins on keys: a name that lies in another shares its first
letters with one of the other's runs of as many letters, so only names that share such a run meet. Similarity, a difflib ratio
in an Arrow function, has no such key: there the reference is a stated list, taken in blocks of a bounded size that are
broadcast one by one, and pairs whose lengths, letters or shared pairs of letters rule the threshold out never reach Python. The canonical
resolver compares names that share a word; a word that many hold ("school") is cut into blocks on both sides, so that its pairs spread over tasks
and no name is broadcast. Results of a tier are the first by reference order.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from leafmark.functions import text as X
from leafmark.plans import tables as T

#: Reference names that are broadcast at a time where names are compared by similarity; a longer list takes several rounds.
BLOCK_ROWS = 50_000
#: Names and references of a block of those that share a word.
WORD_NAMES, WORD_REFS = 20_000, 2_000
#: What normalized names are made of.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789 "
#: Letters of the runs by which containment is joined; names with fewer are found by their whole length.
RUN = 4


@F.pandas_udf(DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's similarity of two strings."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(BooleanType())
def words_close(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether every word of the side with fewer words is at least 0.8 similar to one of the other's."""

    def close(x: str, y: str) -> bool:
        p, q = ([w for w in s.split() if len(w) >= 2] for s in (x, y))
        short, long = (p, q) if len(p) <= len(q) else (q, p)
        return bool(short) and all(max((SequenceMatcher(None, w, v).ratio() for v in long), default=0.0) >= 0.8 for w in short)

    return pd.Series([close(x, y) for x, y in zip(a, b, strict=True)], dtype="bool")


def _reference(reference: DataFrame) -> DataFrame:
    """The different normalized names; of those that are alike, the first."""
    rows = reference.select("ref_idx", F.col("name").alias("ref_name"), X.norm_match(F.col("name")).alias("ref_norm"))
    return rows.groupBy("ref_norm").agg(F.min_by(F.struct("ref_idx", "ref_name"), "ref_idx").alias("r")).select("r.ref_idx", "r.ref_name", "ref_norm")


def _blocks(ref: DataFrame) -> list[DataFrame]:
    """The reference in parts of about BLOCK_ROWS names at most, each small enough to be broadcast."""
    n = -(-ref.count() // BLOCK_ROWS)
    return [F.broadcast(ref.where(F.pmod(F.xxhash64("ref_norm"), F.lit(n)) == i)) for i in range(n)] if n > 1 else [F.broadcast(ref)]


def _joined(names: DataFrame, blocks: list[DataFrame], condition: Column) -> DataFrame:
    return reduce(DataFrame.unionByName, [names.join(b, condition) for b in blocks])


def _runs(c: Column) -> Column:
    """All runs of 1 to RUN letters of a string, each once."""
    of = lambda n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.array(*[of(n) for n in range(1, RUN + 1)])))


def _contained(inner: DataFrame, inside: str, outer: DataFrame, outside: str) -> DataFrame:
    """Pairs of rows whose inside column, not empty, lies within the outside column of the other."""
    keyed = inner.where(F.length(inside) > 0).withColumn("__run", F.substring(inside, 1, RUN))
    wanted = keyed.select("__run").distinct()
    runs = outer.withColumn("__run", F.explode(_runs(F.col(outside)))).join(wanted, "__run", "left_semi")
    return keyed.join(runs, "__run").where(F.col(outside).contains(F.col(inside))).drop("__run")


def _reach(a: Column, b: Column, floor: float) -> Column:
    """Whether strings of these lengths can be so similar: 2 * min / (a + b) bounds the ratio."""
    return 2 * F.least(a, b) >= floor * (a + b)


def _pairs_reach(floor: float) -> Column:
    """Whether two names share enough different pairs of adjacent letters for that ratio.

    m matching letters of s in all lie in at most s - 2 m + 1 unbroken runs, as unmatched letters part them; so at least
    3 m - s - 1 places of a name begin a pair of letters that the other name holds too.
    """
    at = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))
    s = F.length("norm") + F.length("ref_norm")
    shared = X.let(at(F.col("ref_norm")), lambda r: F.size(F.filter(at(F.col("norm")), lambda p: F.array_contains(r, p))))
    return shared >= 3 * F.ceil(F.lit(floor / 2) * s - 1e-9) - s - 1


def _with_letters(rows: DataFrame, name: str, into: str) -> DataFrame:
    """rows with how often each letter is in a name."""
    c = F.col(name)
    return rows.withColumn(into, F.array(*[F.length(c) - F.length(F.replace(c, F.lit(x), F.lit(""))) for x in ALPHABET]))


def _letters_reach(floor: float) -> Column:
    """Whether two names have enough letters in common for that ratio, wherever they stand."""
    shared = F.aggregate(F.zip_with("letters", "ref_letters", lambda a, b: F.least(a, b)), F.lit(0), lambda n, x: n + x)
    return 2 * shared >= F.lit(floor - 1e-9) * (F.length("norm") + F.length("ref_norm"))


def similar_enough(floor: float) -> Column:
    """What can be said of a pair's ratio before it is computed, the cheapest first."""
    return _reach(F.length("norm"), F.length("ref_norm"), floor) & _letters_reach(floor) & _pairs_reach(floor)


def _sharing_a_word(names: DataFrame, ref: DataFrame, condition: Column) -> DataFrame:
    """Pairs of a name and a reference that share a word of two letters or more and meet the condition, each once.

    Both sides of a word are cut into blocks, and each block of one side meets each of the other, so a word that all names hold is no hot key. A pair
    with several common words is compared at the first of them only.
    """
    long = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: F.length(w) >= 2))
    left = names.withColumn("words", long("norm")).withColumn("word", F.explode("words"))
    right = ref.withColumn("ref_words", long("ref_norm")).withColumn("word", F.explode("ref_words"))
    count = lambda rows, most, name: rows.groupBy("word").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    blocks = count(left, WORD_NAMES, "n_blocks").join(count(right, WORD_REFS, "r_blocks"), "word")
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.join(blocks, "word").withColumn("n_block", own("norm", "n_blocks")).withColumn("r_block", every("r_blocks")).drop("n_blocks", "r_blocks")
    right = right.join(blocks, "word").withColumn("r_block", own("ref_norm", "r_blocks")).withColumn("n_block", every("n_blocks")).drop("n_blocks", "r_blocks")
    first = F.get(F.array_intersect("words", "ref_words"), F.lit(0)) == F.col("word")
    return left.join(right, ["word", "n_block", "r_block"]).where(first & condition)


def _words_reach(floor: float = 0.8) -> Column:
    """Whether every word of the side with fewer words has one of a fitting length on the other."""
    p, q = (F.filter(F.split(c, " "), lambda w: F.length(w) >= 2) for c in ("norm", "ref_norm"))
    every = lambda x, y: F.forall(x, lambda w: F.exists(y, lambda v: _reach(F.length(w), F.length(v), floor)))
    return F.when(F.size(p) <= F.size(q), (F.size(p) > 0) & every(p, q)).otherwise((F.size(q) > 0) & every(q, p))


def _first(rows: DataFrame, method: str, confidence: Column) -> DataFrame:
    best = rows.groupBy("norm").agg(F.min_by(F.struct("ref_idx", "ref_name", confidence.cast("double").alias("confidence")), "ref_idx").alias("b"))
    return best.select("norm", F.lit(method).alias("method"), "b.confidence", "b.ref_idx", "b.ref_name")


def _plain_tiers(norms: DataFrame, ref: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(exact, partial, rest): the first two tiers and the names they leave. The empty string lies in every name."""
    exact = _first(norms.join(ref, norms["norm"] == ref["ref_norm"]), "exact", F.lit(1.0))
    left = norms.join(exact.select("norm"), "norm", "left_anti")
    first = ref.agg(F.min_by(F.struct("ref_idx", "ref_name", "ref_norm"), "ref_idx").alias("r")).where("r is not null").select("r.*")
    pairs = [
        _contained(ref, "ref_norm", left, "norm"),
        _contained(left, "norm", ref, "ref_norm"),
        left.join(F.broadcast(ref.where("ref_norm = ''")), how="cross"),  # one row at most
        left.where("norm = ''").join(F.broadcast(first), how="cross"),  # one row
    ]
    columns = ("norm", "ref_idx", "ref_name")
    partial = _first(reduce(DataFrame.unionByName, [p.select(*columns) for p in pairs]), "partial", F.lit(0.95))
    return exact, partial, left.join(partial.select("norm"), "norm", "left_anti")


def _answer(names: DataFrame, found: DataFrame) -> DataFrame:
    rows = names.withColumn("norm", F.when(F.coalesce(X.trimmed(F.col("name")), F.lit("")) != "", X.norm_match(F.col("name"))))
    joined = rows.join(found, "norm", "left")
    method = F.when(F.col("norm").isNull(), "missing").otherwise(F.coalesce("method", F.lit("none")))
    return joined.select(*names.columns, method.alias("method"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.col("ref_name").alias("matched"))


def _norms(names: DataFrame) -> DataFrame:
    return names.where(F.coalesce(X.trimmed(F.col("name")), F.lit("")) != "").select(X.norm_match(F.col("name")).alias("norm")).distinct()


def match_plain(names: DataFrame, reference: DataFrame) -> DataFrame:
    """names with method, confidence and match by equality and containment. A name of punctuation only is contained in every reference."""
    exact, partial, _ = _plain_tiers(_norms(names), _reference(reference))
    return _answer(names, exact.unionByName(partial))


def match(names: DataFrame, reference: DataFrame, floor: float = 0.8) -> DataFrame:
    """All five tiers: equal, contained, all words close, most similar of at least the floor, none."""
    ref = _with_letters(_reference(reference), "ref_norm", "ref_letters")
    exact, partial, rest = _plain_tiers(_with_letters(_norms(names), "norm", "letters"), ref)
    blocks = _blocks(ref)
    pairs = _joined(rest, blocks, _words_reach())
    fuzzy_words = _first(pairs.where(words_close("norm", "ref_norm")), "fuzzy_partial", F.lit(0.9))
    left = _joined(rest.join(fuzzy_words.select("norm"), "norm", "left_anti"), blocks, similar_enough(floor))
    near = left.withColumn("r", seq_ratio("norm", "ref_norm")).where(F.col("r") >= floor)
    best = near.groupBy("norm").agg(F.max_by(F.struct("ref_idx", "ref_name", F.col("r").alias("confidence")), F.struct("r", -F.col("ref_idx"))).alias("b"))
    fuzzy = best.select("norm", F.lit("fuzzy").alias("method"), "b.confidence", "b.ref_idx", "b.ref_name")
    return _answer(names, exact.unionByName(partial).unionByName(fuzzy_words).unionByName(fuzzy))


def canonical(names: DataFrame, reference: DataFrame, floor: float = 0.78) -> DataFrame:
    """The reference name of each name: equal, contained, or most similar of those that share a word."""
    ref = _with_letters(_reference(reference), "ref_norm", "ref_letters")
    exact, partial, rest = _plain_tiers(_with_letters(_norms(names), "norm", "letters"), ref)
    pairs = _sharing_a_word(rest, ref, similar_enough(floor))
    near = pairs.withColumn("r", seq_ratio("norm", "ref_norm")).where(F.col("r") >= floor)
    best = near.groupBy("norm").agg(F.max_by(F.struct("ref_idx", "ref_name", F.col("r").alias("confidence")), F.struct("r", -F.col("ref_idx"))).alias("b"))
    return _answer(names, exact.unionByName(partial).unionByName(best.select("norm", F.lit("fuzzy").alias("method"), "b.confidence", "b.ref_idx", "b.ref_name")))


def reference(s, d) -> DataFrame:
    return T.read(s, d, "nation").select(F.col("n_nationkey").alias("ref_idx"), F.col("n_name").alias("name"))


def noisy(s, d) -> DataFrame:
    """Customers' nations, damaged in five ways, and some that are blank or only punctuation."""
    c = T.read(s, d, "customer").join(T.read(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k, n = F.col("c_custkey"), F.col("n_name")
    name = (
        F.when(k % 50 == 7, "  ").when(k % 50 == 9, "??")
        .when(k % 5 == 0, n).when(k % 5 == 1, F.lower(n)).when(k % 5 == 2, F.concat(n, F.lit(" school"))).when(k % 5 == 3, F.concat(F.substring(n, 1, 2), F.substring(n, 4, 100))).otherwise(F.col("c_name"))
    )
    return c.select("c_custkey", name.alias("name"))


QUERIES = {
    "ref_match": lambda s, d: match_plain(noisy(s, d), reference(s, d)),
    "ref_match_fuzzy": lambda s, d: match(noisy(s, d), reference(s, d)),
    "canon_resolve": lambda s, d: canonical(noisy(s, d), reference(s, d)),
}
_N = "trim(regexp_replace(replace(lower({}), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g'))"
ORACLE = {
    "ref_match": f"""with c as (select c_custkey, case when c_custkey % 50 = 7 then '  ' when c_custkey % 50 = 9 then '??' when c_custkey % 5 = 0 then n_name when c_custkey % 5 = 1 then lower(n_name) when c_custkey % 5 = 2 then n_name || ' school'
        when c_custkey % 5 = 3 then substr(n_name, 1, 2) || substr(n_name, 4) else c_name end as name from customer join nation on c_nationkey = n_nationkey),
      n as (select *, case when trim(name) <> '' then {_N.format('name')} end as norm from c), r as (select n_nationkey as i, n_name as ref, {_N.format('n_name')} as rn from nation),
      e as (select norm, min(i) as i from (select distinct norm from n) join r on norm = rn group by 1),
      p as (select norm, min(i) as i from (select distinct norm from n) join r on contains(norm, rn) or contains(rn, norm) where norm not in (select norm from e) group by 1)
      select c_custkey, name, case when n.norm is null then 'missing' when e.i is not null then 'exact' when p.i is not null then 'partial' else 'none' end as method,
        case when e.i is not null then 1.0::double when p.i is not null then 0.95::double else 0.0::double end as confidence, r.ref as matched
      from n left join e on e.norm = n.norm left join p on p.norm = n.norm left join r on r.i = coalesce(e.i, p.i)""",
}
