"""Assignments, judges' ranks and final positions."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.plans import tables as T

BATCH_SIZE = 30


def rank_results(rankings: DataFrame) -> DataFrame:
    """Average rank, votes for first and second place and number of ranks of each submission."""
    return rankings.groupBy("submission_id").agg(
        F.avg("rank_position").alias("average_rank"),
        F.count_if(F.col("rank_position") == 1).alias("first_votes"),
        F.count_if(F.col("rank_position") == 2).alias("second_votes"),
        F.count("*").alias("num_ranks"),
    )


def reader_breakdown(rankings: DataFrame) -> DataFrame:
    """Each submission's ranks as position:e-mail in order, next to its aggregates."""
    ordered = F.array_sort(F.collect_list(F.struct("rank_position", "reader_email")))
    parts = F.transform(ordered, lambda r: F.concat_ws(":", r["rank_position"].cast("string"), r["reader_email"]))
    return rankings.groupBy("submission_id").agg(F.array_join(parts, ",").alias("breakdown"))


def round_one(rankings: DataFrame, finalists: DataFrame) -> DataFrame:
    """Ranks of assignments without finalists."""
    return rankings.join(finalists.select("assignment_id").distinct(), "assignment_id", "left_anti")


def round_two(rankings: DataFrame, finalists: DataFrame) -> DataFrame:
    """Ranks of assignments with finalists."""
    return rankings.join(finalists.select("assignment_id").distinct(), "assignment_id", "left_semi")


def numbered(rows: DataFrame, by: str, keys: dict[str, bool], tie: Column, name: str) -> DataFrame:
    """rows numbered from 1 within each value of by: by keys (column to whether it descends), equal ones by tie.

    Rows with equal keys are counted first, and the running sums of these counts tell where each run of equal keys starts. So no
    task sorts a whole group: the window over a group sees one row for each different combination of keys, the other one a run.
    """
    order = [F.desc(k) if down else F.asc(k) for k, down in keys.items()]
    runs = rows.groupBy(by, *keys).agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).select(*[F.col(k).alias(f"__{k}") for k in (by, *keys)], "__before")
    same = reduce(and_, [rows[k].eqNullSafe(starts[f"__{k}"]) for k in (by, *keys)])
    within = F.row_number().over(Window.partitionBy(by, *keys).orderBy(tie))
    return rows.join(starts, same).withColumn(name, (F.col("__before") + within).cast("int")).select(*rows.columns, name)


def final_position(results: DataFrame, essays: DataFrame, by: str = "grade") -> DataFrame:
    """Results with the essays' fields, numbered within each grade; a submission without a record has no grade."""
    keys = {"average_rank": False, "first_votes": True, "second_votes": True, "num_ranks": True}
    return numbered(results.join(essays, "submission_id", "left"), by, keys, F.col("submission_id").cast("string"), "final_position")


def round_two_seed(positions: DataFrame, n: int = 10) -> DataFrame:
    """The first n of each grade as finalists."""
    return positions.where((F.col("final_position") <= n) & F.col("grade").isNotNull()).select("grade", "submission_id", F.col("final_position").alias("finalist_position"))


def rank_join(rankings: DataFrame, essays: DataFrame) -> DataFrame:
    return rankings.join(essays, "submission_id", "left")


def finalist_rows(finalists: DataFrame, essays: DataFrame) -> DataFrame:
    """Finalists that have a record, with their position."""
    return finalists.join(essays, "submission_id")


def rank_valid(rankings: DataFrame) -> DataFrame:
    """Whether each assignment's ranks are exactly 1..N over N different essays."""
    n = F.count("*")
    return rankings.groupBy("assignment_id").agg(
        n.alias("n"),
        (
            (F.count_distinct("rank_position") == n)
            & (F.count_distinct("submission_id") == n)
            & (F.min("rank_position") == 1)
            & (F.max("rank_position") == n)
        ).alias("valid"),
    )


def batch_progress(assignments: DataFrame) -> DataFrame:
    """Assigned and completed batches of each grade; batches count from 1."""
    batch = F.struct("school_name", "grade", "batch_number")
    return (
        assignments.where("batch_number >= 1")
        .groupBy("grade")
        .agg(F.count_distinct(batch).alias("assigned_batches"), F.count_distinct(F.when(F.col("completed_at").isNotNull(), batch)).alias("completed_batches"))
    )


def assign_readers(assignments: DataFrame, readers: DataFrame) -> DataFrame:
    """Assignments with e-mail and name of their readers, if known."""
    return assignments.join(readers, "reader_id", "left")


def owner_emails(assignments: DataFrame, readers: DataFrame) -> DataFrame:
    """Distinct lower-case e-mails of each school and grade."""
    return (
        assignments.join(readers, "reader_id")
        .groupBy("school_name", "grade")
        .agg(F.array_join(F.array_sort(F.collect_set(F.lower("email"))), ";").alias("emails"))
    )


def reader_rankings(rankings: DataFrame, assignment_id: int, reader_id: int) -> DataFrame:
    return rankings.where((F.col("assignment_id") == assignment_id) & (F.col("reader_id") == reader_id)).orderBy("rank_position")


def replace_group(rankings: DataFrame, new: DataFrame) -> DataFrame:
    """Rankings with whole (assignment, reader) groups replaced by those in new."""
    return rankings.join(new.select("assignment_id", "reader_id").distinct(), ["assignment_id", "reader_id"], "left_anti").unionByName(new)


def mark_completed(assignments: DataFrame, done: DataFrame) -> DataFrame:
    """Assignments with time and lower-case e-mail of completion; completed ones are read-only."""
    patch = done.select("assignment_id", F.col("at").alias("__at"), F.lower("by_email").alias("__by"))
    joined = assignments.join(patch, "assignment_id", "left")
    late = F.col("completed_at").isNotNull()
    return joined.withColumn("completed_by", F.when(~late, F.col("__by"))).withColumn("completed_at", F.coalesce("completed_at", "__at")).drop("__at", "__by")


def rank_conflicts(requests: DataFrame, saved: DataFrame, sizes: DataFrame) -> DataFrame:
    """Why each requested rank cannot be saved: out of 1..N, unknown essay, or a rank in use by another essay."""
    known = saved.select("assignment_id", "submission_id", F.lit(True).alias("__known")).distinct()
    used = saved.groupBy("assignment_id", "rank_position").agg(F.min("submission_id").alias("__least"), F.max("submission_id").alias("__most"))
    joined = (
        requests.join(sizes, "assignment_id", "left")
        .join(known, ["assignment_id", "submission_id"], "left")
        .join(used, ["assignment_id", "rank_position"], "left")
    )
    other = (F.col("__least") != F.col("submission_id")) | (F.col("__most") != F.col("submission_id"))
    reason = (
        F.when(F.col("n").isNull() | (F.col("rank_position") < 1) | (F.col("rank_position") > F.col("n")), "rank_out_of_range")
        .when(F.col("__known").isNull(), "essay_not_assigned")
        .when(other, "rank_in_use")
        .otherwise("ok")
    )
    return joined.select("assignment_id", "submission_id", "rank_position", reason.alias("reason"))


def rank_sections(positions: DataFrame, winners: DataFrame, progress: DataFrame) -> DataFrame:
    """For each grade: round-one winner, ids of the top ten, round-two winner and batch progress."""
    first = positions.where("final_position <= 10").groupBy("grade").agg(
        F.max(F.when(F.col("final_position") == 1, F.col("submission_id"))).alias("winner"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("final_position", "submission_id"))), lambda r: r["submission_id"].cast("string")), ",").alias("top_ten"),
    )
    second = winners.where("final_position = 1").select("grade", F.col("submission_id").alias("round_two_winner"))
    return first.join(second, "grade", "left").join(progress, "grade", "left")


def batch_count(groups: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """groups (with n) and their number of batches."""
    return groups.withColumn("batches", F.ceil(F.col("n") / size).cast("long"))


def batch_rows(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], size: int = BATCH_SIZE) -> DataFrame:
    """rows with batch_number and place: an even split of each group, early batches taking the remainder."""
    group = Window.partitionBy(*keys)
    n, i = F.count("*").over(group), F.row_number().over(group.orderBy(*order)) - 1
    numbered = rows.withColumns({"__n": n, "__i": i}).withColumn("__b", F.ceil(F.col("__n") / size))
    base, extra = F.floor(F.col("__n") / F.col("__b")), F.col("__n") % F.col("__b")
    early = (base + 1) * extra
    batch = F.when(F.col("__i") < early, F.floor(F.col("__i") / (base + 1))).otherwise(extra + F.floor((F.col("__i") - early) / base)) + 1
    return numbered.withColumn("batch_number", batch.cast("long")).withColumn("place", F.col("__i").cast("long")).drop("__n", "__i", "__b")


def batch_bounds(groups: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """[start, end) of every batch of groups (with n)."""
    b = batch_count(groups, size).where("n > 0").withColumn("batch_number", F.explode(F.sequence(F.lit(1).cast("long"), F.col("batches"))))
    base, extra = F.floor(F.col("n") / F.col("batches")), F.col("n") % F.col("batches")
    start = (F.col("batch_number") - 1) * base + F.least(F.col("batch_number") - 1, extra)
    return b.withColumn("start", start).withColumn("end", start + base + (F.col("batch_number") <= extra).cast("long"))


def batch_summary(groups: DataFrame, assignments: DataFrame, readers: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """Every batch of every group with the e-mails of its assigned readers."""
    batches = batch_bounds(groups, size).select("school_name", "grade", "batch_number", (F.col("end") - F.col("start")).alias("essays"))
    emails = (
        assignments.join(readers, "reader_id")
        .groupBy("school_name", "grade", "batch_number")
        .agg(F.array_join(F.array_sort(F.collect_set(F.lower("email"))), ";").alias("reader_emails"))
    )
    return batches.join(emails, ["school_name", "grade", "batch_number"], "left").withColumn("reader_emails", F.coalesce("reader_emails", F.lit("")))


def pair_readers(batches: DataFrame, readers: DataFrame, taken: DataFrame) -> DataFrame:
    """Reader k gets batch k of each group, unless that (reader, group, batch) is assigned already."""
    paired = batches.join(readers.select("reader_id", F.col("position").alias("batch_number")), "batch_number")
    return paired.select("reader_id", "school_name", "grade", "batch_number").join(taken.select("reader_id", "school_name", "grade", "batch_number"), ["reader_id", "school_name", "grade", "batch_number"], "left_anti")


def assignment_essays(assignments: DataFrame, finalists: DataFrame, slices: DataFrame) -> DataFrame:
    """The essays of each assignment: its finalists if it has any, else its batch of its group."""
    own = finalists.select("assignment_id", "submission_id").distinct()
    rest = assignments.join(finalists.select("assignment_id").distinct(), "assignment_id", "left_anti")
    dealt = rest.join(slices, ["school_name", "grade", "batch_number"]).select("assignment_id", "submission_id")
    return own.unionByName(dealt)


def reader_choices(rankings: DataFrame, finalists: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct readers of round one by lower-case e-mail; the last name given wins."""
    rows = round_one(rankings, finalists).join(names, "reader_id")
    return rows.groupBy(F.lower("email").alias("email")).agg(F.max_by("name", F.struct("assignment_id", "reader_id", "submission_id")).alias("name")).withColumn("label", F.concat("name", F.lit(" ("), "email", F.lit(")")))


def _groups(s, d):
    return T.assignments(s, d).where("batch_number >= 1").groupBy("school_name", "grade").agg(F.count("*").alias("n"))


def _positions(s, d):
    return final_position(rank_results(round_one(T.rankings(s, d), T.finalists(s, d))), T.essays(s, d))


def _new_rankings(s, d):
    return T.rankings(s, d).where("assignment_id % 50 = 1 and rank_position = 1").withColumn("rank_position", F.lit(9))


def _requests(s, d):
    r = T.rankings(s, d).where("assignment_id % 7 = 0")
    return r.select("assignment_id", F.when(F.col("reader_id") % 11 == 0, F.col("submission_id") + 1).otherwise(F.col("submission_id")).alias("submission_id"), (F.col("rank_position") + F.col("reader_id") % 3 - 1).cast("int").alias("rank_position")).distinct()


def _all_readers(s, d):
    return T.readers(s, d).select("reader_id", F.col("reader_id").alias("position"))


def _slices(s, d):
    e = T.essays(s, d).select("submission_id", F.concat(F.lit("school "), (F.col("submission_id") % 7).cast("string")).alias("school_name"), F.element_at(F.array(*[F.lit(p) for p in PRIORITIES]), (F.col("submission_id") % 5 + 1).cast("int")).alias("grade"))
    return batch_rows(e, ("school_name", "grade"), ("submission_id",))


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")

QUERIES = {
    "rank_results": lambda s, d: rank_results(round_one(T.rankings(s, d), T.finalists(s, d))),
    "final_position": _positions,
    "reader_breakdown": lambda s, d: reader_breakdown(T.rankings(s, d)),
    "round1_rows": lambda s, d: round_one(T.rankings(s, d), T.finalists(s, d)),
    "round2_rows": lambda s, d: round_two(T.rankings(s, d), T.finalists(s, d)),
    "round2_seed": lambda s, d: round_two_seed(_positions(s, d)),
    "rank_join": lambda s, d: rank_join(T.rankings(s, d), T.essays(s, d)),
    "finalist_rows": lambda s, d: finalist_rows(T.finalists(s, d), T.essays(s, d)),
    "rank_valid": lambda s, d: rank_valid(T.rankings(s, d)),
    "batch_progress": lambda s, d: batch_progress(T.assignments(s, d)),
    "assign_readers": lambda s, d: assign_readers(T.assignments(s, d), T.readers(s, d)),
    "owner_emails": lambda s, d: owner_emails(T.assignments(s, d), T.readers(s, d)),
    "reader_rankings": lambda s, d: reader_rankings(T.rankings(s, d), 1, 1).unionByName(T.rankings(s, d).where("reader_id = 2")),
    "replace_group": lambda s, d: replace_group(T.rankings(s, d), _new_rankings(s, d)),
    "mark_completed": lambda s, d: mark_completed(T.assignments(s, d), T.assignments(s, d).where("assignment_id % 3 = 0").select("assignment_id", F.col("created_at").alias("at"), F.lit("Chair@Example.org").alias("by_email"))),
    "rank_conflicts": lambda s, d: rank_conflicts(_requests(s, d), T.rankings(s, d), T.rankings(s, d).groupBy("assignment_id").agg(F.count("*").alias("n"))),
    "rank_sections": lambda s, d: rank_sections(
        _positions(s, d),
        final_position(rank_results(round_two(T.rankings(s, d), T.finalists(s, d))), T.essays(s, d)),
        T.rankings(s, d).join(T.essays(s, d), "submission_id").groupBy("grade").agg(F.count_distinct("assignment_id").alias("assignments")),
    ),
    "batch_count": lambda s, d: batch_count(_groups(s, d)),
    "batch_bounds": lambda s, d: batch_bounds(_groups(s, d)),
    "batch_rows": _slices,
    "batch_summary": lambda s, d: batch_summary(_groups(s, d), T.assignments(s, d), T.readers(s, d)),
    "pair_readers": lambda s, d: pair_readers(batch_bounds(_groups(s, d)).select("school_name", "grade", "batch_number"), _all_readers(s, d), T.assignments(s, d)),
    "pair_all_readers": lambda s, d: pair_readers(batch_bounds(_groups(s, d)).select("school_name", "grade", "batch_number"), _all_readers(s, d), T.assignments(s, d)),
    "assignment_essays": lambda s, d: assignment_essays(T.assignments(s, d), T.finalists(s, d), _slices(s, d)),
    "reader_choices": lambda s, d: reader_choices(T.rankings(s, d), T.finalists(s, d), T.readers(s, d)),
}

RESULTS = """
results as (select submission_id, avg(rank_position) as average_rank, count(*) filter (rank_position = 1)::bigint as first_votes,
  count(*) filter (rank_position = 2)::bigint as second_votes, count(*)::bigint as num_ranks
  from rankings where assignment_id not in (select assignment_id from finalists) group by 1),
results_2 as (select submission_id, avg(rank_position) as average_rank, count(*) filter (rank_position = 1)::bigint as first_votes,
  count(*) filter (rank_position = 2)::bigint as second_votes, count(*)::bigint as num_ranks
  from rankings where assignment_id in (select assignment_id from finalists) group by 1),
positions as (select r.*, student_name, school_name, grade, row_number() over (partition by grade order by average_rank, first_votes desc,
  second_votes desc, num_ranks desc, r.submission_id::varchar)::int as final_position from results r left join essays e on e.submission_id = r.submission_id),
positions_2 as (select r.*, student_name, school_name, grade, row_number() over (partition by grade order by average_rank, first_votes desc,
  second_votes desc, num_ranks desc, r.submission_id::varchar)::int as final_position from results_2 r left join essays e on e.submission_id = r.submission_id)
"""
GROUPS = "grp as (select school_name, grade, count(*)::bigint as n from assignments where batch_number >= 1 group by 1, 2)"
BOUNDS = """
counted as (select *, ceil(n / 30.0)::bigint as batches from grp),
bounds as (select *, (batch_number - 1) * (n // batches) + least(batch_number - 1, n % batches) as start from (select *, unnest(range(1, batches + 1)) as batch_number from counted)),
bounded as (select *, start + n // batches + (batch_number <= n % batches)::bigint as "end" from bounds)
"""
SLICES = f"""
slices_0 as (select submission_id, 'school ' || (submission_id % 7) as school_name, ([{", ".join(repr(p) for p in PRIORITIES)}])[submission_id % 5 + 1] as grade from essays),
slices_1 as (select *, count(*) over (partition by school_name, grade) as n, row_number() over (partition by school_name, grade order by submission_id) - 1 as place from slices_0),
slices as (select submission_id, school_name, grade, place::bigint as place, (case when place < (n // b + 1) * (n % b) then place // (n // b + 1)
  else n % b + (place - (n // b + 1) * (n % b)) // (n // b) end + 1)::bigint as batch_number from (select *, ceil(n / 30.0)::bigint as b from slices_1))
"""
_R = (T.RANKINGS, T.FINALISTS, T.ESSAYS, RESULTS)
ORACLE = {
    "rank_results": T.sql("select * from results", *_R),
    "final_position": T.sql("select * from positions", *_R),
    "reader_breakdown": T.sql("select submission_id, string_agg(rank_position || ':' || reader_email, ',' order by rank_position, reader_email) as breakdown from rankings group by 1", T.RANKINGS),
    "round1_rows": T.sql("select * from rankings where assignment_id not in (select assignment_id from finalists)", T.RANKINGS, T.FINALISTS),
    "round2_rows": T.sql("select * from rankings where assignment_id in (select assignment_id from finalists)", T.RANKINGS, T.FINALISTS),
    "round2_seed": T.sql("select grade, submission_id, final_position as finalist_position from positions where final_position <= 10 and grade is not null", *_R),
    "rank_join": T.sql("select r.*, e.student_name, e.school_name, e.grade from rankings r left join essays e on e.submission_id = r.submission_id", T.RANKINGS, T.ESSAYS),
    "finalist_rows": T.sql("select f.*, e.student_name, e.school_name, e.grade from finalists f join essays e on e.submission_id = f.submission_id", T.FINALISTS, T.ESSAYS),
    "rank_valid": T.sql("select assignment_id, count(*)::bigint as n, count(distinct rank_position) = count(*) and count(distinct submission_id) = count(*) and min(rank_position) = 1 and max(rank_position) = count(*) as valid from rankings group by 1", T.RANKINGS),
    "batch_progress": T.sql("select grade, count(distinct (school_name, grade, batch_number))::bigint as assigned_batches, count(distinct case when completed_at is not null then (school_name, grade, batch_number) end)::bigint as completed_batches from assignments where batch_number >= 1 group by 1", T.ASSIGNMENTS),
    "assign_readers": T.sql("select a.*, r.email, r.name from assignments a left join readers r on r.reader_id = a.reader_id", T.ASSIGNMENTS, T.READERS),
    "owner_emails": T.sql("select school_name, grade, string_agg(email, ';' order by email) as emails from (select distinct school_name, grade, lower(email) as email from assignments join readers using (reader_id)) group by 1, 2", T.ASSIGNMENTS, T.READERS),
    "reader_rankings": T.sql("select * from (select * from rankings where assignment_id = 1 and reader_id = 1 union all select * from rankings where reader_id = 2)", T.RANKINGS),
    "replace_group": T.sql("new as (select assignment_id, reader_id, submission_id, 9::int as rank_position, reader_email from rankings where assignment_id % 50 = 1 and rank_position = 1) select * from rankings where (assignment_id, reader_id) not in (select (assignment_id, reader_id) from new) union all select * from new", T.RANKINGS),
    "mark_completed": T.sql("select assignment_id, reader_id, grade, school_name, batch_number, created_at, case when completed_at is null and assignment_id % 3 = 0 then 'chair@example.org' end as completed_by, coalesce(completed_at, case when assignment_id % 3 = 0 then created_at end) as completed_at from assignments", T.ASSIGNMENTS),
    "rank_conflicts": T.sql("""q as (select distinct assignment_id, case when reader_id % 11 = 0 then submission_id + 1 else submission_id end as submission_id, (rank_position + reader_id % 3 - 1)::int as rank_position from rankings where assignment_id % 7 = 0),
      z as (select assignment_id, count(*) as n from rankings group by 1), k as (select distinct assignment_id, submission_id from rankings),
      u as (select assignment_id, rank_position, min(submission_id) as lo, max(submission_id) as hi from rankings group by 1, 2)
      select q.*, case when z.n is null or q.rank_position < 1 or q.rank_position > z.n then 'rank_out_of_range' when k.submission_id is null then 'essay_not_assigned'
        when u.lo <> q.submission_id or u.hi <> q.submission_id then 'rank_in_use' else 'ok' end as reason
      from q left join z using (assignment_id) left join k on k.assignment_id = q.assignment_id and k.submission_id = q.submission_id
      left join u on u.assignment_id = q.assignment_id and u.rank_position = q.rank_position""", T.RANKINGS),
    "rank_sections": T.sql("""f as (select grade, max(case when final_position = 1 then submission_id end) as winner, string_agg(submission_id::varchar, ',' order by final_position) as top_ten from positions where final_position <= 10 group by 1),
      p as (select grade, count(distinct assignment_id)::bigint as assignments from rankings join essays using (submission_id) group by 1)
      select f.*, w.submission_id as round_two_winner, p.assignments from f left join (select grade, submission_id from positions_2 where final_position = 1) w on w.grade = f.grade left join p on p.grade = f.grade""", *_R),
    "batch_count": T.sql("select *, ceil(n / 30.0)::bigint as batches from grp", T.ASSIGNMENTS, GROUPS),
    "batch_bounds": T.sql("select * from bounded", T.ASSIGNMENTS, GROUPS, BOUNDS),
    "batch_rows": T.sql("select * from slices", T.ESSAYS, SLICES),
    "batch_summary": T.sql("""e as (select school_name, grade, batch_number, string_agg(email, ';' order by email) as reader_emails from (select distinct school_name, grade, batch_number, lower(email) as email from assignments join readers using (reader_id)) group by 1, 2, 3)
      select b.school_name, b.grade, b.batch_number, b."end" - b.start as essays, coalesce(reader_emails, '') as reader_emails from bounded b left join e on e.school_name = b.school_name and e.grade = b.grade and e.batch_number = b.batch_number""", T.ASSIGNMENTS, T.READERS, GROUPS, BOUNDS),
    "pair_readers": T.sql("select reader_id, school_name, grade, batch_number from bounded b join readers r on r.reader_id = b.batch_number where (reader_id, school_name, grade, batch_number) not in (select (reader_id, school_name, grade, batch_number) from assignments)", T.ASSIGNMENTS, T.READERS, GROUPS, BOUNDS),
    "assignment_essays": T.sql("select distinct assignment_id, submission_id from finalists union all select a.assignment_id, s.submission_id from assignments a join slices s using (school_name, grade, batch_number) where a.assignment_id not in (select assignment_id from finalists)", T.ASSIGNMENTS, T.FINALISTS, T.ESSAYS, SLICES),
    "reader_choices": T.sql("select *, name || ' (' || email || ')' as label from (select lower(email) as email, arg_max(name, (assignment_id, reader_id, submission_id)) as name from rankings join readers using (reader_id) where assignment_id not in (select assignment_id from finalists) group by 1)", T.RANKINGS, T.FINALISTS, T.READERS),
}
ORACLE["pair_all_readers"] = ORACLE["pair_readers"]
