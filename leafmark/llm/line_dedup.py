"""Line deduplication by overlapping three-line windows, in DataFrame operations alone.

Every run of three consecutive lines that hold a word is hashed. A window that occurs more than once in
the corpus keeps its first occurrence, by (doc_id, position), and loses the lines of all later ones; the
lines covered by overlapping windows are merged into intervals and cut out of the text at once.

Windows are compared by 128 bits of hashes of their whole lines. Lines without a word neither join nor break a window and always stay. Only
hashes and positions are shuffled to find repeats; each text is moved once, to meet its intervals.

Cases: null doc_ids come first in the order; a null text stays null, an empty one empty, and a text of
fewer than three lines is unchanged. Rows that agree in doc_id and text are one document: they get the
same result and do not count as repeats of each other. Rows that share a doc_id only are ordered by their
text's hash. Further columns pass through; those named n_lines or n_removed are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WINDOW = 3
HAS_WORD = r"[^\x20\x09-\x0D]"


def _key(doc_id: str = "doc_id", text: str = "text") -> Column:
    return F.struct(F.col(doc_id).alias("doc_id"), F.xxhash64(F.lit(3), F.col(text)).alias("text_hash")).alias("doc")


def windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc, nth, hash): each window of consecutive worded lines; nth counts worded lines. The hash is two of 64 bits each."""
    worded = F.filter(F.split("text", "\n"), lambda line: line.rlike(HAS_WORD))
    runs = docs.select(_key(), worded.alias("lines")).where(F.size("lines") >= size)
    hashes = F.transform(
        F.arrays_zip(*[F.slice("lines", i + 1, F.size("lines") - (size - 1)).alias(f"l{i}") for i in range(size)]),
        lambda w: F.struct(F.xxhash64(*[w[f"l{i}"] for i in range(size)]).alias("a"), F.xxhash64(F.lit(41), *[w[f"l{i}"] for i in range(size)]).alias("b")),
    )
    return runs.select("doc", F.posexplode(hashes).alias("nth", "hash"))


def covered(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc, __cuts): for each document that loses lines, the intervals of worded lines that go, in order."""
    found = windows(docs, size)
    first = found.groupBy("hash").agg(F.min(F.struct("doc", "nth")).alias("first"), F.max(F.struct("doc", "nth")).alias("last")).where("first <> last")
    later = found.join(first.select("hash", "first"), "hash").where(F.struct("doc", "nth") != F.col("first")).select("doc", "nth").distinct()
    by_doc = Window.partitionBy("doc").orderBy("nth")
    opens = later.withColumn("opens", F.coalesce((F.col("nth") - F.lag("nth").over(by_doc) > size).cast("int"), F.lit(1)))
    merged = (
        opens.withColumn("part", F.sum("opens").over(by_doc))
        .groupBy("doc", "part")
        .agg(F.min("nth").alias("start"), (F.max("nth") + size).alias("end"))
    )
    return merged.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__cuts"))


def dedup_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs with text cut, and n_lines, n_removed: worded lines before and removed."""
    cuts = covered(docs, size).withColumnRenamed("doc", "__doc")
    # The intervals are far smaller than the texts: they are the side that is hashed.
    joined = docs.drop("n_lines", "n_removed").withColumn("__key", _key()).join(cuts.hint("shuffle_hash"), F.col("__key").eqNullSafe(F.col("__doc")), "left")
    lines = joined.withColumn("__lines", F.split("text", "\n")).withColumn("__n", F.size(F.filter("__lines", lambda x: x.rlike(HAS_WORD))))
    # Positions among all lines of the worded ones, so that cuts (which count worded lines) find their lines.
    at = F.filter(F.transform("__lines", lambda x, i: F.when(x.rlike(HAS_WORD), i)), lambda i: i.isNotNull())
    placed = lines.withColumn("__at", F.when(F.col("__cuts").isNotNull(), at))
    # Every worded line of an interval goes, the others stay: worded lines between two cuts, and wordless ones in between.
    gone = F.flatten(F.transform("__cuts", lambda c: F.slice("__at", c["start"] + 1, c["end"] - c["start"])))
    kept = placed.withColumn("__gone", gone).withColumn(
        "__bounds",
        # One entry per removed line, and both ends of the text, give the runs of lines that stay.
        F.arrays_zip(F.concat(F.array(F.lit(-1)), "__gone").alias("a"), F.concat("__gone", F.array(F.size("__lines"))).alias("b")),
    )
    runs = F.transform(F.filter("__bounds", lambda r: r["b"] - r["a"] > 1), lambda r: F.slice("__lines", r["a"] + 2, r["b"] - r["a"] - 1))
    text = F.when(F.col("__cuts").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(runs), "\n"))
    return (
        kept.withColumn("text", text)
        .withColumn("n_lines", F.when(F.col("__lines").isNull(), 0).otherwise(F.col("__n")).cast("long"))
        .withColumn("n_removed", F.coalesce(F.size("__gone"), F.lit(0)).cast("long"))
        .drop("__key", "__doc", "__cuts", "__lines", "__n", "__at", "__gone", "__bounds")
    )


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed")


OP2_SQL = r"""
with worded as (
  select doc_id, i - 1 as line_no, line,
         row_number() over (partition by doc_id order by i) - 1 as nth
  from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)
  where regexp_matches(line, '[^\x20\x09-\x0D]')
), w as (
  select doc_id, nth, line as a,
         lead(line, 1) over (partition by doc_id order by nth) as b,
         lead(line, 2) over (partition by doc_id order by nth) as c
  from worded
), later as (
  select doc_id, nth from (
    select doc_id, nth, row_number() over (partition by a, b, c order by doc_id, nth) as occurrence from w where c is not null)
  where occurrence > 1
), gone as (
  select distinct doc_id, nth + k as nth from later, (values (0), (1), (2)) t(k)
), gone_lines as (
  select g.doc_id, o.line_no from gone g join worded o on o.doc_id = g.doc_id and o.nth = g.nth
), counted as (select doc_id, count(*) as n_lines from worded group by 1)
, every as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents
), rest as (
  select e.doc_id, string_agg(e.line, chr(10) order by e.line_no) as text
  from every e left join gone_lines g on g.doc_id = e.doc_id and g.line_no = e.line_no where g.doc_id is null group by 1
)
select d.doc_id, case when d.text is null then null else coalesce(r.text, '') end as text,
       coalesce(c.n_lines, 0)::bigint as n_lines,
       (select count(*) from gone g where g.doc_id = d.doc_id)::bigint as n_removed
from documents d left join rest r on r.doc_id = d.doc_id left join counted c on c.doc_id = d.doc_id
"""
