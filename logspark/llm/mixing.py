"""Mixing sources to target weights along a time-varying curriculum.

Targets: each source's share of the mix by weight, limited to twice its size, the excess
reshared by weight. A source's documents stand in hash order; the first ones, up to the target's
remainder by cumulative size, are taken once more than the others. The curriculum: source s
has weight w_s(t) = target_s * (1 + slope_s * (1 - 2 t)) at time t in [0, 1]. Its integral,
W_s(t) / target_s = t + slope_s * (t - t^2), is the demand met by t; inverting it at a copy's
cumulative share of the source's demand gives its position, and the rows are range-sorted by it.

Null text: size 0. Null source: last in order. A document of size 0 is taken 0 words. Rows with
the same doc_id and source count as one document whose size is the largest of theirs. Rows
without doc_id are a document each, told apart by a hash of their content and, if equal in all,
by number. Ties in hash order fall to the doc_id, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logspark.llm.common import few, pick, saved, side

WEIGHTS, MIX_SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
#: Slopes of the sources' schedules, repeating: from early to late in training.
SLOPES = (0.8, 0.0, -0.8)
#: Documents that one hash bucket of a source holds, about.
BUCKET_ROWS = 5_000


def content(docs: DataFrame):
    """Column that tells rows without doc_id apart, null for the others."""
    rest = [docs[c] for c in ("text", "lang", "n_chars") if c in docs.columns]
    return F.when(docs["doc_id"].isNull(), F.sha2(F.to_json(F.struct(*rest)), 256))


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, row, nth, size): words of each document; row and nth: content and number without doc_id."""
    words = F.regexp_count(F.coalesce(docs["text"], F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    sized = docs.select("doc_id", "source", content(docs).alias("row"), words.alias("size")).groupBy("doc_id", "source", "row").agg(F.max("size").alias("size"), F.count("*").cast("int").alias("same"))
    nth = F.explode(F.sequence(F.lit(1), F.when(F.col("row").isNull(), 1).otherwise(F.col("same"))))
    return sized.select("doc_id", "source", "row", nth.alias("nth"), "size")


def targets(source_sizes: list[tuple[str | None, int]]) -> dict[str | None, float]:
    """Words to take from each source; source_sizes: one entry a source."""
    order = sorted(source_sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    total = MIX_SHARE * sum(size.values())
    out: dict[str | None, float] = {}
    free = set(size)
    while free:
        left, scale = total - sum(out.values()), sum(weight[s] for s in sorted(free, key=str))
        over = [s for s in free if left * weight[s] / scale > MOST * size[s]]
        if not over:
            out |= {s: left * weight[s] / scale for s in free}
            break
        for s in over:
            out[s] = MOST * size[s]
        free -= set(over)
    return out


def hash_order(doc_id):
    """60 bits of the SHA-256 of a doc_id: the order in which a source's documents are taken."""
    text = F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def plan(sized: DataFrame) -> DataFrame:
    """sized with source_size, target, copies, taken and first_position of each document."""
    spark = sized.sparkSession
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    rows = sorted(((r.source, r.source_size, r.n) for r in totals.collect()), key=lambda r: (r[0] is None, (r[0] or "").encode()))  # a row a source
    goal = targets([(s, size) for s, size, _ in rows])
    table = spark.createDataFrame([(s, int(size), float(goal[s]), float(SLOPES[i % len(SLOPES)]), max(1, n // BUCKET_ROWS)) for i, (s, size, n) in enumerate(rows)], "source string, source_size long, target double, slope double, buckets long")
    dealt = sized.alias("d").join(side(table).alias("t"), sized["source"].eqNullSafe(table["source"])).select("d.*", "source_size", "target", "slope", "buckets", hash_order(F.coalesce(F.col("doc_id").cast("string"), F.concat_ws(":", "row", "nth"))).alias("h"))
    # The order is by hash; a bucket is a range of it, so bucket totals give each bucket's start.
    share = F.col("h") / 2.0**60 * F.col("buckets")
    dealt = dealt.withColumn("bucket", F.least(F.floor(share), F.col("buckets") - 1))
    per = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    # A source's buckets are rows / BUCKET_ROWS in number; running sums over them are small.
    starts = per.select("source", "bucket", (F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("bucket_size")).alias("start"))
    joined = dealt.alias("d").join(side(starts).alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.bucket") == F.col("s.bucket"))).select("d.*", "start")
    before = F.col("start") + F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "row", "nth")) - F.col("size")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0)
    out = joined.withColumn("before", before).withColumn("full", full.cast("long"))
    rest = F.col("target") - F.col("full") * F.col("source_size")
    extra = (F.col("before") + F.col("size") / 2 <= rest) & (rest > 0)
    out = out.withColumn("copies", F.when(F.col("size") > 0, F.col("full") + extra.cast("long")).otherwise(0))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def position(before, slope):
    """t with t + slope * (t - t^2) = before: the time by which the schedule demands this share."""
    b = 1 + slope
    return F.when(F.abs(slope) < 1e-9, before).otherwise((b - F.sqrt(F.greatest(F.lit(0.0), b * b - 4 * slope * before))) / (2 * F.when(F.abs(slope) < 1e-9, 1.0).otherwise(slope)))


def placed(planned: DataFrame) -> DataFrame:
    """A row for each copy with its share of the demand and its training position in [0, 1]."""
    copies = planned.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    # Copies of the k-th pass follow all of the pass before it.
    demand = ((F.col("copy") - 1) * F.col("source_size") + F.col("before") + F.col("size") / 2) / F.greatest(F.col("target"), F.lit(1.0))
    return copies.withColumn("position", position(F.least(demand, F.lit(1.0)), F.col("slope")))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    planned = plan(saved(sizes(docs), "mix-sizes"))
    first = ((F.col("before") + F.col("size") / 2) / F.greatest(F.col("target"), F.lit(1.0)))
    at = F.when(F.col("copies") > 0, position(F.least(first, F.lit(1.0)), F.col("slope")))
    out = planned.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "copies", at.alias("position"))
    return out.orderBy("position", "doc_id").withColumn("position", F.round("position", 6))


def one_row(rows: DataFrame) -> DataFrame:
    """rows with a row for each doc_id and source: of repeated ones that with the most words, then the greatest. Rows without doc_id all stay."""
    many = rows.where("doc_id is not null").groupBy("doc_id", "source").count().where("count > 1").select(F.col("doc_id").alias("_id"), F.col("source").alias("_of"))
    many = saved(many, "mix-repeated")
    if few(many, 0):
        return rows
    same = (F.col("doc_id") == F.col("_id")) & F.col("source").eqNullSafe(F.col("_of"))
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    again = rows.join(side(many), same, "left_semi").groupBy("doc_id", "source").agg(F.max(F.struct(size.alias("_n"), *rows.columns)).alias("r"))
    return rows.join(side(many), same, "left_anti").unionByName(again.select(*[F.col("r")[c].alias(c) for c in rows.columns]))


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: a row for each taken copy, range-sorted by training position; rows without doc_id as in sizes.

    Rows that repeat a doc_id and a source are one document, and that with the most words is its text.
    """
    names = [c for c in ("doc_id", "text", "lang", "source", "n_chars") if c in docs.columns]
    spots = placed(plan(saved(sizes(docs), "mix-sizes"))).select("doc_id", F.col("source").alias("of"), "row", "size", "copy", "position")
    rows = one_row(pick(docs, *names))
    out = rows.join(spots, (rows["doc_id"] == spots["doc_id"]) & rows["source"].eqNullSafe(spots["of"])).select(*[rows[n] for n in names], "size", "copy", "position")
    # Equal rows without doc_id have a spot each: one of them is joined with all of these.
    unnamed = rows.where(rows["doc_id"].isNull()).withColumn("_row", content(rows)).dropDuplicates(["source", "_row"])
    of_none = spots.where("row is not null").drop("doc_id")
    more = unnamed.join(of_none, (F.col("_row") == F.col("row")) & F.col("source").eqNullSafe(F.col("of"))).select(*names, "size", "copy", "position")
    out = out.unionByName(more)
    return out.repartitionByRange("position", "doc_id", "copy").sortWithinPartitions("position", "doc_id", "copy")
