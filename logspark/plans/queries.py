"""Every operator as a query over the given tables: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.functions import columns as col
from logspark.functions.mask import collapse, mask, mask_count
from logspark.operators import bootstrap, calibration, curves, drift, leakage, metrics, ood, requests, selective, sequence, sketches, splits, stats
from logspark.operators.tables import folder, saved
from logspark.plans import data
from logspark.sources import logs
from logspark.streaming import streams

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(n, digits).alias(n) if t == "double" else F.col(n).cast("long").alias(n) if t == "int" else F.col(n) for n, t in df.dtypes])


# Masks


@query
def mask_lines(spark, sf):
    return data.lines(spark, sf).select("group_id", "line_no", mask(F.col("text")).alias("masked"))


@query
def template_counts(spark, sf):
    equal = data.lines(spark, sf).groupBy("source", "text").agg(F.count("*").alias("n"))
    return equal.groupBy("source", mask(F.col("text")).alias("masked")).agg(F.sum("n").alias("cnt"))


@query
def collapse_masks(spark, sf):
    return data.lines(spark, sf).groupBy("source", collapse(mask(F.col("text"))).alias("collapsed")).agg(F.count("*").alias("cnt"))


@query
def mask_stats(spark, sf):
    return data.lines(spark, sf).select("source", mask_count(mask(F.col("text"))).alias("m")).groupBy("source").agg(F.count("*").alias("n_lines"), F.sum("m").alias("n_masks"))


# Sources


@query
def label_prefix_parse(spark, sf):
    return rounded(logs.parse_prefixed(data.event_lines(spark, sf).drop("label")).select("line_no", "label", "text"))


@query
def session_keys(spark, sf):
    return logs.parse_sessions(data.conversation_lines(spark, sf).drop("group_id", "text"), "instance").select("group_id", "line_no", F.length("text").cast("long").alias("n_chars"))


@query
def label_csv_join(spark, sf):
    labels = data.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("group_id"), F.col("toxic").alias("label"))
    return sequence.sessions(data.lines(spark, sf), labels).groupBy("source", F.col("label").cast("long").alias("label")).agg(F.count("*").alias("n"))


@query
def checksum_verify(spark, sf):
    """All tables, a file or a folder of files each, against a list in which those from `l` on have another sum, those from `o` on are not named, and one is too many."""
    files = logs.files_in(spark, sf, "*.parquet")
    have = logs.table_digests(files, sf)
    listed = have.where("name < 'o'").withColumn("sha256", F.when(F.col("name") >= "l", F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    gone = spark.createDataFrame([("gone.parquet", "0")], "name string, sha256 string")
    return logs.verify_checksums(files, listed.unionByName(gone), sf).select("name", "status")


@query
def file_digests(spark, sf):
    """Turns written as text, a file for every 100 conversations, and the digests of these files."""
    path = folder(spark, "digest-files")
    c = data.table(spark, sf, "conversations").select(F.floor(F.col("conv_id") / 100).alias("part"), "conv_id", "turn", "text")
    c.repartition("part").sortWithinPartitions("part", "conv_id", "turn").select("part", F.col("text").alias("value")).write.partitionBy("part").text(path)
    found = logs.digests(logs.files_in(spark, path, "*.txt"))
    return found.select(F.regexp_extract("path", "part=([0-9]+)", 1).cast("long").alias("part"), "sha256", "bytes")


@query
def read_numbered_lines(spark, sf):
    """Events as raw lines in several files, read back with their numbers."""
    path = folder(spark, "raw-lines")
    data.event_lines(spark, sf).orderBy("line_no").select("value").write.text(path)
    return logs.read_lines(spark, path, "events").select("system", "line_no", "value")


@query
def block_keys(spark, sf):
    value = F.concat(F.lit("on blk_-"), F.col("group_id"), F.lit(": "), F.col("text"), F.lit(" blk_7"))
    rows = data.conversation_lines(spark, sf).withColumn("value", value).drop("group_id", "text")
    return logs.parse_sessions(rows, "block").select("group_id", "line_no", F.length("text").cast("long").alias("n_chars"))


@query
def label_csv_read(spark, sf):
    """Labels written as CSV with a header in each file, read back, joined to the documents."""
    path = folder(spark, "labels-csv")
    mark = F.when(F.col("toxic") == 1, " Anomaly").otherwise("Normal")
    data.table(spark, sf, "labels").select(F.col("doc_id").alias("InstanceId"), mark.alias("Label")).write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return sequence.sessions(data.lines(spark, sf), logs.read_labels(spark, path, trim=True)).select("group_id", F.col("label").cast("long").alias("label"))


@query
def csv_sink(spark, sf):
    path = folder(spark, "csv")
    logs.write_csv(data.cells(spark, sf).select("axis", "condition", "seed", "value"), path, 3)
    return spark.read.option("header", True).csv(path)


@query
def custom_masks(spark, sf):
    rules = [("[A-Z][a-z]+", "<NAME>"), ("[0-9]+", "<N>")]
    return data.lines(spark, sf).select("group_id", "line_no", mask(F.col("text"), rules, lowercase=True).alias("masked"))


@query
def leakage_gate(spark, sf):
    lines = data.lines(spark, sf)
    groups = data.table(spark, sf, "documents").select(F.col("lang").alias("source"), F.col("source").alias("group_id"))
    bad = leakage.gate(leakage.audit(lines, groups), strict=False)
    return lines.select(F.col("source").alias("target")).distinct().withColumn("leaks", F.col("target").isin(bad))


@query
def plugin_scorer(spark, sf):
    """A scorer given as a callable: the share of a sequence's lines that are empty."""
    seqs = data.lines(spark, sf).groupBy("group_id").agg(F.collect_list("text").alias("lines"))
    return rounded(requests.score_with(seqs, lambda: lambda groups: [sum(not x for x in g) / len(g) for g in groups]))


@query
def predictions_quarantine(spark, sf):
    """Prediction lines of which one in ten is cut off and one in ten lacks its truth: how many come back, and how many of each reject."""
    path = folder(spark, "predictions-text")
    rows = data.predictions(spark, sf)
    value = F.to_json(F.struct(F.col("row_id").cast("string").alias("group_id"), F.when(F.col("row_id") % 10 != 4, F.col("y_true")).alias("y_true"), "y_pred", "p_anomaly"))
    rows.select(F.when(F.col("row_id") % 10 == 3, F.substring(value, 1, 12)).otherwise(value).alias("value")).write.text(path)
    records, rejects = logs.read_records(spark, path, logs.PREDICTION, ("y_true", "y_pred", "p_anomaly"))
    kinds = records.select(F.lit("read").alias("reason"), "y_true").unionByName(rejects.select("reason", F.lit(None).cast("int").alias("y_true")))
    return kinds.groupBy("reason").agg(F.count("*").alias("n"), F.coalesce(F.sum("y_true"), F.lit(0)).alias("positives"))


@query
def predictions_roundtrip(spark, sf):
    path = folder(spark, "predictions")
    logs.write_predictions(data.predictions(spark, sf).withColumn("group_id", F.col("row_id").cast("string")), path)
    return rounded(logs.read_predictions(spark, path))


# Sequences


def _digest(seqs: DataFrame) -> DataFrame:
    return seqs.select("group_id", F.size("lines").cast("long").alias("n_lines"), F.sha2(F.array_join("lines", "\n"), 256).alias("digest"))


@query
def session_sequences(spark, sf):
    return _digest(sequence.sessions(data.conversation_lines(spark, sf)))


@query
def session_truncated(spark, sf):
    return _digest(sequence.sessions(data.conversation_lines(spark, sf), limit=3))


@query
def flatten_lengths(spark, sf):
    s = sequence.sessions(data.conversation_lines(spark, sf))
    return s.select("group_id", F.size("lines").cast("long").alias("length"), F.posexplode("lines").alias("pos", "line")).select("group_id", "length", F.col("pos").cast("long").alias("pos"), F.length("line").cast("long").alias("n_chars"))


@query
def sliding_windows(spark, sf):
    return rounded(sequence.sliding(data.event_lines(spark, sf)).drop("source"))


@query
def sliding_windows_padded(spark, sf):
    return rounded(sequence.sliding(data.event_lines(spark, sf), 96, 36, pad_last=True).drop("source"))


@query
def window_texts(spark, sf):
    """Windows with their lines, the last one over the tail."""
    e = data.table(spark, sf, "events")
    lines = e.select(F.lit("events").alias("source"), F.col("event_id").alias("line_no"), (F.col("event_type") == "error").cast("int").alias("label"), F.concat_ws(" ", "event_type", "props").alias("text"))
    out = sequence.window_lines(lines, 96, 36, pad_last=True)
    return _digest(out).join(out.select("group_id", F.col("label").cast("long").alias("label")), "group_id")


def _totals(spark, sf):
    return data.lines(spark, sf).groupBy("source").agg(F.count("*").alias("total"))


@query
def window_specs(spark, sf):
    return rounded(sequence.window_specs(_totals(spark, sf), 100, 20))


@query
def window_coverage(spark, sf):
    e = data.event_lines(spark, sf)
    return sequence.uncovered(e, 36, 96)


@query
def dataset_profile(spark, sf):
    return rounded(sequence.profile(data.sequences(spark, sf)).drop("mean_lines", "p95_lines"))


@query
def sequence_length_profile(spark, sf):
    return rounded(sequence.profile(data.sequences(spark, sf)).select("source", "mean_lines", "p95_lines"))


# Splits and folds


def _split(spark, sf):
    return splits.with_split(data.sequences(spark, sf))


@query
def hash_split(spark, sf):
    return _split(spark, sf).select("group_id", "split")


@query
def split_stats(spark, sf):
    return splits.split_stats(_split(spark, sf))


@query
def split_manifest(spark, sf):
    return splits.manifest(_split(spark, sf))


@query
def manifest_document(spark, sf):
    """Groups and splits as the lines of the manifest document state them."""
    path = folder(spark, "manifest")
    splits.write_manifest(_split(spark, sf), path)
    entry = r'"([0-9]+)": "(train|val|test)"$'
    lines = spark.read.text(path).where(F.col("value").rlike(entry))
    return lines.select(F.regexp_extract("value", entry, 1).alias("group_id"), F.regexp_extract("value", entry, 2).alias("split"))


@query
def sketch_folds(spark, sf):
    """Folds from merged sketches against exact answers: lines, distinct texts, and whether the sketches are within their errors."""
    seqs = data.lines(spark, sf).groupBy("source", "group_id").agg(F.collect_list("text").alias("lines"), F.count("*").alias("n_lines"))
    kept = saved(splits.with_split(seqs), "sketch-sequences")
    folds = sketches.of_folds(saved(sketches.sketched(kept), "sketches")).withColumns({"q": sketches.quantile(0.95), "d": sketches.distinct()})
    # The exact sizes of a fold follow from the set of systems of each text.
    systems = kept.select("source", F.explode("lines").alias("text")).groupBy("text").agg(F.collect_set("source").alias("own")).groupBy("own").agg(F.count("*").alias("n_texts"))
    sums = folds.select("target", "role").join(systems, F.when(F.col("role") == "test", F.array_contains("own", F.col("target"))).otherwise(F.size(F.array_remove("own", F.col("target"))) > 0)).groupBy("target", "role").agg(F.sum("n_texts").alias("texts"))
    by_length = kept.groupBy("source", F.col("n_lines").alias("length")).agg(F.count("*").alias("c"))
    side = F.when(F.col("role") == "test", F.col("source") == F.col("target")).otherwise(F.col("source") != F.col("target"))
    below = folds.select("target", "role", "q").join(by_length, side).groupBy("target", "role").agg((F.sum(F.when(F.col("length") < F.col("q"), F.col("c")).otherwise(0)) / F.sum("c")).alias("low"), (F.sum(F.when(F.col("length") <= F.col("q"), F.col("c")).otherwise(0)) / F.sum("c")).alias("high"))
    out = folds.select("target", "role", "n", "d").join(sums, ["target", "role"]).join(below, ["target", "role"])
    near = F.abs(F.col("d") / F.col("texts") - 1) <= sketches.COUNT_ERROR
    inside = (F.col("low") - sketches.RANK_ERROR <= 0.95) & (F.col("high") + sketches.RANK_ERROR >= 0.95)
    return out.select("target", "role", "n", "texts", near.alias("texts_near"), inside.alias("quantile_near"))


@query
def chrono_split(spark, sf):
    return splits.chronological(data.event_lines(spark, sf)).groupBy("split").agg(F.count("*").alias("n"), F.min("line_no").alias("first"), F.max("line_no").alias("last"))


@query
def loso_folds(spark, sf):
    return splits.folds(data.sequences(spark, sf))


@query
def loso_compose(spark, sf):
    whole = splits.compose(_split(spark, sf)).withColumn("mode", F.lit("whole"))
    return whole.unionByName(splits.compose(_split(spark, sf), use_splits=True).withColumn("mode", F.lit("splits")))


@query
def strip_labels(spark, sf):
    return splits.strip_labels(data.sequences(spark, sf), F.col("source") == "en").groupBy("source").agg(F.sum("label").alias("anomalies"))


@query
def class_weights(spark, sf):
    return rounded(splits.class_weights(data.sequences(spark, sf), "source"))


@query
def majority_baseline(spark, sf):
    train = splits.compose(data.sequences(spark, sf)).where("role = 'train'").withColumnRenamed("target", "fold")
    test = data.predictions(spark, sf).select("fold", "row_id", "y_true")
    return metrics.confusion(splits.majority(train, test))


@query
def fraction_sample(spark, sf):
    return splits.fraction_sample(data.sequences(spark, sf), ["source"], "group_id", 0.05).select("source", "group_id")


@query
def stratified_split(spark, sf):
    return splits.stratified(data.predictions(spark, sf), ["fold", "y_true"], "row_id", 0.5).select("row_id", "part")


# Leakage and distance


@query
def leakage_audit(spark, sf):
    rows = data.lines(spark, sf)
    groups = data.table(spark, sf, "documents").select(F.col("lang").alias("source"), F.col("source").alias("group_id"))
    return leakage.audit(rows, groups)


@query
def leakage_group_samples(spark, sf):
    groups = data.table(spark, sf, "documents").select(F.col("lang").alias("source"), F.col("source").alias("group_id"))
    return leakage.group_samples(groups)


@query
def report_sink(spark, sf):
    """Split statistics written as a JSON report and read back."""
    path = folder(spark, "report")
    logs.write_report(splits.split_stats(_split(spark, sf)), path)
    return spark.read.schema("source string, split string, n long, anomalies long, anomaly_fraction double").json(path)


@query
def leakage_samples(spark, sf):
    return leakage.samples(data.lines(spark, sf))


@query
def line_intersection(spark, sf):
    return leakage.common_lines(data.lines(spark, sf))


@query
def ngram_counts(spark, sf):
    return ood.ngram_counts(data.lines(spark, sf))


@query
def ood_distance_matrix(spark, sf):
    return ood.distances(data.lines(spark, sf))


# Scores and decisions


@query
def demo_scores(spark, sf):
    return rounded(data.predictions(spark, sf).select("row_id", "p_anomaly"))


@query
def validate_requests(spark, sf):
    return requests.validate(data.requests(spark, sf))


@query
def score_job(spark, sf):
    return rounded(requests.score_job(data.requests(spark, sf), 0.7))


def _p(spark, sf):
    return data.predictions(spark, sf).withColumnRenamed("p_anomaly", "p1")


@query
def selective_decision(spark, sf):
    return _p(spark, sf).select("row_id", col.selective(F.col("p1"), 0.7).alias("decision"))


@query
def serving_decision(spark, sf):
    return _p(spark, sf).select("row_id", col.serving(F.col("p1"), 0.7).alias("decision"), col.serving_reason(F.col("p1"), 0.7).alias("reason"))


# Metrics


@query
def confusion_counts(spark, sf):
    return metrics.confusion(data.predictions(spark, sf))


@query
def threshold_metrics(spark, sf):
    return rounded(metrics.thresholded(metrics.confusion(data.predictions(spark, sf))))


@query
def confusion_matrix(spark, sf):
    return rounded(metrics.confusion_shares(data.predictions(spark, sf)))


@query
def auc_roc(spark, sf):
    return rounded(metrics.auc_roc(data.predictions(spark, sf)))


@query
def auc_pr(spark, sf):
    return rounded(metrics.auc_pr(data.predictions(spark, sf)))


@query
def fpr_at_recall(spark, sf):
    return rounded(metrics.fpr_at_recall(data.predictions(spark, sf)))


@query
def metric_panel(spark, sf):
    return rounded(metrics.panel(data.predictions(spark, sf)))


@query
def macro_metrics(spark, sf):
    return rounded(metrics.macro(metrics.panel(data.predictions(spark, sf))))


@query
def seed_aggregates(spark, sf):
    s = metrics.summary(data.cells(spark, sf), ["condition", "metric"])
    return rounded(s.withColumn("headline", metrics.headline(F.col("mean") / 1e4, F.col("std") / 1e4)))


@query
def roc_curve(spark, sf):
    return rounded(curves.roc(data.predictions(spark, sf)))


@query
def pr_curve(spark, sf):
    return rounded(curves.pr(data.predictions(spark, sf)))


@query
def curve_areas(spark, sf):
    return rounded(curves.areas(data.predictions(spark, sf)))


# Calibration


def _logits(spark, sf):
    return calibration.with_logits(data.predictions(spark, sf))


@query
def logits_softmax(spark, sf):
    return rounded(_logits(spark, sf).select("row_id", "z1", col.softmax1(F.col("z0"), F.col("z1")).alias("p1")))


@query
def reliability_bins(spark, sf):
    return rounded(calibration.bins(_p(spark, sf)))


@query
def ece_mce(spark, sf):
    return rounded(calibration.ece(calibration.bins(_p(spark, sf))))


@query
def apply_temperature(spark, sf):
    return rounded(_logits(spark, sf).select("row_id", col.softmax1(F.col("z0"), F.col("z1"), 2.5).alias("p1")))


@query
def apply_platt(spark, sf):
    return rounded(_logits(spark, sf).select("row_id", calibration.platt(F.col("z0"), F.col("z1"), 0.7, -0.2).alias("p1")))


@query
def fit_temperature(spark, sf):
    t, before, after = calibration.fit_temperature(_logits(spark, sf))
    return rounded(spark.createDataFrame([(t, before, after)], "temperature double, nll_before double, nll_after double"), 5)


@query
def fit_platt(spark, sf):
    return rounded(spark.createDataFrame([calibration.fit_platt(_logits(spark, sf))], "a double, b double"), 5)


@query
def fit_vector_scaling(spark, sf):
    return spark.createDataFrame([calibration.fit_vector(_logits(spark, sf))], "w0 double, w1 double")


@query
def vector_classes(spark, sf):
    """Roles of turns as three classes, logits from a turn's place and length: NLL with and without the fitted weights."""
    c = data.table(spark, sf, "conversations").where("role in ('system', 'user', 'assistant')")
    z = F.array(F.when(F.col("turn") == 0, 1.0).otherwise(-1.0), F.when(F.col("turn") % 2 == 0, 0.7).otherwise(-0.3), F.log1p(F.length("text").cast("double")) / 5)
    y = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    rows = c.select("conv_id", "turn", y.alias("y_true"), z.alias("z"))
    w = calibration.fit_classes(rows, 3)
    nll = lambda weights: F.avg(-F.log(F.get(calibration.classes(F.col("z"), weights), F.col("y_true"))))
    return rounded(rows.agg(F.count("*").alias("n"), nll([1.0] * 3).alias("before"), nll(w).alias("after")).withColumns({f"w{i}": F.lit(x) for i, x in enumerate(w)}))


@query
def calibrate_fold(spark, sf):
    rows = data.predictions(spark, sf)
    folds = [r.fold for r in rows.groupBy("fold").count().where("count >= 4 and fold is not null").orderBy("fold").collect()]  # a row a system
    out = [(fold, k, str(v)) for fold in folds for k, v in sorted(calibration.calibrate(rows.where(F.col("fold") == fold)).items())]
    return spark.createDataFrame(out, "fold string, name string, value string")


# Selection


@query
def aurc(spark, sf):
    return rounded(selective.aurc(_p(spark, sf)))


@query
def risk_coverage(spark, sf):
    return rounded(selective.risk_coverage(_p(spark, sf)).drop("conf"))


@query
def tau_for_budget(spark, sf):
    return rounded(selective.tau_for_budget(_p(spark, sf), 0.45))


@query
def coverage_at_risk(spark, sf):
    return rounded(selective.coverage_at_risk(_p(spark, sf), 0.45))


@query
def tau_shift(spark, sf):
    return rounded(selective.tau_shift(_p(spark, sf), "fr", 0.45, F.col("row_id") % 20 == 0))


# Statistics


@query
def bootstrap_ci(spark, sf):
    b = bootstrap.intervals(data.predictions(spark, sf))
    return b.withColumn("text", bootstrap.formatted(F.col("point"), F.col("low"), F.col("high")))


@query
def macro_bootstrap(spark, sf):
    return bootstrap.macro_intervals(bootstrap.intervals(data.predictions(spark, sf), n=200))


@query
def cell_summary(spark, sf):
    return rounded(stats.cell_summary(data.cells(spark, sf)))


@query
def paired_compare(spark, sf):
    return rounded(stats.compare(data.cells(spark, sf), "en"))


@query
def cliffs_delta(spark, sf):
    return rounded(stats.cliffs_delta(data.cells(spark, sf), "en"))


@query
def signed_rank(spark, sf):
    return rounded(stats.tests(data.cells(spark, sf), "en"))


def _tests(spark, sf):
    """(fold, unit, p): a probability for each source in each language."""
    d = data.table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "source")
    rows = data.predictions(spark, sf).join(d, "row_id")
    return rows.groupBy("fold", F.col("source").alias("unit")).agg(F.min("p_anomaly").alias("p"))


@query
def holm(spark, sf):
    return rounded(stats.holm(_tests(spark, sf), ["fold"], ["unit"]))


@query
def joint_significance(spark, sf):
    cells = data.cells(spark, sf)
    tested = stats.holm(stats.tests(cells, "en"), ["axis"], ["condition"])
    return rounded(stats.joint(tested.join(stats.cliffs_delta(cells, "en"), stats.CELL)))


@query
def ablation_matrix(spark, sf):
    return rounded(stats.matrix(stats.cell_summary(data.cells(spark, sf)), "en"))


@query
def head_to_head(spark, sf):
    panel = metrics.panel(data.predictions(spark, sf))
    ours = panel.select(F.lit("scorer").alias("method"), "fold", "f1")
    best = panel.agg(F.max("recall").alias("r"), F.min("precision").alias("p")).first()
    other = [{"method": "highest recall", "year": 2020, "per_fold": {"de": {"f1": best.r}, "es": {"f1": None}}, "macro_f1": best.p}, {"method": "macro only", "per_fold": None, "macro_f1": 0.8}, {"method": "folds only", "per_fold": {"en": {"f1": 0.25}}, "macro_f1": None}]
    other = logs.published_table(spark, other)
    return stats.head_to_head(ours, other, ["de", "en", "es", "fr"])


@query
def loss_tail(spark, sf):
    d = data.table(spark, sf, "documents").groupBy("lang", F.floor(F.col("doc_id") / 50).alias("step")).agg(F.avg(F.col("n_chars").cast("double")).alias("value"))
    return stats.loss_tail(d, ["lang"])


@query
def run_grid(spark, sf):
    schema = "axis string, condition string, seed long, score double"
    return stats.run_grid(data.cells(spark, sf).select("axis", "condition", "seed", "value"), lambda r: {k: r[k] for k in ("axis", "condition", "seed")} | {"score": r["value"] / 1000.0}, schema)


# Drift and streams


def _reference(spark, sf):
    return data.drift_rows(spark, sf).where("ts < timestamp '2024-01-11 00:00:00'")


@query
def ks_two_sample(spark, sf):
    rows = data.drift_rows(spark, sf).withColumn("side", F.when(F.col("ts") < F.lit("2024-01-11").cast("timestamp"), "b").otherwise("a"))
    return rounded(drift.ks(rows, ["key"]))


@query
def drift_report(spark, sf):
    return rounded(drift.report(data.drift_rows(spark, sf), _reference(spark, sf), ["key"], ["ts", "event_id"]))


@query
def drift_windows(spark, sf):
    out = drift.windows(data.drift_rows(spark, sf), _reference(spark, sf), ["key"], "1 day")
    return rounded(out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd")))


@query
def five_number_summary(spark, sf):
    return rounded(drift.five_numbers(data.drift_rows(spark, sf), ["key"]))


def _stream(spark, sf, name):
    schema = data.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_files(spark, sf, name))


def _files(spark, sf, name):
    """A folder to stream from, with a copy of the table."""
    path = folder(spark, f"stream-{name}")
    data.table(spark, sf, name).write.parquet(path)
    return path


def _run(stream, mode="append"):
    spark, path = stream.sparkSession, folder(stream.sparkSession, "sink")
    streams.drained(stream, path, mode)
    return spark.read.parquet(f"{path}/out")


@query
def stream_mask(spark, sf):
    c = _stream(spark, sf, "conversations").select("conv_id", "turn", "text")
    return _run(streams.masked(c)).select("conv_id", "turn", "masked")


@query
def stream_score(spark, sf):
    c = _stream(spark, sf, "conversations").select("conv_id", "turn", "text")
    return rounded(_run(streams.scored(c, 0.7)).select("conv_id", "turn", "p_anomaly", "confidence", "decision"))


FAR = "2100-01-01 00:00:00"


def _closed(spark, sf, make):
    """Rows of a windowed stream over all events, flushed by a later row fed in a second run on the same state."""
    e = data.table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").cast("int").alias("label"))
    source, path = folder(spark, "stream-events"), folder(spark, "sink")
    e.write.parquet(source)
    stream = lambda: make(spark.readStream.schema(e.schema).parquet(source))
    streams.drained(stream(), path)
    e.limit(1).select(F.lit(-1).cast("long").alias("key"), F.lit(FAR).cast("timestamp").alias("ts"), F.lit(0).alias("label")).write.mode("append").parquet(source)
    streams.drained(stream(), path)
    return spark.read.parquet(f"{path}/out").where(F.col("start") < F.lit(FAR).cast("timestamp") - F.expr("interval 1 day"))


@query
def stream_sessions(spark, sf):
    out = _closed(spark, sf, lambda s: streams.session_sequences(s, "2 hours", "1 hour"))
    return rounded(out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")))


@query
def stream_session_lines(spark, sf):
    """Sessions with their lines, from three triggers that each bring lines of the one before, closed by a later line."""
    e = data.table(spark, sf, "events")
    text = F.concat_ws(" ", "event_type", "props")
    rows = e.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("place"), text.alias("text"), (F.col("event_type") == "error").cast("int").alias("label"))
    third = F.least(F.lit(2), F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01")) / 10))
    dealt = rows.withColumn("trigger", F.least(F.lit(2), third + F.when(F.col("place") % 7 == 0, 1).otherwise(0)))
    end = rows.limit(1).select(F.lit(-1).cast("long").alias("key"), F.lit(FAR).cast("timestamp").alias("ts"), F.lit(0).cast("long").alias("place"), F.lit("").alias("text"), F.lit(0).alias("label"))
    source, path = folder(spark, "stream-lines"), folder(spark, "sink")
    with streams.state_store(spark):
        for part in (*(dealt.where(F.col("trigger") == i).drop("trigger") for i in range(3)), end):
            part.write.mode("append").parquet(source)
            streams.drained(streams.session_lines(spark.readStream.schema(rows.schema).parquet(source), 7200, "21 days", limit=50), path)
    out = spark.read.parquet(f"{path}/out").where("key >= 0")
    return rounded(out.select("key", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n_lines", "label", F.sha2(F.array_join("lines", "\n"), 256).alias("digest")))


@query
def stream_windows(spark, sf):
    out = _closed(spark, sf, lambda s: streams.line_windows(s, "6 hours", "3 hours", "1 hour"))
    return rounded(out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")))


@query
def stream_drift(spark, sf):
    """Last-N drift per key after everything arrived; the reference is a bounded sample of each key's first ten days."""
    base, rows, source, path = folder(spark, "drift-reference"), data.drift_rows(spark, sf), folder(spark, "stream-events"), folder(spark, "sink")
    drift.last(_reference(spark, sf), ["key"], ["ts", "event_id"]).select("key", "value").write.parquet(base)
    reference = spark.readStream.schema("key string, value double").parquet(base)
    with streams.state_store(spark):
        for i in (1, 2, 0):  # in three triggers, each over all days
            rows.where(F.col("event_id") % 3 == i).write.mode("append").parquet(source)
            streams.drained(streams.drift_state(spark.readStream.schema(rows.schema).parquet(source), reference), path, "update", streams.publish(f"{path}/out"))
    return rounded(streams.latest(spark, f"{path}/out", ["key"]))
