"""Registered queries over the test tables, and the SQL that gives the same rows.

Where a query needs a model, FIXED stands for a fitted one, so that every figure can be checked.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tranche.functions.scalars import delinquency_months
from tranche.operators import drift, fairness, features, labels, metrics, ranks, reasons, splits
from tranche.sources import testtables as tt
from tranche.sources import gzip_lines
from tranche.sources.loan_files import load_stats, parsed, read_lines, rejected
from tranche.sources.schemas import ACQUISITION, PERFORMANCE
from tranche.sources.store import load_dataset, save_dataset, save_report
from tranche.sources.versions import workspace

from . import ingest, label_deltas, models, out_of_time

COLUMNS = features.columns()
LAST_TRAIN = 1998
#: feature: mean, standard deviation, coefficient.
PARAMETERS = {
    "fico": (700.0, 69.0, -0.55), "oltv": (68.0, 17.0, 0.3), "dti": (37.0, 16.0, 0.25), "orig_rate": (6.0, 0.9, 0.15), "log_upb": (11.7, 0.7, 0.05),
    "ocltv": (72.0, 17.0, 0.1), "rate_spread": (-1.5, 0.9, 0.1), "mi_pct": (8.0, 12.0, -0.05), "num_borrowers": (1.5, 0.5, -0.1), "has_coborrower": (0.5, 0.5, -0.1),
    "first_time_buyer": (0.5, 0.5, 0.2), "purpose=C": (0.2, 0.4, 0.08), "occupancy=I": (0.25, 0.43, 0.12), "channel=B": (0.2, 0.4, 0.06), "channel=UNK": (0.4, 0.49, 0.03),
}
FIXED = models.Logistic(COLUMNS, *[[PARAMETERS.get(f, (0.0, 1.0, 0.0))[i] for f in COLUMNS] for i in range(3)], -0.9)


def r(c: str | Column, digits: int = 6) -> Column:
    """Rounded, so that the order of additions doesn't show; without a negative zero."""
    col = F.col(c) if isinstance(c, str) else c
    return (F.round(col, digits) + F.lit(0.0)).alias(c) if isinstance(c, str) else F.round(col, digits) + F.lit(0.0)


def loans(spark: SparkSession, d: str) -> DataFrame:
    return labels.label_loans(tt.performance(spark, d))


def joined(spark: SparkSession, d: str) -> DataFrame:
    return features.joined(tt.acquisitions(spark, d), loans(spark, d))


def rows(spark: SparkSession, d: str) -> DataFrame:
    return features.feature_rows(joined(spark, d))


def matrix(spark: SparkSession, d: str) -> DataFrame:
    return features.matrix(rows(spark, d))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return FIXED.score(matrix(spark, d))


def split(spark: SparkSession, d: str) -> DataFrame:
    return splits.by_vintage(matrix(spark, d), LAST_TRAIN)


def grouped(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).withColumn("grp", F.coalesce("state", F.lit("UNKNOWN")))


def parse_acquisition(spark, d):
    return parsed(tt.acquisition_lines(spark, d), ACQUISITION).select(*ACQ_SHOWN).withColumn("orig_date", F.col("orig_date").cast("string"))


def parse_performance(spark, d):
    return parsed(tt.performance_lines(spark, d), PERFORMANCE).select("loan_id", F.col("period").cast("string").alias("period"), "loan_age", "dlq_status", "zb_code")


def load_stats_query(spark, d):
    return load_stats(tt.acquisition_lines(spark, d, planted=True), ACQUISITION)


def rejected_rows(spark, d):
    bad = rejected(tt.acquisition_lines(spark, d, planted=True), ACQUISITION)
    return bad.select(F.split("value", r"\|", -1)[0].alias("loan_id"), "reason")


def delinquency(spark, d):
    months = tt.performance(spark, d)
    return months.groupBy(delinquency_months(F.col("dlq_status")).alias("months")).agg(F.count(F.lit(1)).alias("n"))


def loan_labels(spark, d):
    return loans(spark, d).withColumn("orig_date", F.col("orig_date").cast("string"))


def vintage_cohorts(spark, d):
    return labels.cohorts(loans(spark, d)).withColumn("d90_rate", r("d90_rate"))


def benchmark_spread(spark, d):
    year = F.year("orig_date")
    return tt.acquisitions(spark, d).select("loan_id", features.benchmark_rate(year).alias("benchmark"), r(F.coalesce(F.col("orig_rate") - features.benchmark_rate(year), F.lit(0.0))).alias("rate_spread"))


def feature_table(spark, d):
    names = [f.name for f in features.spec()]
    return rows(spark, d).select("loan_id", "vintage", "y", *[r(n) if not f.vocab else F.col(n) for n, f in zip(names, features.spec(), strict=True)])


def design_matrix(spark, d):
    return matrix(spark, d).select("loan_id", "vintage", "y", *[r(F.col(f"`{c}`")).alias(c) for c in COLUMNS])


def join_accounting(spark, d):
    return features.accounting(joined(spark, d))


def missing_by_field(spark, d):
    return features.missing_by_field(joined(spark, d))


def vintage_split(spark, d):
    return split(spark, d).groupBy("vintage", "is_test").agg(F.count(F.lit(1)).alias("n"))


def hash_split(spark, d):
    return splits.at_random(matrix(spark, d)).select("loan_id", "is_test")


def score_fixed_model(spark, d):
    return scored(spark, d).select("loan_id", r("pd"))


def auc(spark, d):
    return metrics.auc(scored(spark, d)).select(r("auc"))


def brier(spark, d):
    return metrics.brier(scored(spark, d)).select("n", r("brier"))


def brier_skill(spark, d):
    return metrics.brier(scored(spark, d)).select(r("climatology"), r("skill"))


def calibration_in_large(spark, d):
    return metrics.brier(scored(spark, d)).select(r("mean_predicted"), r("realised"), r(F.when(F.col("mean_predicted") > 0, F.col("realised") / F.col("mean_predicted"))).alias("ratio"))


def reliability(spark, d, strategy):
    found = metrics.reliability(scored(spark, d), strategy=strategy)
    return found.select("bin", "n", r("mean_predicted"), r("realised"), r("p_lo"), r("p_hi"))


def decile_table(spark, d):
    return metrics.deciles(scored(spark, d)).select("decile", "n", r("mean_predicted"), r("realised"), r("lift"))


def evaluation_report(spark, d):
    return metrics.evaluation(scored(spark, d)).select("metric", r("value"))


def evaluation_full(spark, d):
    return metrics.full_evaluation(scored(spark, d)).select("part", "bin", "metric", r("value"))


def quantile_cuts(spark, d):
    return ranks.quantile_cuts(rows(spark, d).select(F.col("fico").cast("double").alias("fico")), "fico").select("cut")


def psi_score(spark, d):
    s = FIXED.score(split(spark, d)).select("is_test", F.round("pd", metrics.SCORE_DIGITS).alias("pd"))
    return drift.feature_psi(s, ["pd"]).select("feature", r("psi"))


def psi_features(spark, d):
    return drift.feature_psi(split(spark, d), COLUMNS).select("feature", "position", r("psi"))


def top_drifted(spark, d):
    return drift.top_drifted(drift.feature_psi(split(spark, d), COLUMNS)).select("feature", r("psi"))


def contributions(spark, d):
    return reasons.contributions(FIXED, matrix(spark, d)).select("loan_id", "feature", r("contribution"))


def reason_codes(spark, d):
    found = reasons.reason_rows(reasons.explained(FIXED, matrix(spark, d)))
    return found.select("loan_id", "rank", "feature", r("contribution"), r("value"))


def explained_loans(spark, d):
    found = reasons.explained(FIXED, matrix(spark, d))
    return found.select("loan_id", r("pd"), r("log_odds"), F.size("reasons").cast("long").alias("n_reasons"), F.element_at("reasons", 1)["feature"].alias("first_reason"))


def group_attach(spark, d):
    """Loans ending in 3 have another id where their group is looked up, so they get none. Those ending in 5 stand there twice,
    those ending in 7 too: the later row has another group, or none."""
    known = tt.acquisitions(spark, d).withColumn("loan_id", F.when(F.col("loan_id").endswith("3"), F.concat(F.lit("X"), F.col("loan_id"))).otherwise(F.col("loan_id"))).withColumn("row", F.lit(1))
    again = known.where(F.col("loan_id").endswith("5") | F.col("loan_id").endswith("7")).withColumn("row", F.lit(2))
    again = again.withColumn("state", F.when(F.col("loan_id").endswith("5"), F.concat(F.lit("A "), F.col("state"))))
    attached = features.attach_groups(matrix(spark, d).select("loan_id"), known.unionByName(again), order="row")
    return attached.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


def labels_over_deltas(spark, d):
    """The labels of all months, which come as four deltas by year and one more that repeats a part of them."""
    months, path = tt.performance(spark, d), workspace(spark)
    year = F.year("period")
    for name, part in (("1995-1996", year <= 1996), ("1999-", year >= 1999), ("1997", year == 1997), ("1998", year == 1998), ("again", F.col("loan_age") % 5 == 0)):
        label_deltas.apply_delta(spark, path, months.where(part), name, buckets=8)
    return label_deltas.current_labels(spark, path).withColumn("orig_date", F.col("orig_date").cast("string"))


def saved_and_scored(spark, d):
    """Scores by a model and over a matrix that were saved as one version and read again."""
    path, every = workspace(spark), joined(spark, d)
    built = ingest.Dataset(features.matrix(features.feature_rows(every)), features.accounting(every), features.missing_by_field(every))
    save_dataset(built, path, labels.HORIZON, {"fixed": FIXED})
    saved = load_dataset(spark, path)
    return saved.models["fixed"].score(saved.matrix).select("loan_id", r("pd"))


def gzip_acquisitions(spark, d):
    """Acquisitions out of gzip files of many members, which several tasks read each."""
    path = workspace(spark)
    gzip_lines.write_gzip_lines(tt.acquisition_lines(spark, d), path, member=500)
    return parsed(gzip_lines.read_gzip_lines(spark, path, split=1 << 16), ACQUISITION).select(*ACQ_SHOWN).withColumn("orig_date", F.col("orig_date").cast("string"))


def rejected_lines(spark, d):
    """Rejected rows of files, with file and line: a file for each year of origination, in order of loans."""
    path = workspace(spark)
    year = F.year("orig_date").alias("year")
    given = tt.acquisition_lines(spark, d, planted=True).withColumn("loan", F.split("value", r"\|", -1)[0])
    years = tt.acquisitions(spark, d).select(F.col("loan_id").alias("loan"), year)
    dealt = given.join(years, "loan").repartition("year").sortWithinPartitions("year", "loan")
    dealt.select("year", "value").write.partitionBy("year").text(path)
    bad = rejected(read_lines(spark, path), ACQUISITION)
    return bad.select(F.regexp_extract("file", r"year=(\d+)", 1).alias("year"), "line", F.split("value", r"\|", -1)[0].alias("loan_id"), "reason")


def group_parity(spark, d):
    return fairness.parity(grouped(spark, d)).select("grp", "n", r("mean_predicted"), r("realised"), r("gap"))


def group_pooling(spark, d):
    finer = grouped(spark, d).withColumn("grp", F.concat("grp", F.lit("-"), "vintage"))
    return fairness.pooled(finer).groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


def proxy_power(spark, d):
    return fairness.proxy_power(fairness.pooled(grouped(spark, d)), COLUMNS).select("feature", r("power"))


def planted(spark, d):
    """A column that is 100 for one group alone stands for a proxy."""
    return grouped(spark, d).withColumn("planted", F.when(F.col("grp") == "CHINA", 100.0).otherwise(0.0))


def proxy_flags(spark, d):
    return fairness.proxy_flags(fairness.proxy_power(fairness.pooled(planted(spark, d)), ["planted", *COLUMNS])).select("feature", r("power"))


def fairness_audit(spark, d):
    groups, power = fairness.audit(grouped(spark, d), COLUMNS)
    long = lambda df, key, *cols: df.select(F.col(key).alias("name"), F.explode(F.array(*[F.struct(F.lit(c).alias("figure"), F.col(c).cast("double").alias("value")) for c in cols])).alias("x")).select("name", "x.*")
    return long(groups, "grp", "n", "mean_predicted", "realised", "gap").unionByName(long(power, "feature", "power")).select("name", "figure", r("value"))


def worst_group(spark, d):
    return fairness.worst(fairness.parity(grouped(spark, d))).select("grp", r("gap"))


def logistic_fit(spark, d):
    model = models.fit_logistic(matrix(spark, d), COLUMNS)
    return spark.createDataFrame(list(zip(model.features, model.means, model.stds, model.coefs, strict=True)), "feature string, mean double, std double, coef double")


def logistic_certificate(spark, d):
    """The gradient of the penalised loss at the fitted parameters, which is zero where it is least."""
    def found(m: DataFrame) -> DataFrame:
        return models.gradient(models.fit_logistic(m, COLUMNS), m)

    return ranks.settled(matrix(spark, d), found).select("parameter", r("gradient"))


def gbt_importance(spark, d):
    model = models.fit_boosted(matrix(spark, d), COLUMNS)
    return spark.createDataFrame(model.importances(), "feature string, importance double")


def permutation_importance(spark, d):
    return spark.createDataFrame(models.permutation_importance(FIXED, matrix(spark, d), COLUMNS), "feature string, importance double").select("feature", r("importance"))


def top_importances(spark, d):
    best = models.top_importances(models.permutation_importance(FIXED, matrix(spark, d), COLUMNS), 5)
    return spark.createDataFrame([(i, f, x) for i, (f, x) in enumerate(best, 1)], "rank int, feature string, importance double").select("rank", "feature", r("importance"))


#: Rates and a feature of one's own.
OWN_RATES = {1994: 8.38, 1997: 7.6, 2000: 8.05}
SECOND_LIEN = features.Feature("second_lien", ("ocltv", "oltv"), lambda: F.col("ocltv") - F.col("oltv"))


def custom_benchmark(spark, d):
    built = ingest.build(tt.acquisition_lines(spark, d), tt.performance_lines(spark, d), own=[*features.spec(OWN_RATES), SECOND_LIEN], benchmark=OWN_RATES)
    return built.matrix.select("loan_id", r("rate_spread"), r("second_lien"))


def model_comparison(spark, d):
    def compared(sides: DataFrame) -> DataFrame:
        train, test = sides.where("not is_test"), sides.where("is_test")
        first, second = models.fit_logistic(train, COLUMNS), models.fit_boosted(train, COLUMNS)
        return models.compare(metrics.evaluation(first.score(test)), metrics.evaluation(second.score(test)))

    return ranks.settled(split(spark, d), compared)


def out_of_time_report(spark, d):
    return ranks.settled(matrix(spark, d), lambda m: out_of_time.validate(m, COLUMNS, LAST_TRAIN).metrics)


def headline_table(spark, d):
    return ranks.settled(matrix(spark, d), lambda m: out_of_time.headline(out_of_time.validate(m, COLUMNS, LAST_TRAIN).metrics))


def labels_horizon_12(spark, d):
    return labels.label_loans(tt.performance(spark, d), 12).withColumn("orig_date", F.col("orig_date").cast("string"))


def label_faults(spark, d):
    """Months of some loans lose their loan_id or loan_age, or get a status that doesn't exist."""
    ends = F.col("loan_id").endswith
    broken = tt.performance(spark, d).select(
        F.when(~ends("63"), F.col("loan_id")).alias("loan_id"), "period", F.when(~ends("42"), F.col("loan_age")).alias("loan_age"),
        F.when(ends("21"), "?").otherwise(F.col("dlq_status")).alias("dlq_status"), "zb_code",
    )
    return labels.faults(broken).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def d180_matrix(spark, d):
    every = features.joined(tt.acquisitions(spark, d), loans(spark, d), target="d180")
    return features.matrix(features.feature_rows(every)).groupBy("vintage", "y").agg(F.count(F.lit(1)).alias("n"))


def standardised(spark, d):
    """The features as the logistic regression sees them."""
    names = ["fico", "log_upb", "purpose=C"]

    def found(m: DataFrame) -> DataFrame:
        means, stds = models.moments(m, names)
        return m.select("loan_id", *[r((F.col(f"`{f}`") - mean) / std).alias(f) for f, mean, std in zip(names, means, stds, strict=True)])

    return found(matrix(spark, d))


def one_loan(spark, d):
    """Why the loan of greatest id is as risky as it is."""
    m = matrix(spark, d)
    loan = m.agg(F.max("loan_id")).first()[0]
    return reasons.explain_one(FIXED, m, loan).select("loan_id", r("pd"), r("log_odds"), F.size("reasons").cast("long").alias("n_reasons"))


def reason_phrases(spark, d):
    found = reasons.reason_rows(reasons.explained(FIXED, matrix(spark, d)))
    return found.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))


def saved_report(spark, d):
    path = workspace(spark)
    save_report(metrics.evaluation(scored(spark, d)), path)
    return spark.read.schema("metric string, value double").json(path).select("metric", r("value"))


def gzip_by_extension(spark, d):
    path = workspace(spark)
    tt.performance_lines(spark, d).write.text(path, compression="gzip")
    return parsed(read_lines(spark, path), PERFORMANCE).select("loan_id", F.col("period").cast("string").alias("period"), "loan_age", "dlq_status", "zb_code")


#: A second model that looks at two features alone.
PLAIN = models.Logistic(["fico", "oltv"], [700.0, 68.0], [69.0, 17.0], [-0.7, 0.2], -1.0)


def oot_fixed_model(spark, d):
    """The out-of-time report of a trainer of one's own, which always gives the fixed model."""
    return ranks.settled(matrix(spark, d), lambda m: out_of_time.validate(m, COLUMNS, LAST_TRAIN, trainer=lambda rows, names: FIXED).metrics).select("protocol", "metric", r("value"))


def headline_fixed_model(spark, d):
    def found(m: DataFrame) -> DataFrame:
        return out_of_time.headline(out_of_time.validate(m, COLUMNS, LAST_TRAIN, trainer=lambda rows, names: FIXED).metrics)

    return ranks.settled(matrix(spark, d), found).select("position", "metric", r("naive"), r("oot"))


def comparison_fixed_models(spark, d):
    def compared(m: DataFrame) -> DataFrame:
        return models.compare(metrics.evaluation(FIXED.score(m)), metrics.evaluation(PLAIN.score(m)))

    return ranks.settled(matrix(spark, d), compared).select("metric", r("first"), r("second"), r("delta"))


ACQ_SHOWN = ["loan_id", "channel", "orig_rate", "orig_upb", "orig_date", "oltv", "ocltv", "num_borrowers", "dti", "fico", "first_time_buyer", "purpose", "property_type", "occupancy", "state", "mi_pct", "co_fico"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "parse_acquisition": parse_acquisition, "parse_performance": parse_performance, "load_stats": load_stats_query, "rejected_rows": rejected_rows,
    "delinquency_months": delinquency, "loan_labels": loan_labels, "vintage_cohorts": vintage_cohorts, "benchmark_spread": benchmark_spread,
    "feature_table": feature_table, "design_matrix": design_matrix, "join_accounting": join_accounting, "missing_by_field": missing_by_field,
    "vintage_split": vintage_split, "hash_split": hash_split, "score_fixed_model": score_fixed_model, "auc": auc, "brier": brier, "brier_skill": brier_skill,
    "calibration_in_large": calibration_in_large, "reliability_quantile": partial(reliability, strategy="quantile"), "reliability_uniform": partial(reliability, strategy="uniform"),
    "decile_table": decile_table, "evaluation_report": evaluation_report, "evaluation_full": evaluation_full, "quantile_cuts": quantile_cuts, "psi_score": psi_score, "psi_features": psi_features,
    "top_drifted": top_drifted, "contributions": contributions, "reason_codes": reason_codes, "explained_loans": explained_loans, "group_attach": group_attach,
    "group_parity": group_parity, "group_pooling": group_pooling, "proxy_power": proxy_power, "proxy_flags": proxy_flags, "fairness_audit": fairness_audit,
    "worst_group": worst_group, "logistic_fit": logistic_fit, "gbt_importance": gbt_importance, "model_comparison": model_comparison,
    "permutation_importance": permutation_importance, "top_importances": top_importances, "custom_benchmark": custom_benchmark,
    "labels_over_deltas": labels_over_deltas, "saved_and_scored": saved_and_scored, "gzip_acquisitions": gzip_acquisitions, "rejected_lines": rejected_lines,
    "labels_horizon_12": labels_horizon_12, "label_faults": label_faults, "d180_matrix": d180_matrix, "standardised": standardised, "one_loan": one_loan,
    "reason_phrases": reason_phrases, "saved_report": saved_report, "gzip_by_extension": gzip_by_extension, "oot_fixed_model": oot_fixed_model,
    "headline_fixed_model": headline_fixed_model, "comparison_fixed_models": comparison_fixed_models,
    "logistic_certificate": logistic_certificate, "out_of_time_report": out_of_time_report, "headline_table": headline_table,
}
