"""Labels over a stream of monthly rows, with state that ends where rows come about in order.

All rows of a loan fall due in one month: that in which the loan reaches the horizon. The month is part of the key and the
stream's event time, so Spark drops a loan's state once the horizon has gone by for it, whether it was paid off before, stopped
reporting or goes on; rows beyond that come too late to open it again. What is held are the loans whose horizon still runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tranche.operators.labels import HORIZON, label_loans, labels_of, loan_states


def labelled(months: DataFrame, horizon: int = HORIZON, late: int = 3) -> DataFrame:
    """months: a streaming DataFrame. Labels by loan.

    Event time moves on with the youngest loans: a loan originated in month m says that all rows of months before
    m - `late` have come. Rows whose period and age don't agree with the loan's others (another due month), or that lack
    either, aren't joined with them: the former make a label of their own, the latter fail the query as in label_loans().
    A loan first met after its horizon gets no label here; the label job over deltas has it.
    """
    due = F.trunc(F.add_months("period", F.lit(horizon) - F.col("loan_age")), "MM")
    dated = months.withColumn("due", F.coalesce(due, F.raise_error(F.concat(F.lit("no period or loan_age: "), F.coalesce("loan_id", F.lit("(none)"))))).cast("timestamp"))
    states = loan_states(dated.withWatermark("due", f"{horizon + late} months"), "due")
    return labels_of(states, horizon)


def live_labels(months: DataFrame, horizon: int = HORIZON, late: int | None = None) -> DataStreamWriter:
    """Each trigger gives the labels of the loans that changed; start() the result.

    late: how many months rows may come after younger loans' first ones; state then ends as labelled() says. Without it rows
    may come in any order, years apart, and no state can end.
    """
    rows = label_loans(months, horizon) if late is None else labelled(months, horizon, late)
    return rows.writeStream.outputMode("update")


def final_labels(months: DataFrame, horizon: int = HORIZON, late: int = 3) -> DataStreamWriter:
    """Each trigger gives the labels of the loans whose horizon has gone by, once each; their state is dropped."""
    return labelled(months, horizon, late).writeStream.outputMode("append")
