"""Preference formatting of paired conversations.

For a chosen and a rejected conversation the longest common prefix of turns is rendered once as the
prompt; what follows is rendered for each as a completion, with the spans that a loss counts (the
text and end mark of the trained role; all else is masked).

Only DataFrame operations are used; one shuffle gathers the turns of a pair. Defined results: turns
compare equal if role and text do, nulls included; a null text renders empty, a null role as
`unknown`; turns of equal number stand in the order of role, then text; a null or empty conversation
has no turns, and shares none; repeated rows are turns of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE, TRAINED = "<|", "|>\n", "<|end|>\n", "assistant"


def gather_turns(turns: DataFrame, key: Column, sides: dict[str, Column]) -> DataFrame:
    """One row per key with an array of (role, text) in turn order for each side; sides: name to condition."""
    turn = F.struct(F.col("turn"), F.col("role"), F.col("text"))
    some = [F.array_sort(F.collect_list(F.when(on, turn))).alias(name) for name, on in sides.items()]
    got = turns.groupBy(key.alias("pair_id")).agg(*some)
    return got.select("pair_id", *[F.transform(n, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(n) for n in sides])


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("unknown")), F.lit(MIDDLE), F.coalesce(turn["text"], F.lit("")), F.lit(CLOSE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def trained_spans(turns: Column, role: str = TRAINED) -> Column:
    """(start, end) in characters of the rendered turns, for each turn of the trained role."""
    spot = "struct<at:int,spans:array<struct<start:int,end:int>>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")).cast(spot)

    def step(done: Column, t: Column) -> Column:
        end = done["at"] + F.length(rendered(t))
        first = done["at"] + F.length(F.coalesce(t["role"], F.lit("unknown"))) + len(OPEN) + len(MIDDLE)
        span = F.array(F.struct(first.alias("start"), (end - 1).alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == role, F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans")).cast(spot)

    return F.aggregate(turns, start, step, lambda done: done["spans"])


RESULTS = ("n_common", "prompt", "chosen_completion", "chosen_spans", "rejected_completion", "rejected_spans")


def format_preferences(pairs: DataFrame) -> DataFrame:
    """pairs: chosen and rejected, arrays of (role, text). Adds n_common, prompt, and for each side completion and spans.

    Other columns, of any name, pass through, but for any named as a result, which is replaced.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    rest_of = [c for c in pairs.columns if c not in RESULTS]
    sides = pairs.select(F.struct(*[F.col(f"`{c}`") for c in rest_of]).alias("row"), F.coalesce("chosen", none).alias("c"), F.coalesce("rejected", none).alias("r"))
    short = F.least(F.size("c"), F.size("r"))
    same = F.zip_with(F.slice("c", 1, short), F.slice("r", 1, short), lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    first = F.array_position(same, False)
    rest = lambda c: F.slice(F.col(c), F.col("n_common") + 1, F.size(c))
    out = sides.withColumn("n_common", F.when(first > 0, first - 1).otherwise(short).cast("int")).withColumn("prompt", render(F.slice("c", 1, F.col("n_common"))))
    for name, c in (("chosen", "c"), ("rejected", "r")):
        out = out.withColumn(f"{name}_completion", render(rest(c))).withColumn(f"{name}_spans", trained_spans(rest(c)))
    return out.select(*[F.col("row").getField(c).alias(c) for c in rest_of], *RESULTS)
