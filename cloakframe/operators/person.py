"""Names and places by gazetteer, listed values by deny table: findings from tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.operators import dictionary
from cloakframe.operators.detect import detect, is_false_positive, person_type
from cloakframe.policy import Policy


def detect_gazetteer(df: DataFrame, text_col: str, ids: list[str], gazetteer: DataFrame,
                     policy: Policy | None = None, score: float = 0.85, with_context: bool = True) -> DataFrame:
    """Findings for every name listed in ``gazetteer`` (key of one or more words, pii_type), leftmost-longest, then
    without the false-positive words and after the organisation/place -> person rule."""
    policy = policy or Policy()
    found = dictionary.matches(df, text_col, ids, dictionary.prepared(gazetteer), score, "gazetteer",
                               with_context=with_context)
    found = found.where(~is_false_positive(F.col("pii_type"), F.col("value"), policy.false_positive_words))
    return found.withColumn("pii_type", person_type(F.col("pii_type"), F.col("value"), F.col("preceding"))).drop("preceding")


def detect_person(df: DataFrame, text_col: str, ids: list[str], gazetteer: DataFrame,
                  policy: Policy | None = None) -> DataFrame:
    """Titled names and gazetteer names, as one findings table."""
    titled = detect(df, text_col, ids, (policy or Policy()).but(entities=("PERSON",)))
    return titled.unionByName(detect_gazetteer(df, text_col, ids, gazetteer, policy))


def detect_denied(df: DataFrame, text_col: str, ids: list[str], denied: DataFrame,
                  value_col: str = "value", pii_type: str = "DENIED", with_context: bool = True) -> DataFrame:
    """Findings for every value of a deny table that stands free in a text, whatever else detects it."""
    keys = denied.select(F.col(value_col).alias("key"), F.lit(pii_type).alias("pii_type"))
    return dictionary.matches(df, text_col, ids, dictionary.prepared(keys, dictionary.LITERALS), 1.0, "deny_list",
                              2_000_000, with_context).drop("preceding")
