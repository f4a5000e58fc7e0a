"""Row rules of the article table."""

from pyspark.sql import Column, functions as F

# Longest allowed text per column.
MAX_LENGTH = {
    "novelty_label": 10,
    "category": 50,
    "impact": 20,
    "sentiment": 20,
    "target_investor": 50,
}


def novelty_label(is_redundant: Column) -> Column:
    return F.when(is_redundant, "Low").otherwise("High")


def rejection_reason(columns=("title", *MAX_LENGTH)) -> Column:
    """First broken rule of a row, null for a valid one."""
    rules = []
    if "title" in columns:
        rules.append(F.when(F.col("title").isNull(), "title is null"))
    for name, longest in MAX_LENGTH.items():
        if name in columns:
            rules.append(F.when(F.length(name) > longest, f"{name} is longer than {longest}"))
    return F.coalesce(*rules, F.lit(None).cast("string"))
