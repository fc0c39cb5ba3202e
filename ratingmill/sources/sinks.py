"""Writers. Parquet is the engine's own form; JSON lines, CSV and text are for other readers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def users_json(users: DataFrame, path: str) -> None:
    users.write.mode("overwrite").json(path)


def split_dataset(items: DataFrame, path: str) -> None:
    items.write.mode("overwrite").partitionBy("split").parquet(path)


def rounded_csv(df: DataFrame, path: str, digits: int = 4) -> None:
    """CSV with a header; doubles are rounded, missing values are empty."""
    cols = [F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(cols).write.mode("overwrite").csv(path, header=True, nullValue="")


#: How texts are written and read as CSV: all values in quotes, quotes doubled, rows end with a line feed alone. Carriage returns, line
#: feeds, backslashes and blanks at either end are kept; an empty text is read back as null.
CSV = {"header": True, "quote": '"', "escape": '"', "lineSep": "\n", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def plain_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    df.write.mode("overwrite").csv(path, quoteAll=True, compression=compression, **CSV)


def bias_csv(rows: DataFrame, path: str, compression: str = "none") -> None:
    """Scores of personas as CSV, columns as in schema.BIAS. Every row holds its prompt: rows of a prompt that lie together
    (expand.with_each_in_turn) take little room once they are compressed."""
    plain_csv(rows.select("model", "system_prompt", "persona_id", "persona", "prompt_id", "prompt", "response", "score"), path, compression)


def matrix(ratings: DataFrame, path: str) -> None:
    ratings.write.mode("overwrite").parquet(path)


def judge_scores(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").partitionBy("judge").parquet(path)


def report(lines: DataFrame, line: Column, order: Sequence[Column], path: str) -> None:
    """Fixed-width lines in order, one file: for reports, whose size does not follow the data."""
    lines.orderBy(*order).select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def printed(lines: DataFrame, line: Column, order: Sequence[Column], most: int = 10_000) -> int:
    """Prints a report's lines in order, as many as it has; raises if there are more than `most`, which is then no report."""
    rows = lines.orderBy(*order).select(line.alias("value")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} lines are no report")
    for r in rows:
        print(r.value)
    return len(rows)


def attributes_json(attributes: DataFrame, path: str) -> None:
    """(ord, attribute) as one JSON list."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "attribute"))), lambda a: a["attribute"])
    attributes.agg(F.to_json(ordered).alias("value")).write.mode("overwrite").text(path)


def mean_line(mean: str, spread: str) -> Column:
    """Two digits, halves to the even digit; what is missing is nan."""
    text = lambda c: F.when(F.col(c).isNull(), "nan").otherwise(F.format_string("%.2f", F.bround(c, 2)))
    return F.concat(text(mean), F.lit(" ± "), text(spread))


def share_line(share: str) -> Column:
    """A share as percent with one digit, halves to the even digit. Hundredfold as a decimal: as doubles, 0.2725 * 100 is above 27.25."""
    c = F.col(share)
    exact = F.bround(c.try_cast("decimal(30,20)") * 100, 1).cast("double")
    return F.format_string("%.1f%%", F.coalesce(exact, F.bround(c * 100, 1)))


def component_line() -> Column:
    return F.format_string("RC%-3d %6.2f  %-24s %+.3f", "rank", "ssl", "attribute", "loading")


def representatives_yaml(representatives: DataFrame) -> str:
    """(k, comp, attribute) as YAML text, components in their own order; there are a few dozen."""
    rows = representatives.orderBy("k", "comp").collect()
    out = []
    for k in sorted({r.k for r in rows}):
        out += [f"k{k}:", *[f"  - {r.attribute}" for r in rows if r.k == k]]
    return "\n".join(out) + "\n"
