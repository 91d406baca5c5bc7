"""Candidate names: base forecast plus post-processing settings, as one sortable string."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotcast.functions.numeric import as_col


def candidate_name(base, bias_days, cap_days, cap_ratio) -> Column:
    """``base|b7|c28|r0.95``; a missing ratio reads ``off``."""
    text = F.format_string("%.2f", as_col(cap_ratio).cast("double"))
    ratio = F.when(as_col(cap_ratio).isNull(), "off").otherwise(text)
    return F.concat_ws(
        "|",
        as_col(base),
        F.concat(F.lit("b"), as_col(bias_days).cast("string")),
        F.concat(F.lit("c"), as_col(cap_days).cast("string")),
        F.concat(F.lit("r"), ratio),
    )


def parse_candidate(name) -> dict[str, Column]:
    """The four fields of a candidate name."""
    parts = F.split(as_col(name), r"\|")
    tail = [F.regexp_extract(parts[i], r"(?s)^.(.*)$", 1) for i in (1, 2, 3)]
    return {
        "base_candidate": parts[0],
        "bias_days": tail[0].cast("int"),
        "cap_days": tail[1].cast("int"),
        "cap_ratio": F.when(tail[2] != "off", tail[2]).cast("double"),
    }
