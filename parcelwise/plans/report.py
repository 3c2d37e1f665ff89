"""All analyses of one table of order lines, written out as result tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from parcelwise.functions.small import clear_scratch
from parcelwise.plans.catalogue import ANALYSES, MEASURES_OF_ALL, forget_scores
from parcelwise.sources.sinks import save_result

# rows of the input rather than results about it
NOT_RESULTS = ("scan_order_lines", "clean_projection", "date_parts", "one_hot", "interactions", "standardize")


def run_report(lines: DataFrame, path: str, names: Iterable[str] | None = None) -> dict[str, str]:
    """Write each analysis as a CSV table below ``path``; returns where each one went.

    ``lines`` has the working column names and must not come from a scratch table, since those are deleted at the
    end. Save a cleaned table as Parquet first when running many analyses: each one
    then reads only its own columns.
    """
    chosen = list(names) if names is not None else [n for n in ANALYSES if n not in NOT_RESULTS]
    written = {}
    for name in chosen:
        analysis = ANALYSES[name]
        # a wide table may have more numeric columns than the listed ones; analyses of all numbers take them too
        wanted = None if analysis.uses is None or name in MEASURES_OF_ALL else set(analysis.uses)
        given = lines if wanted is None else lines.select(*[c for c in lines.columns if c in wanted])
        written[name] = f"{path}/{name}"
        save_result(analysis.run(given), written[name])
    forget_scores()
    clear_scratch(lines.sparkSession)
    return written
