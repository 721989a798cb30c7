"""Report sinks: delimited tables and an ordered run over several of them, each step on its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated with a header; part files, since a table may be larger than a machine."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True, emptyValue="")


ORDER = ["coverage", "figures", "provenance", "code", "annotated_source"]


def finalize(steps: dict[str, Callable[[], object]], what: list[str] | None = None) -> dict[str, str]:
    """Runs the steps asked for in order; a step that fails doesn't stop the others. -> name: ok or the error."""
    out = {}
    for name in what or [n for n in ORDER if n in steps]:
        if name not in steps:
            out[name] = "unknown step"
            continue
        try:
            steps[name]()
            out[name] = "ok"
        except Exception as e:  # noqa: BLE001  reported, not hidden
            out[name] = f"{type(e).__name__}: {e}"[:200]
    return out
