"""Failures as values: a code that says what to do about them, and rows that carry it."""

from __future__ import annotations

# Codes of failures and what they mean.
CODES = {
    "invalid_state": "a prerequisite tool has not run yet",
    "unknown_entry": "no such feature_id in this ledger",
    "invalid_argument": "arguments missing, contradictory, or outside the vocabulary",
    "not_backed": "refused: no tool produced this id / species (anti-fabrication)",
    "engine_failed": "an external engine (R, REST) failed — not a data verdict",
    "ledger_conflict": "another call wrote this workdir first; nothing was written",
    "export_failed": "an artifact could not be written; the mapping is unaffected",
}
#: A failure in a row of a DataFrame.
SCHEMA = "struct<error: string, error_code: string, means: string, suggested_next_tools: array<string>>"


class Failure(RuntimeError):
    """What went wrong, by code; suggestions are what to run next."""

    def __init__(self, code: str, message: str, suggestions: tuple[str, ...] = (), **context):
        if code not in CODES:
            raise ValueError(f"no such code: {code}")
        super().__init__(message)
        self.code, self.message, self.suggestions, self.context = code, message, suggestions, context

    def row(self) -> dict:
        """As a value of SCHEMA, with the context beside it."""
        return {"error": self.message, "error_code": self.code, "means": CODES[self.code], "suggested_next_tools": list(self.suggestions), **self.context}


def unknown_entry(feature_id: str) -> Failure:
    return Failure("unknown_entry", f"unknown feature_id {feature_id}", ("detect_state", "ingest_names"))
