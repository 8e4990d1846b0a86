"""Sources and sinks."""

from ratewise.sources.claims import (
    CLAIMS_SCHEMA,
    FIXTURE_CLAIMS_SQL,
    NUMBER_PATTERN,
    conform_claims,
    fixture_claims,
    load_claims,
    parse_amount,
    parse_amount_col,
)
from ratewise.sources.sinks import write_premiums

__all__ = [
    "CLAIMS_SCHEMA", "FIXTURE_CLAIMS_SQL", "NUMBER_PATTERN", "conform_claims", "fixture_claims",
    "load_claims", "parse_amount", "parse_amount_col", "write_premiums",
]
