"""Reading inputs and writing stages, reports and exports."""

from trialweave.sources.stages import (
    export,
    load_stage,
    materialize,
    save_stage,
    shared_dir,
    stage,
    write_csv,
)
from trialweave.sources.tables import CASE_SCHEMA, TableSpec, read_csv, read_input, resolve_source

__all__ = [
    "CASE_SCHEMA",
    "TableSpec",
    "export",
    "load_stage",
    "materialize",
    "read_csv",
    "read_input",
    "resolve_source",
    "save_stage",
    "shared_dir",
    "stage",
    "write_csv",
]
