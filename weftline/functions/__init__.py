"""Row-local functions on Columns with IEEE semantics."""
