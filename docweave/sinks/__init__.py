"""Results as files: documents of the office format, states, reports."""
