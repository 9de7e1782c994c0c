"""Set-based operators: keyed lookups, data-quality rules, write-path
transforms, skew-aware join helpers and the job-status batch jobs."""
