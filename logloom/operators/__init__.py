"""DataFrame -> DataFrame operators over events, issues, jobs and entries."""
