"""DataFrame -> DataFrame steps. None of them runs a job or collects rows."""
