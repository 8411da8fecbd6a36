"""Whole runs: landscape reports, scenario pipelines, and the registered queries."""
