"""Spark jobs for cohorts of magnetic-resonance scans, keyed by scan."""
