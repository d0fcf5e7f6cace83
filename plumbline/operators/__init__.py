"""Profiling, splitting, encoding, scoring, comparing: functions from DataFrame to DataFrame."""
