"""Readers and writers for log files, labels, results, run logs and chunks."""
