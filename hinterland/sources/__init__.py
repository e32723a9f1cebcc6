"""Readers, file choosers, sinks and reconciliation."""
