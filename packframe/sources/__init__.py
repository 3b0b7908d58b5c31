"""Readers and writers: example tables, regime state, diagnostics."""
