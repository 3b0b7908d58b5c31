"""Token-budgeted preparation and analysis of sequence corpora, on Spark."""
