"""Marketplace stock synchronisation and stock ledger jobs on Spark DataFrames."""
