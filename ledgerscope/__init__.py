"""Ledgerscope: merchant-risk monitoring over a transaction ledger, as Spark DataFrame jobs."""
