"""Batch jobs over the stored tables: compositions of operators that write their results."""
