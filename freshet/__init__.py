"""Flood-surrogate analytics as Spark DataFrame jobs.

Everything works on long tables keyed ``(run, t, cell_id)``; functions take and
return DataFrames, and only small model matrices ever reach the driver.
"""
