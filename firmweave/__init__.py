"""firmweave: company-record completion and analytics as Spark DataFrame jobs.

Every public operator takes DataFrames and returns DataFrames.  Nothing here
holds a session or collects a table; see the README for the operator map.
"""
