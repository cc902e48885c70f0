"""Registered queries: each one a DataFrame program with the SQL that it must agree with."""
