"""Registered queries: operators wired to tables, each with SQL that gives the same rows."""
