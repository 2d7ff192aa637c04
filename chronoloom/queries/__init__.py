"""Registered queries, each with the SQL that checks it where SQL can."""
