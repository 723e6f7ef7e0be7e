"""Registered queries: operators applied to whole tables, with the SQL that states the same."""
