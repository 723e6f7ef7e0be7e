"""Readers of packages, compiled classes, resource tables and binary XML, and the fact tables they fill."""
