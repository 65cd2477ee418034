"""Distributed operators over range tables and the general data-pipeline operators."""
