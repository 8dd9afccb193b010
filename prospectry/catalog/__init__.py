"""Registered queries over the driver tables, each with its check SQL where SQL can state it."""
