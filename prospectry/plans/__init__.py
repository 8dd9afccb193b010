"""End-to-end jobs built from the operators: collect, merge, profile."""
