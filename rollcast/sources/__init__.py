"""Where series come from: files, tables, the synthetic system."""
