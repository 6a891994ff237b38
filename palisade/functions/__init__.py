"""Column expressions that operators share; all are built in, so scans prune and code generation applies."""
