"""Where tables live and what is read and written outside: managed tables, files, connectors."""
