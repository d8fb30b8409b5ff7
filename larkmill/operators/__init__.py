"""DataFrame operators that statements and pipelines use."""
