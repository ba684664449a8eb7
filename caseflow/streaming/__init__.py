"""streaming of caseflow."""
