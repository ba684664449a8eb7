"""sources of caseflow."""
