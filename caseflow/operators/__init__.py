"""operators of caseflow."""
