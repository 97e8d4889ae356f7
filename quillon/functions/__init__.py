"""Column functions: analysis, scoring, presentation, literals and wire formats, registration in SQL."""
