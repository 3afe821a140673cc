"""Column functions: text analysis, vector clocks, log positions."""
