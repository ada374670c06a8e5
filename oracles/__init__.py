"""SQL that states each query's expected result independently, for an ANSI engine over the given tables."""
