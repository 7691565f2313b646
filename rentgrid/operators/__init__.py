"""Relational operators: DataFrame in, DataFrame out.  Reference times are parameters, never the clock."""
