"""Operators: DataFrame in, DataFrame out, parameterised by column names."""
