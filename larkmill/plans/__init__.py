"""From parsed statements to DataFrames."""
