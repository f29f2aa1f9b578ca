"""Reading messy delimited, JSON and log text, and tables, as DataFrames."""
