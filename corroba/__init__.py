"""corroba: deterministic evidence-matching operators over Spark DataFrames."""
