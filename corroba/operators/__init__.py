"""Generic operators over keyed DataFrames."""
