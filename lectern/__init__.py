"""Text, audio-alignment and training-data jobs on Spark DataFrames."""
