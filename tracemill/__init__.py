"""Trajectory, graph and place-matching analytics on Spark DataFrames."""
