"""Trajectory and road-intersection analytics on Spark, with a training-data toolbox in :mod:`rayline.llm`."""
