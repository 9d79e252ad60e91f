"""A library of point-in-time panel jobs on Spark."""
