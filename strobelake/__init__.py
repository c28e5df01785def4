"""strobelake: frame-sequence analytics on Spark."""
