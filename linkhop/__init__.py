"""Spark jobs that work out where links lead, over tables of captured answers."""
