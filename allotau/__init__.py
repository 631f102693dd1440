"""Quasi-dynamic power-law analysis of many numeric matrices as Spark jobs."""
