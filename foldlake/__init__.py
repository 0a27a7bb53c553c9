"""Residue-pair analytics over protein chains, written as Spark DataFrame functions."""
