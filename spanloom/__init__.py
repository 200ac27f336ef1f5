"""Scorecard analytics over tool-calling traffic, expressed as Spark plans."""
