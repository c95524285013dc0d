"""Synthesis of electricity distribution grids from map data, as Spark plans."""
