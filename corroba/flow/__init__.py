"""Analyses of method bodies: control flow, dataflow, register state."""
