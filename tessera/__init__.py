"""Spark jobs for governed project knowledge: scan, rank, mask, trace and assemble text at scale."""
