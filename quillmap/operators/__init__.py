"""Selections, kernels, meta-analyses, corrections, diagnostics and decoders over studyset tables."""
