"""The studyset model, workflows, and the registry of queries."""
