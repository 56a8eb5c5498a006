"""Runs: from sources to committed assets, each with its gate, its error codes and its replay rule."""
